"""Whole-text encoding with the ``tokenizers`` library, one memo per worker.

A text is cut where the vocabulary's own pre-tokenizer always cuts it (white
space, before a full stop or comma that ends a word), each distinct piece is
encoded by the library once, and the pieces' ids are joined. Texts that are not
plain Latin go to the library whole, as do all texts where the vocabulary's
pipeline is not the one described in ``_memo_is_exact``.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

MEMO_PIECES = 1_000_000
LONG_PIECE = 64

#: What is not plain Latin text: other scripts and combining marks, whose lower case, composition and classes the library
#: alone decides, a letter whose lower case is two, and separators that str.split knows as white space and the vocabulary doesn't.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f\u2010-\u2027]")
_MARKS_MEET = re.compile(r"(?:[^\w\s]|_)[.,]")
_WORDS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WORD_END = re.compile(r"(?<=[^\W\d_])([.,])(?=[ \n]|$)")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that prints as itself and the others, in order, from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in prints)}


_BYTE_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _memo_is_exact(spec: dict) -> bool:
    """True for NFC, blanks made one, lower case; then a split that drops white space."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and len(splits) == 2
        and splits[0].get("behavior") == "Removed"
        and splits[0].get("invert") is True
        and splits[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        and splits[0].get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not spec["model"].get("dropout")
    )


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._exact = _memo_is_exact(spec)
        self._model = self._tokenizer.model
        self._memo: dict[str, bytes] = {}
        self.size = self._tokenizer.get_vocab_size()

    def clear(self) -> None:
        """Forget the memo: at the end of a task, as the next one gains little by it."""
        self._memo.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, which the memo keeps too: the pre-tokenizer's words of each, through the model."""
        found = {}
        for p in pieces:
            if p.isalpha():
                found[p] = self._word(p)
            elif "'" in p:  # contractions have rules of their own
                found[p] = self._whole(p)
            else:
                found[p] = b"".join([self._word(w) for w in _WORDS.findall(p)])
        short = found if max(map(len, found)) <= LONG_PIECE else {p: v for p, v in found.items() if len(p) <= LONG_PIECE}
        if len(self._memo) + len(short) > MEMO_PIECES:
            self._memo.clear()
        if len(short) <= MEMO_PIECES:
            self._memo.update(short)
        return found

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self._exact or _UNUSUAL.search(text) or ("<|" in text and any(s in text for s in self._special)):
            return self._whole(text)
        if _MARKS_MEET.search(text):
            cut = _WORD_END.sub(r" \1", text)
        else:  # a full stop or comma follows a letter, a number or a blank everywhere
            cut = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        pieces = cut.lower().split()
        ids = list(map(self._memo.get, pieces))
        if None in ids:
            new, at = [], -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                new.append(at)
            found = self._learn({pieces[i] for i in new})
            for i in new:
                ids[i] = found[pieces[i]]
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
