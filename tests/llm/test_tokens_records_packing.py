"""Encoding against the library, record files against their contents, packing against its bounds."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from conftest import HARD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thermolith.llm import packing, records, tokens

PATH = tokens.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.text(max_size=200) | st.text("aZ.,'’ \n\t\x1c\x85é\u0301Σσςİ_1²½日!-", max_size=60))
@settings(max_examples=400, deadline=None)
def test_memo_equals_whole_encoding(text):
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


def test_memo_on_documents_and_with_a_small_memo(monkeypatch):
    texts = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"]).column(0).to_pylist()
    for limit in (tokens.MEMO_PIECES, 50):
        monkeypatch.setattr(tokens, "MEMO_PIECES", limit)
        enc = tokens.Encoder(PATH)
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids_of(t)
        assert len(enc._memo) <= limit


def test_records_round_trip(spark, hard, nothing, tmp_path):
    files = records.write_records(hard, str(tmp_path / "r"))
    found = records.read_records(files).collect()
    want = sorted(((i, *[[*ids_of(t), 2]]) for i, t, _ in HARD), key=lambda x: (x[0] is not None, x[0] or 0))
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [i for i, _ in want]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((i, len(x), crc(x)) for i, x in want)
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    assert not [p.name for p in (tmp_path / "r").iterdir() if p.name.startswith("_attempt")]
    path, docs = max((f["path"], f["docs"]) for f in files.collect())
    with open(path, "rb") as f:
        listed = list(records.unframe(f.read))
    assert len(listed) == docs
    for n in (docs - 1, 0):
        doc_id, ids = records.read_entry(path, n)
        assert doc_id == listed[n][0] and (ids == listed[n][1]).all()
    assert records.read_records(records.write_records(nothing, str(tmp_path / "e"))).count() == 0


def test_damage_is_found(tmp_path):
    good = records.frame(5, np.arange(10, dtype=np.uint32), 2) + records.frame(None, np.array([70_000], np.uint32), 4)

    def read(data):
        import io

        return list(records.unframe(io.BytesIO(data).read))

    assert [(i, x.tolist()) for i, x in read(good)] == [(5, list(range(10))), (None, [70_000])]
    for at in range(len(good)):
        with pytest.raises(ValueError):
            read(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    for cut in (3, 11, 20, len(good) - 2):
        with pytest.raises(ValueError):
            read(good[:cut])


def check_packed(rows, pairs, capacity=2048):
    want = {}
    for i, t, _ in pairs:
        ids = [*ids_of(t), 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            want.setdefault((i, n, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])), []).append(1)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter({k: len(v) for k, v in want.items()})
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_hard_documents(hard, nothing):
    rows = packing.pack_documents(hard).collect()
    n = check_packed(rows, HARD)
    assert n <= packing.lower_bound(np.array([r["length"] for r in rows])) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_exchange_between_partitions(documents, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_EACH", 25)
    pairs = [(i, " ".join(["word"] * (300 + 37 * i % 900)), "a") for i in range(400)]
    packed = packing.pack_documents(documents(pairs).repartition(16))
    rows = packed.collect()
    n = check_packed(rows, pairs)
    lengths = np.array([r["length"] for r in rows])
    alone = sum(len(packing.best_fit_decreasing(lengths[i::16])[2]) for i in range(16))
    assert packing.certificate(packed) == (n, packing.lower_bound(lengths))
    assert packing.lower_bound(lengths) <= n < alone


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


def fewest_bins(lengths, capacity):
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lengths[i]:
                place(i + 1, [*room[:k], room[k] - lengths[i], *room[k + 1 :]])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_bound_never_exceeds_the_fewest_bins(lengths):
    x = np.array(lengths, np.int64)
    assert packing.lower_bound(x, 12) <= (fewest_bins(sorted(lengths, reverse=True), 12) if lengths else 0)
    assert sorted(packing.best_fit_decreasing(x, 12)[2].tolist()) == plain_best_fit(lengths, 12)


def test_bound_beats_volume_where_it_should():
    assert packing.lower_bound(np.full(10, 1025)) == 10
    assert packing.lower_bound(np.full(9, 683)) == 5


def test_a_large_partition_is_packed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_MOST", 100)
    rows = [(i, 0, 0, 1 + i * 37 % 900, i) for i in range(1000)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES).coalesce(1)).collect()
    filled: dict[int, int] = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert sorted(r["doc_id"] for r in packed) == list(range(1000)) and max(filled.values()) <= 2048
    assert len(filled) <= 1.03 * -(-sum(r[3] for r in rows) // 2048)
