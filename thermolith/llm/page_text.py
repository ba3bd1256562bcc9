"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of block
elements with their presentation (tag, class and id words without numbers). A
node's content importance is its normalised entropy with the terms of repeated
contents left out: the share of its characters that no other page of the host
says. As few pages repeat little, that share is carried on to a host of
REFERENCE pages, which makes a small host's figures mean what a large one's do.
A node of which pages say the same has importance 0, one of which each page
says its own 1. The entropy of a node's sequences of children gives the
importance of its presentation, a small share of the whole.

What one host can't tell yet is shrunk, in this order: paths by tags alone over
all hosts towards a prior of the place; paths with classes over all hosts, and
paths by tags of the host, towards those; then the host's own paths with
classes. A host is one witness of bounded weight for others, and its own pages
outweigh all of that as they grow in number. The prior of a place is high
inside ``article``/``main``, low beside them, and lowest in places named as
menus, adverts, footers and so on. A heading is as important as the blocks that
it stands among, if that is more. Blocks of low importance go, and those that
are mostly links, except headings of articles. What no measure of repetition
can tell goes by its tags or names alone: forms, hidden parts, readers' comments.

Pages of a host that share their three longest blocks are copies of one page and
count once, so that copies don't make a page's content noise.

Counts are rows (host, node, value, copy) that Spark makes distinct and adds up
in steps, so a host with a third of all pages is one more key for partial sums,
not one task's tree. Pages meet their host's list of unimportant nodes by a join
that adaptive execution may split. A list holds paths by tags, and paths with
classes that a hundredth of the host's pages have, so it grows with the
template and not with the pages. Pages are parsed for the counts and again for
the texts: keeping the blocks of the first time would cost more disk than the
pages themselves.

Cases: a null html or one without text gives an empty text; a null or odd url
belongs to the host without name; repeated rows are extracted each; cut-off
pages, open elements and unknown tags are read as far as they go; pages of any
length are read whole; equal contents count together, and importances that tie
with the threshold stay; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Share of a node's importance that its presentation has.
PRESENTATION = 0.1
#: Importance below which a node goes.
THRESHOLD = 0.46
#: Pages of the host on which importances are stated.
REFERENCE = 200
#: Chances that two pages say the same, before anything is measured, and pairs of pages that each counts as.
PLAIN, MAIN, BESIDE, NAMED, NAMED_MAIN = range(5)
CHANCE, PAIRS = (0.0005, 0.0001, 0.006, 0.02, 0.02), (1, 1, 1, 40, 5)
#: Pairs of pages (times PAIRS) that the prior of a place, and other hosts' and tags' measure, count as.
PLACE_PAIRS, OTHER_PAIRS = 300.0, 200.0
#: Pairs of pages that a host counts as for other hosts at most, and the chance at most.
WITNESS_PAIRS, WITNESS_CHANCE = 50.0, 0.02
#: Share of a host's pages from which a path with classes is judged beside its path by tags.
JUDGED = 0.01
#: Pages that share so many of their longest blocks are copies.
LONGEST = 3
#: A block goes if links hold more than this share of it.
LINKED = 0.5

# Elements by their part in HTML.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_CLOSED_BY_SAME = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
    "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",),
}
_PARAGRAPH_STAYS = frozenset(("option", "optgroup"))
_GONE_TAGS = frozenset(
    "head form script style noscript template button select option textarea iframe svg canvas object dialog fieldset "
    "audio video math".split()
)
_NAMED_TAGS = frozenset("nav footer aside menu".split())
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = ("/h1", "/h2", "/h3", "/h4", "/h5", "/h6")
_GONE_ROLES = frozenset("search form dialog alertdialog".split())
_NAMED_ROLES = frozenset("navigation banner contentinfo complementary alert menu menubar toolbar".split())
_GONE_WORDS = frozenset("comment comments disqus respond replies".split())
_NAMED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot cookie cookies consent gdpr "
    "notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social "
    "related recommended widget widgets toolbar pagination pager copyright legal skip hidden noprint".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[a-z]+")


def key64(text: str) -> int:
    """A signed 64-bit key of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "path", "gone", "named", "main", "children")

    def __init__(self, tag: str, path: str, gone: bool, named: bool, main: bool):
        self.tag, self.path, self.gone, self.named, self.main, self.children = tag, path, gone, named, main, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t\r") else {}


def _opened(tag: str, text: str, parent: _Element) -> _Element:
    attributes = _attributes(text)
    role = attributes.get("role", "")
    words = _NAME_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else []
    gone = (
        parent.gone
        or tag in _GONE_TAGS
        or role in _GONE_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "")
        or (tag not in ("html", "body") and not _GONE_WORDS.isdisjoint(words))
    )
    names = _NAMED_WORDS.intersection(words) if tag not in ("html", "body", "main") and (tag != "article" or parent.main) else ()
    if parent.main and "header" in names:
        names = names - {"header"}
    named = parent.named or tag in _NAMED_TAGS or (tag == "header" and not parent.main) or role in _NAMED_ROLES or bool(names)
    main = parent.main or tag in _MAIN_TAGS or role == "main"
    mark = "#main" if role == "main" else ""
    return _Element(tag, f"{parent.path}/{tag}{mark}{'.' + '.'.join(words) if words else ''}", gone, named, main)


def parse(page: str) -> tuple[list[tuple[str, int, float, str]], list[tuple[str, str]]]:
    """Blocks (path, place, share of links, text) in page order, and elements (path, children) of a page; what its tags rule out is left out."""
    stack = [_Element("", "", False, False, False)]
    blocks, elements, parts = [], [], []
    linked, in_link = 0, -1  # the depth at which a link opened

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1]
            if not e.gone:
                blocks.append((e.path, (NAMED_MAIN if e.main else NAMED) if e.named else MAIN if e.main else PLAIN, linked / len(text), text))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            e = stack.pop()
            if not e.gone:
                elements.append((e.path, " ".join(dict.fromkeys(e.children))))
        if in_link > len(stack):
            in_link = -1

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(html_lib.unescape(text) if "&" in text else text)
            linked += len(text) * (in_link >= 0)

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, text = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW and not ends:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br" or tag in ("wbr",):
            parts.append(" " if tag == "br" else "")
        elif tag in _INLINE:
            if tag == "a":
                in_link = -1 if ends else len(stack)
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    flush()
                    close(depth)
                    break
                if tag == "p" and stack[depth].tag in ("article", "main", "body", "div", "td", "section"):
                    break
        else:
            flush()
            if stack[-1].tag == "p" and tag not in _PARAGRAPH_STAYS:
                close(len(stack) - 1)
            if tag in _CLOSED_BY_SAME or tag in ("dt", "dd"):
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in _CLOSED_BY_SAME[tag]:
                        break
                    if stack[depth].tag in same:
                        close(depth)
                        break
            if tag == "body" and any(e.tag == "head" for e in stack):
                close(next(i for i, e in enumerate(stack) if e.tag == "head"))
            stack[-1].children.append(tag)
            if not text.endswith("/") or tag not in ("path", "use", "rect", "circle"):
                stack.append(_opened(tag, text, stack[-1]))
    add(page[at:])
    flush()
    close(1)
    if any(place == MAIN for _, place, *_ in blocks):
        blocks = [(path, BESIDE if place == PLAIN else place, *rest) for path, place, *rest in blocks]
    return blocks, elements


HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#]*)"
CONTENT, CHILDREN, SEEN = range(3)
_CLASSES = re.compile(r"\.[^/]*")
FOUND = "host long, node long, tags long, parent long, heading int, kind int, value long, copy long, chars long, chance double, pairs double"


def _with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), HOST, 1)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).alias("html"))


class _Keys(dict):
    """Paths to the keys of their node, their path by tags and its parent, and 1 for headings; cleared when many."""

    def __missing__(self, path: str) -> tuple[int, int, int, int]:
        if len(self) > 50_000:
            self.clear()
        tags = _CLASSES.sub("", path)
        self[path] = found = key64(path), key64(tags), key64(tags.rpartition("/")[0]), int(path.endswith(_HEADINGS))
        return found


def _copy(blocks: list[tuple[str, int, float, str]], values: list[int]) -> int:
    """The key of a page's longest blocks, which copies of the page share."""
    longest = sorted(zip((-len(text) for *_, text in blocks), values, strict=True))[:LONGEST]
    return key64(" ".join(str(v) for _, v in longest))


def counted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, tags, parent, heading, distinct pages ``n``, characters ``said``, the share of them that one page alone says, prior
    chance and weight of the node's places, and the entropy of its sequences of children.

    A node is a path by tags, and again a path with classes where it has some; ``tags`` is its path by tags.
    """
    fields = [f.split() for f in FOUND.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys()
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                blocks, elements = parse(page.as_py() or "")
                values = [key64(text) for *_, text in blocks]
                copy = _copy(blocks, values)
                own: dict[tuple, tuple] = {}
                for (path, place, _, text), value in zip(blocks, values, strict=True):
                    node, tags, parent, heading = keys[path]
                    for level in (tags, node) if node != tags else (tags,):
                        at = host, level, tags, parent, heading
                        own[(*at, CONTENT, value, copy)] = len(text), 0.0, 0.0
                        own[(*at, SEEN, 0, copy)] = 0, CHANCE[place], float(PAIRS[place])
                for path, children in elements:
                    if children:
                        _, tags, parent, heading = keys[path]
                        own[(host, tags, tags, parent, heading, CHILDREN, key64(children), copy)] = 0, 0.0, 0.0
                rows += [(*k, *v) for k, v in own.items()]
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    found = _with_host(pages, id_col, url_col, html_col).select("host", "html").mapInArrow(common.tidy(count), FOUND)
    node = ["host", "node", "tags", "parent", "heading"]
    once = found.groupBy(*node, "kind", "value", "copy").agg(F.max("chars").alias("chars"), F.max("chance").alias("chance"), F.max("pairs").alias("pairs"))
    values = once.groupBy(*node, "kind", "value").agg(F.count("*").alias("c"), F.max("chars").alias("chars"), F.sum("chance").alias("chance"), F.sum("pairs").alias("pairs"))

    def over(kind: int, what: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, what))

    sums = values.groupBy(*node).agg(
        over(SEEN, F.col("c")).alias("n"),
        over(SEEN, F.col("chance")).alias("chance"),
        over(SEEN, F.col("pairs")).alias("pairs"),
        over(CONTENT, F.col("chars") * F.col("c")).alias("said"),
        over(CONTENT, F.when(F.col("c") == 1, F.col("chars")).otherwise(0)).alias("own"),
        over(CHILDREN, F.col("c")).alias("m"),
        over(CHILDREN, F.col("c") * F.log("c")).alias("clogc"),
    )
    shape = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("clogc") / F.col("m") / F.log("m"))).otherwise(1.0)
    share = {"chance": F.col("chance") / F.col("n"), "pairs": F.col("pairs") / F.col("n"), "alone": F.col("own") / F.col("said"), "shape": shape}
    return sums.where("n is not null").withColumns(share).select(*node, "n", "said", "alone", "chance", "pairs", "shape")


def _alike(n: Column, alone: Column) -> tuple[Column, Column]:
    """Pairs of pages of a node, and the number of them that say the same, as the share of characters said alone tells.

    Beyond REFERENCE pages the share stands for itself and is no longer carried on.
    """
    pages = F.least(n, F.lit(REFERENCE))
    return pages * (pages - 1) / 2, F.when(n > 1, pages / 2 * -F.log(F.greatest(alone, 1 / (2 * n)))).otherwise(0.0)


def _carried(chance: Column) -> Column:
    """The share that stays alone on a host of REFERENCE pages, if two pages say the same with this chance."""
    return F.exp(-chance * (REFERENCE - 1))


def style_tree(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every style node of a host that holds content: host, node, tags, distinct pages ``n``, ``importance`` as measured on the host
    alone, and ``judged``, the importance after shrinking."""
    nodes = common.saved(counted(pages, id_col, url_col, html_col), "style-nodes")
    by_tags, by_class = nodes.where("node = tags"), nodes.where("node <> tags")
    pairs, alike = _alike(F.col("n"), F.col("alone"))
    weight = F.least(pairs, F.lit(WITNESS_PAIRS))
    seen = F.sum(weight).alias("all_pairs"), F.sum(F.when(pairs > 0, weight * F.least(alike / pairs, F.lit(WITNESS_CHANCE))).otherwise(0.0)).alias("all_alike")

    all_tags = by_tags.groupBy("tags").agg(*seen, F.avg("chance").alias("place"), (F.avg("pairs") * PLACE_PAIRS).alias("held"))
    all_tags = all_tags.select("tags", ((F.col("held") * F.col("place") + F.col("all_alike")) / (F.col("held") + F.col("all_pairs"))).alias("tags_chance"))
    held = F.col("pairs") * OTHER_PAIRS
    by_tags = by_tags.join(all_tags, "tags").withColumn("chance", (held * F.col("tags_chance") + alike) / (held + pairs))
    own_tags = by_tags.select("host", "tags", "tags_chance", F.col("chance").alias("own_chance"), F.col("shape").alias("own_shape"))
    by_class = by_class.join(own_tags, ["host", "tags"]).join(by_class.groupBy("node").agg(*seen), "node").withColumn("shape", F.col("own_shape"))
    others = (PLACE_PAIRS * F.col("tags_chance") + F.col("all_alike")) / (PLACE_PAIRS + F.col("all_pairs"))
    by_class = by_class.withColumn("chance", (held * (others + F.col("own_chance")) / 2 + alike) / (held + pairs))

    def whole(content: Column) -> Column:
        return content * (1 - PRESENTATION) + F.col("shape") * PRESENTATION

    grown = F.pow("alone", F.greatest(F.lit(1.0), (REFERENCE - 1) / (F.col("n") - 1)))
    figures = {"importance": whole(F.when(F.col("n") > 1, grown).otherwise(1.0)), "judged": whole(_carried(F.col("chance")))}
    columns = ["host", "node", "tags", "parent", "heading", "n", "said"]
    by_tags, by_class = (x.withColumns(figures).select(*columns, *figures) for x in (by_tags, by_class))
    branch = by_tags.groupBy("host", "parent").agg((F.sum(F.col("said") * F.col("judged")) / F.sum("said")).alias("branch"))
    judged = F.when(F.col("heading") == 1, F.greatest("judged", "branch")).otherwise(F.col("judged"))
    return by_tags.unionByName(by_class).join(branch, ["host", "parent"]).select("host", "node", "tags", "n", "importance", judged.alias("judged"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and main text of each page."""
    tree = common.saved(style_tree(pages, id_col, url_col, html_col), "style-tree")
    by_tags = tree.where("node = tags").select("host", "tags", "n", (F.col("judged") < threshold).alias("low"))
    most = by_tags.groupBy("host").agg(F.max("n").alias("most"), F.collect_set(F.when(F.col("low"), F.col("tags"))).alias("gone_tags"))
    low = F.col("judged") < threshold
    by_class = tree.where("node <> tags").join(most.select("host", "most"), "host").where(F.col("n") >= F.col("most") * JUDGED)
    by_class = by_class.groupBy("host").agg(F.collect_set(F.when(low, F.col("node"))).alias("gone"), F.collect_set(F.when(~low, F.col("node"))).alias("kept"))
    judged = most.join(by_class, "host", "left").drop("most")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [zlib.compress(json.dumps(parse(p.as_py() or "")[0], ensure_ascii=False).encode("utf-8", "surrogatepass"), 3) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(data, pa.binary())], ["page_id", "url", "host", "blocks"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys()
        for batch in batches:
            texts = []
            for data, *lists in zip(batch.column("blocks"), *(batch.column(c).to_pylist() for c in ("gone_tags", "gone", "kept")), strict=True):
                gone_tags, gone, kept = (frozenset(x or ()) for x in lists)
                out = []
                for path, place, linked, text in json.loads(zlib.decompress(data.as_py()).decode("utf-8", "surrogatepass")):
                    node, tags, *_ = keys[path]
                    low = node in gone or (tags in gone_tags and node not in kept)
                    if not low and (linked <= LINKED or (place == MAIN and path.endswith(_HEADINGS))):
                        out.append(text)
                texts.append("\n\n".join(out))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = _with_host(pages, id_col, url_col, html_col)
    types = dict(rows.dtypes)
    packed = rows.mapInArrow(common.tidy(blocks), f"page_id {types['page_id']}, url {types['url']}, host long, blocks binary")
    joined = packed.join(judged, "host", "left").select("page_id", "url", "blocks", "gone_tags", "gone", "kept")
    return joined.mapInArrow(common.tidy(prune), f"page_id {types['page_id']}, url {types['url']}, text string")


def op10_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
