"""The style tree against a plain one over a whole table, and where it alone decides."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from conftest import sentence

from thermolith.llm import page_text as pt


def plain_tree(pages):
    """(host, path) to distinct pages, measured and judged importance, by plain loops over all pages."""
    said, place, shapes, seen = defaultdict(lambda: defaultdict(set)), defaultdict(dict), defaultdict(lambda: defaultdict(set)), {}
    for url, html in pages:
        host = re.match(pt.HOST, (url or "").lower())
        host = host[1] if host else ""
        blocks, elements = pt.parse(html or "")
        longest = tuple(sorted((-len(t), pt.key64(t)) for *_, t in blocks)[:3])
        for path, spot, _, text in blocks:
            tags = re.sub(r"\.[^/]*", "", path)
            for name in {path, tags}:
                said[host, name][text].add(longest)
                place[host, name][longest] = spot
        for path, children in elements:
            if children:
                shapes[host, re.sub(r"\.[^/]*", "", path)][children].add(longest)

    def figures(key):
        texts = said[key]
        n = len(set().union(*texts.values()))
        total = sum(len(t) * len(c) for t, c in texts.items())
        alone = sum(len(t) for t, c in texts.items() if len(c) == 1) / total
        few = min(n, pt.REFERENCE)
        alike = few / 2 * -math.log(max(alone, 1 / (2 * n))) if n > 1 else 0.0
        spots = place[key].values()
        return n, alone, total, few * (few - 1) / 2, alike, sum(pt.CHANCE[s] for s in spots) / n, sum(pt.PAIRS[s] for s in spots) / n

    nodes = {key: figures(key) for key in said}
    pooled = defaultdict(lambda: [0.0, 0.0, [], []])
    for (_, path), (_, _, _, pairs, alike, chance, held) in nodes.items():
        weight = min(pairs, pt.WITNESS_PAIRS)
        pooled[path][0] += weight
        pooled[path][1] += weight * min(alike / pairs, pt.WITNESS_CHANCE) if pairs else 0.0
        pooled[path][2].append(chance)
        pooled[path][3].append(held)
    first, chance_of, out, branch = {}, {}, {}, defaultdict(lambda: [0.0, 0.0])
    for path, (weight, hits, chances, helds) in pooled.items():
        held = sum(helds) / len(helds) * pt.PLACE_PAIRS
        first[path] = (held * sum(chances) / len(chances) + hits) / (held + weight)
    for (host, path), (n, alone, total, pairs, alike, _, held) in sorted(nodes.items(), key=lambda x: "." in x[0][1]):
        tags, held = re.sub(r"\.[^/]*", "", path), held * pt.OTHER_PAIRS
        prior = first[tags]
        if path != tags:
            weight, hits, *_ = pooled[path]
            prior = ((pt.PLACE_PAIRS * first[tags] + hits) / (pt.PLACE_PAIRS + weight) + chance_of[host, tags]) / 2
        chance = chance_of[host, path] = (held * prior + alike) / (held + pairs)
        count = [len(c) for c in shapes[host, tags].values()]
        m = sum(count)
        shape = -sum(c / m * math.log(c / m) for c in count) / math.log(m) if m > 1 else 1.0
        measured = alone ** max(1.0, (pt.REFERENCE - 1) / (n - 1)) if n > 1 else 1.0
        out[host, path] = n, 0.9 * measured + 0.1 * shape, 0.9 * math.exp(-chance * (pt.REFERENCE - 1)) + 0.1 * shape
        if path == tags:
            branch[host, tags.rpartition("/")[0]][0] += total * out[host, path][2]
            branch[host, tags.rpartition("/")[0]][1] += total
    for (host, path), (n, measured, judged) in out.items():
        if re.search(r"/h[1-6]$", path):
            a, b = branch[host, re.sub(r"\.[^/]*", "", path).rpartition("/")[0]]
            out[host, path] = n, measured, max(judged, a / b)
    return out


def test_the_tree_agrees_with_a_plain_one(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in table.collect()]
    rows += [(10_000 + i, "https://hot.example/", f"<div class='box a{i % 3}'><h2>News {i % 5}</h2><p>{sentence(i // 2, 9)}</p></div><p>Same here</p>") for i in range(250)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = plain_tree([r[1:] for r in rows])
    hosts = {r["host"]: r["name"] for r in spark.createDataFrame([(h,) for h in {h for h, _ in want}], "name string").selectExpr("name", "xxhash64(name) host").collect()}
    found = {(hosts[r["host"]], r["node"]): r for r in pt.style_tree(pages).collect()}
    assert set(found) == {(h, pt.key64(p)) for h, p in want}
    for (h, p), (n, measured, judged) in want.items():
        r = found[h, pt.key64(p)]
        assert r["n"] == n and r["importance"] == pytest.approx(measured) and r["judged"] == pytest.approx(judged), (h, p)


def test_the_tree_alone_finds_articles_without_names(spark, monkeypatch):
    """sf0.1 with article renamed to div and random classes: at least 95 % as with names; without a measure none."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    want = {r["page_id"]: r["text"] for r in pt.extract(table).collect()}
    draw = random.Random(3)
    rows = []
    for r in table.collect():
        html = re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        rows.append((r["page_id"], r["url"], re.sub(r'class="[^"]*"', lambda _: f'class="{"".join(draw.choices("qwzxjkv", k=7))}"', html)))
    renamed = spark.createDataFrame(rows, table.schema).repartition(4)
    got = {r["page_id"]: r["text"] for r in pt.extract(renamed).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    monkeypatch.setattr(pt, "_alike", lambda n, alone: (n * 0.0, n * 0.0))  # no measure: the priors of places decide
    without = {r["page_id"]: r["text"] for r in pt.extract(renamed).collect()}
    assert sum(without[i] == want[i] for i in want) <= 0.05 * len(want)


def test_links_around_blocks_and_ties(spark):
    html = "<body><a href='/x'><div>Whole block is a link</div></a><p>Text with an <a href='/y'>open link</p><p>Plain words</p></body>"
    rows = [(1, "http://l.example", html), (1, "http://l.example", html), (2, None, f"<p>{'word ' * 300_000}</p>")]
    found = pt.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in found if r["page_id"] == 1] == ["Text with an open link\n\nPlain words"] * 2
    assert [len(r["text"]) for r in found if r["page_id"] == 2] == [1_499_999]
    half = "<p>1234<a>5678</a></p>"  # a share of links that ties with the threshold stays
    assert [r["text"] for r in pt.extract(spark.createDataFrame([(3, "u", half)], "page_id long, url string, html string")).collect()] == ["12345678"]
