"""Search, mixing, chat, sharding, quality, pages and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import HARD, LONG, sentence
from pyspark.sql import functions as F

from thermolith.llm import chat, mixing, neighbours, page_text, quality, sharding
from thermolith.llm.queries import ORACLE_SQL, QUERIES

# Nearest neighbours


def brute_nearest(rows, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in good:
        if q % 100 == 0:
            far = sorted((math.dist(v, w), i) for i, w in good if i != q)
            out[q] = [(i, d) for d, i in far[:k]]
    return out


def test_neighbours_of_hard_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(100)] + [(100, rows[99][1]), (2000, [1.0, 1.0, 1.0])]
    rows += [(900, [2.0, 2.0, 2.0])] * 40 + [(901 + i, [2.0, 2.0, 2.0]) for i in range(15)]
    rows += [(3000, None), (3100, [0.0, 0.0, 0.0]), (3200, [1.0, None, 2.0]), (3300, [float("nan"), 1.0, 1.0]), (3400, [float("inf"), 1.0, 1.0]), (3500, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], "vec_id bigint, embedding array<double>, rep int, score double, block int")
    found = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, block_rows=64, pairs_each=20_000, asked=1e9).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 10)
    assert set(found) == set(want)
    for q, near in found.items():
        assert [n for n, *_ in sorted(near)] == list(range(1, 11))
        assert [(i, pytest.approx(d)) for _, i, d in sorted(near)] == want[q]
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id in (100, 101)"), F.col("vec_id") % 100 == 0).count() == 1


def plain_search(table, k=10):
    """Queries' nearest rows by brute force, and the rows."""
    import pyarrow.dataset as ds

    rows = ds.dataset(f"{table}/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
    ids, vectors = rows.column(0).to_numpy(), np.array(rows.column(1).to_pylist())
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        out[int(ids[q])] = [(int(ids[i]), far[i]) for i in np.lexsort((ids, far))[:k]]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    """The query as registered, against brute force."""
    want = plain_search(f"/root/testdata/sf{sf}")
    found = {}
    for r in QUERIES["op2_prefix_forest"](spark, f"/root/testdata/sf{sf}").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    for q, near in found.items():
        near.sort()
        exact = dict(want[q])
        assert [r for r, *_ in near] == list(range(1, 11)) and [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in near if i in exact)
        hits += len({i for _, i, _ in near} & set(exact))
    assert hits >= 0.9 * 10 * len(want)


def test_the_forest_looks_at_a_share_that_falls(spark):
    shares = []
    for sf in ("0.01", "0.1"):
        rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").selectExpr("vec_id rep", "cast(embedding as array<double>) v")
        n = rows.count()
        named = neighbours.candidates(rows, rows.where("rep % 100 = 0"), n, 10).collect()
        seen: dict[int, set] = {}
        for r in named:
            seen.setdefault(r["rep"], set()).update(np.frombuffer(r["ids"], np.int64).tolist())
        shares.append(np.mean([len(x) for x in seen.values()]) / n)
    assert shares[1] < 0.8 * shares[0] < 0.5, shares


def test_ranges_by_prefix_and_in_parts_find_the_same(spark, monkeypatch):
    """Sorted arrays dealt by prefix, by parts of a prefix and in several chunks hold what one array holds, down to their prefix."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.02  # a third of all rows about one place
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*near, *rng.normal(size=(300, 8))])], "rep long, v array<double>").repartition(4)
    queries = rows.where("rep % 9 = 0")

    def pairs(**options):
        out = neighbours.candidates(rows, queries, 450, 5, asked=60.0, blocks=3, **options).collect()
        return {(r["rep"], i) for r in out for i in np.frombuffer(r["ids"], np.int64).tolist()}

    whole = pairs()
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    dealt = pairs(range_rows=40)
    assert dealt <= whole and len(dealt) > 0.5 * len(whole)
    found = {"rep": [], "near": []}
    for r in neighbours.nearest(rows.selectExpr("rep vec_id", "v embedding"), F.col("vec_id") % 9 == 0, 5, asked=1.0, range_rows=40).collect():
        found["rep"].append(r["query_id"])
    assert Counter(found["rep"]) == {i: 5 for i in range(0, 450, 9)}  # whoever finds too few ascends to the root


# Mixing


def check_schedule(rows, blocks, weights):
    rows = sorted(rows, key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(sum(blocks)))
    done, segments = np.zeros(len(blocks)), mixing.fluid_segments(blocks, weights)
    for r in rows:
        assert r["release"] <= r["slot"] < r["due"]
        assert r["block"] == done[r["source"]]
        done[r["source"]] += 1
        time, start, rate = [s for s in segments if s[1] <= r["slot"] + 1][-1]
        share = np.minimum(blocks, np.array(weights) * (time + (r["slot"] + 1 - start) / rate))
        assert np.abs(done - share).max() < 1


@pytest.mark.parametrize("blocks,weights,epoch", [([7, 3, 11], [1, 1, 1], 4), ([50, 200, 33, 1], [0.5, 0.2, 0.29, 0.01], 64), ([90, 30, 40, 9, 5], [5, 1, 3, 2.5, 1], 16), ([5], [1], 3), ([1, 4000, 300], [0.0003, 0.9, 0.0997], 64)])
def test_every_block_in_its_window(spark, blocks, weights, epoch):
    check_schedule(mixing.schedule(spark, blocks, weights, epoch).collect(), blocks, weights)


def test_many_sources_and_a_cut(documents):
    pairs = [(i, "t", f"s{i % 700}") for i in range(2100)]
    rows = mixing.mix(documents(pairs), block_rows=2).collect()
    assert sorted(r["position"] for r in rows) == list(range(2100)) and Counter(r["doc_id"] for r in rows) == Counter(range(2100))
    pairs = [(i, "t", "a" if i < 900 else "b") for i in range(1000)]
    frame = documents(pairs)
    cut = mixing.mix(frame, {"a": 1.0, "b": 1.0}, block_rows=4, whole=False).collect()  # b ends after its 25 blocks, a has as many by then
    assert sorted(r["position"] for r in cut) == list(range(200)) and Counter(r["source"] for r in cut) == {"a": 100, "b": 100}
    assert {(r["doc_id"], r["position"]) for r in cut} < {(r["doc_id"], r["position"]) for r in mixing.mix(frame, {"a": 1.0, "b": 1.0}, block_rows=4).collect()}


def test_mix_places_all_rows(hard, nothing, documents):
    rows = mixing.mix(hard, {"a": 2.0, "b": 1.0, "unused": 5.0}, block_rows=2, epoch_slots=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter((i, s) for i, _, s in HARD)
    assert sorted(r["position"] for r in rows) == list(range(len(HARD)))
    assert mixing.mix(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(hard, {"a": 0})
    plain = documents([(i, "t", "big" if i % 3 else "small") for i in range(900)])
    order = [r["source"] for r in sorted(mixing.mix(plain, {"big": 1, "small": 1}, block_rows=4).collect(), key=lambda r: r["position"])]
    assert abs(order[:400].count("big") - 200) <= 4
    mixed = mixing.in_mixed_order(plain, {"big": 1, "small": 1})
    assert mixed.columns == plain.columns and mixed.count() == 900


# Chat


def test_chat_with_all_kinds_of_parts(spark):
    part = dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages"))
    turns = [
        (1, 1, "assistant", [part | {"type": "text", "text": "see <image:0> \\l </turn>"}, part | {"type": "image", "ref": "a.png", "width": 28, "height": 15}]),
        (1, 0, "user", [part | {"type": "audio", "ref": "b.wav", "seconds": 1.5}, part | {"type": "text", "text": "\\s>"}, part | {"type": "document", "ref": "c.pdf", "pages": 2}]),
        (1, None, None, None),
        (2, 0, "assistant", [part | {"type": None, "text": None}]),
        (None, 0, "us<er>", [part | {"type": "text", "text": "x" * 100_000}]),
    ]
    frame = spark.createDataFrame([(*t, "clash", 5) for t in turns], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>, formatted string, start int")
    out = {r["conv_id"]: r for r in chat.format_chat(frame).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = out[1]
    assert one["formatted"] == "<turn:></turn><turn:user><audio:0>\\ss\\g<document:1></turn><turn:assistant>see \\limage:0\\g \\sl \\l/turn\\g<image:2></turn>"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "audio", "b.wav", 38), (1, "document", "c.pdf", 1024), (2, "image", "a.png", 4)]
    assert one["attachment_tokens"] == 1066
    assert one["loss"] == "see <image:0> \\l </turn><image:2>"
    assert [tuple(t) for t in one["turns"]][2] == ("assistant", one["loss"])
    assert out[2]["formatted"] == "<turn:assistant></turn>" and out[2]["loss"] == ""
    assert tuple(out[None]["turns"][0]) == ("us<er>", "x" * 100_000)
    assert chat.format_chat(frame.where("false")).count() == 0


def test_chat_plan_has_no_python(spark, sf_dir):
    for name in ("op5_chat_parts", "op3_pfair_mixing"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD")), plan


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, sf_dir), connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in found.collect()) == sorted(tuple(map(str, r)) for r in wanted.fetchall())


# Sharding


def test_shards_are_even_and_slots_gapless(hard, nothing, documents):
    for pairs, frame in ((HARD, hard), ([(i // 3, "t", "a") for i in range(1000)], None)):
        rows = sharding.assign_shards(frame or documents(pairs), shards=7).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in pairs)
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(s, ())) for s in range(7)]
        assert max(counts) - min(counts) <= 1
    assert sharding.assign_shards(nothing).count() == 0


def test_most_documents_stay_home_and_few_move(documents):
    frame = documents([(i, "t", "a") for i in range(3000)])
    small, large = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(frame, n).collect()} for n in (8, 9))
    rows = sharding.assign_shards(frame, 8).collect()
    assert np.mean([r["shard"] == r["home"] for r in rows]) > 0.8
    assert np.mean([small[i] != large[i] for i in small]) < 0.45  # 8 in 9 move where shards are the remainder


def test_one_more_shard_moves_less_than_a_tenth(documents):
    frame = documents([(i, "t", "a") for i in range(10_000)])
    small, large = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(frame, n).collect()} for n in (24, 25))
    assert 0.04 <= np.mean([small[i] != large[i] for i in small]) < 0.1


def test_walk_fills_clockwise():
    assert sharding.walk([5, 1, 0], [0, 1, 2], [2, 2, 2]) == [(0, 0, 2, 0), (1, 0, 1, 1), (0, 2, 3, 1), (0, 3, 5, 2)]


# Quality


def test_quality_of_hard_documents(spark, hard, nothing):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, 5), (None, 1), (4, 0), (6, None)], "doc_id bigint, quality int")
    stats = quality.measured(hard)
    assert all(len(r["stats"]) == len(quality.STATISTICS) and all(map(math.isfinite, r["stats"])) for r in stats.collect())
    rows = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in HARD) and all(0 <= r["score"] <= 1 for r in rows)
    blank = quality.fit(stats, labels.where("false"))
    assert {r["score"] for r in quality.scored(stats, blank).collect()} == {0.5}
    assert quality.scored(quality.measured(nothing), blank).count() == 0
    assert quality.keep_quality(hard, labels.where("false")).collect() == hard.collect()


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op8_fourier_quality"](spark, d).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([q == r["predicted"] for q, r in held]) >= 0.97


def test_summed_normal_equations_equal_one_solution(spark, documents):
    """Weights from sums by task and fold against ridge regression on all rows at once."""
    pairs = [(i, sentence(i, 5 + i % 40) + (" !!! ###" * (i % 7) if i % 2 else ""), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    stats = quality.measured(documents(pairs).repartition(7))
    model = quality.fit(stats, labels, features=32)
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    x = quality.fourier(np.array([quality.statistics(pairs[i][1]) for i in learned]), model)
    y = np.array([1.0 - i % 2 for i in learned])
    ridge = quality.RIDGE * len(learned) / 32 * np.diag([*np.ones(32), 0.0]) + 1e-9 * np.eye(33)
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + ridge, x.T @ y), rtol=1e-6, atol=1e-8)


def test_isotonic_pools():
    raw, chance = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert raw.tolist() == [0.0, 1.5, 3.0] and chance.tolist() == [0.0, 0.5, 1.0]


# Pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><nav><ul><li><a href=/>Home</a><li>Two</ul></nav>
<div id="cookie-notice">We use cookies</div><article class="post"><header><h1>A &amp; B&nbsp;C</h1></header><p>one <b>two<br>three
<p>four &lt;p&gt; &#233; &am</p><script>var x="</p><p>no";</script><!-- <p>no</p> --><aside>side</aside><form><p>mail</p></form>
<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><div class=ad>buy</div></article><section class="comments"><p>me too</p></section><footer>end</footer>"""


def texts(frame):
    return {r["page_id"]: r["text"] for r in page_text.extract(frame).collect()}


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "page_id bigint, url string, html string, host int, node int, blocks string")


def test_page_blocks(spark):
    rows = [(1, "http://h.example/1", PAGE), (2, None, None), (3, "odd", ""), (4, "http://h.example/2", "just text < 5 & <unknown>more"), (5, "x", "<p>a<p " + "b" * 50_000 + ">c"), (6, "x", "<" * 5000)]
    found = texts(pages(spark, rows))
    assert found[1] == "A & B C\n\none two three\n\nfour <p> é &am\n\nx\n\ny\n\n1\n\n2"
    assert found[2] == found[3] == ""
    assert found[4] == "just text < 5 &\n\nmore" and found[5] == "a\n\nc" and found[6] == "<" * 5000
    assert page_text.extract(pages(spark, [])).count() == 0


def test_branches_that_repeat_on_a_host_go(spark):
    def page(i):
        return f"<body><div><p>Welcome to our site</p></div><div class='x{i}'><div>{sentence(i, 30)}</div></div><section>Call {i % 2}</section></body>"

    rows = [(i, f"https://www.site.example/{i}", page(i)) for i in range(40)] + [(99, "https://other.example/", page(99))]
    found = texts(pages(spark, rows))
    assert all(found[i] == sentence(i, 30) for i in range(40))
    assert found[99] == f"Welcome to our site\n\n{sentence(99, 30)}\n\nCall 1"  # one page cannot tell
    copies = [(i, "https://c.example/a", "<article><p>the same words</p></article>") for i in range(30)]
    assert set(texts(pages(spark, copies)).values()) == {"the same words"}


def test_copies_count_once(spark):
    def page(i, ad):
        return f"<body><div class='ad'>{ad}</div><h1>Title {i}</h1>{''.join(f'<p>{sentence(20 * i + k, 12)}</p>' for k in range(10))}<div><p>All rights reserved</p><p>All rights reserved</p></div></body>"

    def want(i):
        return "\n\n".join([f"Title {i}", *(sentence(20 * i + k, 12) for k in range(10))])

    rows = [(i, f"https://c.example/{i}", page(i if i < 28 else 0, i)) for i in range(100)]  # 73 of 100 are one page, each with its own advert
    found = texts(pages(spark, rows))
    assert all(found[i] == want(i if i < 28 else 0) for i in range(100))
    few = texts(pages(spark, [(i, "https://f.example/", page(max(0, i - 2), 0)) for i in range(4)]))  # two pages, no measure
    assert all(t.startswith("Title") for t in few.values())


def test_importance_decides_inside_and_beside_articles(spark):
    def page(i):
        return f"""<body><div class="intro"><p>{sentence(1000 + i, 20)}</p></div><div class="where"><p>You are reading our site</p></div>
<article><header class="entry-header"><h1><a href="/{i}">Title {i}</a></h1></header><p>{sentence(i, 30)}</p><div class="box"><p>Reprinted by kind permission</p></div>
<p><a href="/next">Read on</a></p></article></body>"""

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(20)] + [(99, "https://alone.example/", page(99))]
    found = texts(pages(spark, rows))
    assert all(found[i] == f"{sentence(1000 + i, 20)}\n\nTitle {i}\n\n{sentence(i, 30)}" for i in range(20))
    assert found[99] == f"Title 99\n\n{sentence(99, 30)}\n\nReprinted by kind permission"  # one page is no measure; its tags decide


def test_importance_of_nodes(spark):
    rows = [(i, "http://a.example", f"<body><div>{i}</div><p>same</p></body>") for i in range(16)]
    tree = page_text.style_tree(pages(spark, rows)).collect()
    by_node = {r["node"]: r for r in tree}
    assert by_node[page_text.key64("/body/div")]["importance"] == pytest.approx(1.0)
    assert by_node[page_text.key64("/body/p")]["importance"] == pytest.approx(0.1)


# Pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.saved(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_equals_brute_force(spark, documents, tmp_path):
    """Every stage against plain code on a small table with labels, copies, near copies, nulls and clashing columns."""
    import corpus_pipeline
    from test_dedup import brute, normal
    from tokenizers import Tokenizer

    from thermolith.llm import tokens

    good = [(i, sentence(i, 30 + i % 50), "abc"[i % 3]) for i in range(240)]
    bad = [(1000 + i, "!!! ### $$$ " * (3 + i % 5) + f"x{i}", "abc"[i % 3]) for i in range(120)]
    copies = [(2000 + i, good[i][1].replace(" ", "\n") + " " * (i % 3), "a") for i in range(30)]
    near = [(3000 + i, sentence(i, 80).rsplit(" ", 1)[0] + f" end{i}", "b") for i in (49, 99, 149, 199)]
    pairs = [*good, *bad, *copies, *near, (4000, LONG, None), (4001, None, "a"), (4002, "", "c")]
    docs = documents(pairs).repartition(3)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in [*good, *bad]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, outputs = {i: (i, t, s) for i, t, s in pairs}, []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.saved(stage(spark, docs, str(tmp_path)))
        outputs.append(docs)
    kept = [[r["doc_id"] for r in x.collect()] for x in outputs]
    assert all(x.columns == documents([]).columns for x in outputs[:4])

    model = quality.fit(quality.measured(documents([p for p in pairs if p[0] < 2000])), labels)
    want = {i for i, (_, t, _) in rows.items() if model.score(np.array([quality.statistics(t or "")]))[0] >= 0.5}
    assert set(kept[0]) == want and len(kept[0]) == len(want) and len(want & set(range(240))) > 230 and len(want & set(range(1000, 1120))) < 10
    groups: dict[str, list] = {}
    for i in want:
        groups.setdefault(normal(rows[i][1]), []).append(i)
    want = {min(g, key=lambda i: (-len(rows[i][1] or ""), i)) for g in groups.values()}
    assert sorted(kept[1]) == sorted(want)
    want = {c for _, c, _ in brute([rows[i] for i in sorted(want)])}
    assert sorted(kept[2]) == sorted(want) and not want & {3049, 3099, 3149, 3199}
    places = {r["doc_id"]: r["position"] for r in mixing.mix(outputs[2], corpus_pipeline.WEIGHTS).collect()}
    assert sorted(kept[3]) == sorted(want)
    by_file = outputs[3].select("doc_id", F.input_file_name().alias("f")).collect()
    files: dict[str, list] = {}
    for r in by_file:
        files.setdefault(r["f"], []).append(places[r["doc_id"]])
    spans = sorted((x[0], x[-1]) for x in files.values())
    assert all(x == sorted(x) for x in files.values()) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    library = Tokenizer.from_file(tokens.default_vocabulary())
    pieces = {(r["doc_id"], r["piece"]): r["length"] for r in outputs[4].collect()}
    lengths = {i: len(library.encode(rows[i][1] or "", add_special_tokens=False).ids) + 1 for i in want}
    assert pieces == {(i, k): min(2048, n - 2048 * k) for i, n in lengths.items() for k in range(-(-n // 2048))}
    filled: dict[int, list] = {}
    for r in outputs[4].collect():
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048


def test_sequences_follow_the_mixture(spark, documents, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline.packing, "STRETCH_DOCS", 256)
    sizes = {"a": 1600, "b": 400, "c": 100}
    pairs = [(i, sentence(i, 20 + (90 if s == "b" else 0) + i * 37 % 60), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = corpus_pipeline.common.saved(corpus_pipeline._mixing(spark, documents(pairs).repartition(5), ""))
    packed = corpus_pipeline._packing(spark, docs.orderBy(F.rand(1)), "").collect()
    source = {i: s for i, _, s in pairs}
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(list(source))
    places = {r["doc_id"]: r["position"] for r in mixing.mix(documents(pairs)).collect()}
    assert all(r["stretch"] == places[r["doc_id"]] // 256 for r in packed)
    packed.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    order = [r["doc_id"] for r in packed if r["piece"] == 0]
    by_place = sorted(places, key=places.get)
    for at in range(256, len(order), 256):
        have, want = Counter(source[i] for i in order[:at]), Counter(source[i] for i in by_place[:at])
        assert all(abs(have[s] - want[s]) <= 0.1 * at for s in sizes), (at, have, want)
    assert max(r["stretch"] for r in packed) == len(order) // 256 and len({r["sequence_id"] >> 32 for r in packed}) > 4


def test_a_hot_arc_is_ranked_in_parts(documents, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED_TOGETHER", 50)
    rows = sharding.assign_shards(documents([(None if i % 2 else i, "t", "a") for i in range(1000)]).repartition(4), shards=6).collect()
    slots: dict[int, list] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert Counter(r["doc_id"] is None for r in rows) == {True: 500, False: 500}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {166, 167}
