"""Codecs, messages, formats, streams, the HTTP source and the command line."""

from __future__ import annotations

import json
import struct
import threading
import zlib
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermolith import __main__ as cli
from thermolith.functions.durations import duration_ms
from thermolith.functions.formats import HEADERS, parse_clusters
from thermolith.operators import saturation, stencil, tiles
from thermolith.plans import monitoring
from thermolith.sources import http_batches, messages, msgpack, results, tiff
from thermolith.sources.topics import BATCHES, RESULTS, Topics, latest_bench_id, query_of
from thermolith.sources.waiting import retried, wait_for_port, wait_until
from thermolith.streaming.meters import fold, stream_throughput
from thermolith.streaming.running import drained, stop_when_idle

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=300),
    lambda inner: st.lists(inner, max_size=20) | st.dictionaries(st.text(max_size=5), inner, max_size=20),
    max_leaves=15,
)


@given(VALUES)
@settings(deadline=None)
def test_msgpack_round_trip(value):
    assert msgpack.unpack(msgpack.pack(value)) == value


def test_msgpack_long_values_and_damage():
    for value in ("x" * 70_000, b"y" * 70_000, list(range(70_000)), {str(i): i for i in range(70_000)}):
        assert msgpack.unpack(msgpack.pack(value)) == value
    assert msgpack.unpack(b"\xca\x3f\x80\x00\x00") == 1.0
    assert msgpack.unpack(b"\xd4\x01\x07") == b"\x07"
    for bad in (b"", b"\xc1", b"\xa5abc", msgpack.pack(1) + b"\x00", b"\xa1\xff"):
        with pytest.raises(msgpack.MessagePackError):
            msgpack.unpack(bad)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("strips", [None, 1, 3])
def test_tiff_round_trip(order, strips):
    image = np.random.default_rng(1).integers(0, 65536, (7, 5)).astype("<u2")
    assert (tiff.decode(tiff.encode(image, order, strips)) == image).all()


def packed_bits(data):
    out = bytearray()
    for i in range(0, len(data), 128):
        part = data[i : i + 128]
        out += bytes((257 - len(part), part[0])) if len(set(part)) == 1 and len(part) > 1 else bytes((len(part) - 1,)) + part
    return bytes(out) + b"\x80"


def packed_lzw(data):
    """Codes as the format writes them: a table that starts again when full, widths that grow one code early."""
    bits, table, width, at = [], {}, 9, 0

    def put(code):
        bits.append(f"{code:0{width}b}")

    put(256)
    held = b""
    for i in range(len(data)):
        byte = data[i : i + 1]
        if len(held) == 0 or held + byte in table:
            held += byte
            continue
        put(table.get(held, held[0]))
        table[held + byte] = 258 + len(table)
        width = max(9, (258 + len(table)).bit_length())
        if len(table) == 4094 - 258:
            put(256)
            table, width = {}, 9
        held = byte
    if held:
        put(table.get(held, held[0]))
        table[object()] = None
        width = max(9, (258 + len(table)).bit_length())
    put(257)
    text = "".join(bits)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def written_tiff(blocks, tags, order="<"):
    """A file from its compressed blocks and short or long tags."""
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags = {**tags, (324 if 322 in tags else 273): offsets, (325 if 322 in tags else 279): [len(b) for b in blocks]}
    lists, entries, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, values in sorted(tags.items()):
        values = values if isinstance(values, list) else [values]
        body = struct.pack(f"{order}{len(values)}I", *values)
        if len(body) > 4:
            lists, body = lists + body, struct.pack(f"{order}I", after + len(lists))
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + body
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    return head + b"".join(blocks) + struct.pack(f"{order}H", len(tags)) + entries + bytes(4) + lists


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize(("compression", "pack"), [(1, bytes), (32773, packed_bits), (5, packed_lzw), (8, zlib.compress), (32946, zlib.compress)])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_compressed_and_tiled(order, bits, predictor, compression, pack, tile):
    rng = np.random.default_rng(bits)
    image = rng.integers(0, 1 << bits, (70, 75))
    image[20:40] = 7  # runs
    down, across = tile or (11, 75)
    blocks = []
    for y in range(0, 70, down):
        for x in range(0, 75, across):
            part = image[y : y + down, x : x + across]
            if tile:
                part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=0) % (1 << bits)
            blocks.append(pack(part.astype(np.uint8 if bits == 8 else f"{order}u2").tobytes()))
    tags = {256: 75, 257: 70, 258: bits, 259: compression, 262: 1, 277: 1, 317: predictor} | ({322: across, 323: down} if tile else {278: down})
    data = written_tiff(blocks, tags, order)
    assert (tiff.decode(data) == image).all()
    with pytest.raises(tiff.TiffError):
        tiff.decode(written_tiff([b[: len(b) // 3] for b in blocks], tags, order))
    with pytest.raises(tiff.TiffError):
        tiff.decode(written_tiff(blocks, tags | {259: 7}, order))


def test_tiff_with_bands():
    pixels = np.arange(4 * 5 * 3).reshape(4, 5, 3)
    together = written_tiff([zlib.compress(pixels.astype("<u2").tobytes())], {256: 5, 257: 4, 258: [16] * 3, 259: 8, 277: 3, 278: 4})
    apart = written_tiff([pixels[:, :, b].astype("<u2").tobytes() for b in range(3)], {256: 5, 257: 4, 258: [16] * 3, 259: 1, 277: 3, 278: 4, 284: 2})
    assert (tiff.decode(together) == pixels[:, :, 0]).all() and (tiff.decode(apart) == pixels[:, :, 0]).all()


def test_tiff_damage():
    good = tiff.encode(np.ones((4, 4), np.uint16))
    for bad in (b"", b"II", b"XX" + good[2:], good[:20], good[:-3]):
        with pytest.raises(tiff.TiffError):
            tiff.decode(bad)


IMAGE = np.arange(6, dtype=np.uint16).reshape(2, 3)
BAD = {
    "empty": b"",
    "null": None,
    "no map": msgpack.pack([1]),
    "missing": msgpack.pack({"batch_id": 1}),
    "null field": msgpack.pack({"batch_id": 1, "print_id": None, "tile_id": 1, "layer": 1, "tif": b""}),
    "no number": messages.write_message("1.0", "p", 1, 1, IMAGE),
    "bad text": msgpack.pack({"batch_id": 1, "print_id": "p", "tile_id": 1, "layer": 1, "tif": "***"}),
    "no image": msgpack.pack({"batch_id": 1, "print_id": "p", "tile_id": 1, "layer": 1, "tif": b"xx"}),
    "odd image": msgpack.pack({"batch_id": 1, "print_id": "p", "tile_id": 1, "layer": 1, "tif": 5}),
}


@pytest.mark.parametrize("name", BAD)
def test_malformed_messages(spark, name):
    with pytest.raises(messages.MessageError):
        messages.read_message(BAD[name])
    rows = [(bytearray(messages.write_message("7", "p", 2, "3", IMAGE)),), (BAD[name] and bytearray(BAD[name]),)]
    frame = spark.createDataFrame(rows, "value binary")
    kept = messages.decode_messages(frame, mode="DROPMALFORMED").collect()
    assert [(r["batch_id"], r["print_id"], r["tile_id"], r["layer"], r["height"], r["width"]) for r in kept] == [(7, "p", 2, 3, 2, 3)]
    with pytest.raises(Exception, match="MessageError"):
        messages.decode_messages(frame).collect()


def test_durations(spark):
    texts = [("5s914ms67µs586ns", 5914.067586), ("2sÂ1µs", None), ("85ms655µs156ns", None), ("3s", 3000.0), (None, None), ("1s5ns", 1000.000005)]
    found = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(duration_ms(F.col("t")).alias("ms")).collect()
    for (t, want), r in zip(texts, found, strict=True):
        if t != "2sÂ1µs":
            assert r["ms"] == want if want is None else r["ms"] == pytest.approx(want)
    assert found[1]["ms"] == pytest.approx(2000.001)


def test_cluster_line_round_trip(spark):
    frame = spark.sql("select array(named_struct('x', 498.255D, 'y', 129.25D, 'count', 87), named_struct('x', 1.0D, 'y', 2.0D, 'count', 5)) c")
    from thermolith.functions.formats import clusters_text

    row = frame.select(clusters_text(F.col("c")).alias("t")).select("t", parse_clusters(F.col("t")).alias("c")).first()
    assert row["t"] == "[{'x': 498.26; 'y': 129.25; 'count': 87}, {'x': 1.00; 'y': 2.00; 'count': 5}]"
    assert [tuple(c) for c in row["c"]] == [(498.26, 129.25, 87), (1.0, 2.0, 5)]


def test_stamps(spark):
    from thermolith.operators.measurements import latency_ms, stamped

    row = stamped(stamped(spark.range(1), "a"), "b").select(latency_ms(F.col("a"), F.col("b")).alias("ms")).first()
    assert row["ms"] == 0


def test_names_and_headers():
    assert [query_of(t) for t in ("query1-results", "my-query3-x", "other")] == ["query1", "query3", None]
    assert output_headers() == ["seq_id", "print_id", "tile_id", "P1", "dP1"]
    assert results.output_name("query1-results", datetime(2025, 6, 28, 10, 54, 17)) == "query1_20250628_105417.csv"
    assert results.output_name("query3-results", datetime(2025, 7, 2), "jsonl") == "query3_20250702_000000.jsonl"


def output_headers():
    return HEADERS["query2"][:5]


def test_run_log(spark, tmp_path):
    lines = [{"count": 160, "missing": 0, "throughput": t, "latency_mean": "1s", "latency_min": "2ms", "latency_max": "3s", "latency_p99": "3s1ms"} for t in (1.0, 3.0)]
    (tmp_path / "a.txt").write_text("\n".join(map(json.dumps, lines)))
    from thermolith.operators.measurements import run_statistics

    log = results.read_run_log(spark, str(tmp_path / "a.txt"))
    row = run_statistics(log, "file", ["throughput", "latency_p99"]).first()
    assert (row["runs"], row["throughput_mean"], row["throughput_stdev"], row["latency_p99_max"]) == (2, 2.0, 1.414214, 3001.0)
    out = str(tmp_path / "stats")
    results.write_csv(run_statistics(log, "file", ["throughput"]).withColumn("file", F.lit("a")), out)
    assert results.read_statistics(spark, out, ["a"], {"a": "Run A"}).first()["file"] == "Run A"


def test_latest_bench_id(spark):
    rows = [(0, 1, b"a"), (0, 2, b"b"), (2, 0, b"c")]
    frame = spark.createDataFrame([(p, o, bytearray(v)) for p, o, v in rows], "partition int, offset bigint, value binary")
    assert latest_bench_id(frame).first()["bench_id"] == "c"


def test_waiting():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert retried(call, 3, 0, lambda s: None) == "done"
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0, lambda s: None)
    assert not wait_for_port("127.0.0.1", 1, 0.01, 0.1, 0.05)
    assert wait_until(lambda: True) and not wait_until(lambda: False, 0.01, 0.02)


def test_meter():
    assert fold([0, 500, 999, 1000, 1100, 2500], None, 0) == ([(1000, 4.0), (2500, 2 / 1.5)], 2500, 0)


@pytest.fixture
def topic(spark, sf_dir, tmp_path):
    """The first 160 tiles as messages, and their tiles."""
    packed = tiles.packed(tiles.read_tiles(spark, sf_dir).where("batch_id < 160"))
    topics = Topics(str(tmp_path / "topics"))
    topics.write(messages.encode_messages(packed), BATCHES)
    return topics, packed


def lines(spark, topics, query):
    return sorted(r["v"] for r in topics.read(spark, f"query{query}-results").select(F.col("value").cast("string").alias("v")).collect())


def test_batch_and_stream_lines_agree(spark, topic, tmp_path):
    topics, packed = topic
    by_stream = Topics(str(tmp_path / "stream"))
    monitoring.run_batch(messages.decode_messages(topics.read(spark, BATCHES)), topics)
    for q in monitoring.run_stream(messages.decode_messages(topics.read_stream(spark, BATCHES)), by_stream, str(tmp_path / "checkpoint")):
        q.awaitTermination()
    for query in (1, 2, 3):
        assert lines(spark, topics, query) == lines(spark, by_stream, query)
        assert len(lines(spark, topics, query)) == 160
    text = lines(spark, topics, 2)
    assert sum(t.endswith(",(),,(),,(),,(),,(),") for t in text) >= 32
    saturated = {r["batch_id"]: r["saturated"] for r in saturation.saturation_arrow(packed).collect()}
    assert all(int(t.split(",")[3]) == saturated[int(t.split(",")[0])] for q in (1, 3) for t in lines(spark, topics, q))
    clusters = [r for r in results.cluster_rows(topics.read(spark, "query3-results")).collect() if r["centroids"]]
    assert clusters and all(c["count"] >= 5 for r in clusters for c in r["centroids"])


def test_command_line(spark, topic, tmp_path, monkeypatch):
    topics, _ = topic
    monkeypatch.setattr(cli, "session", lambda metrics=False: spark)
    cli.main(["run", "--folder", topics.folder, "--queries", "q1,q2", "--profile"])
    cli.main(["drain", "--folder", topics.folder, "--output", str(tmp_path / "out"), "--short"])
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [f.split("_")[0] for f in files] == ["query1", "query2"]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / files[0]))
    assert rows.columns == HEADERS["query1"] and rows.count() == 160
    with pytest.raises(SystemExit):
        cli.main(["run", "--folder", "x", "--servers", "y"])


def test_all_at_once_over_the_first_messages(spark, topic, tmp_path, monkeypatch):
    old, _ = topic
    topics = Topics(str(tmp_path / "topics"))
    topics.write(old.read(spark, BATCHES), BATCHES)
    monkeypatch.setattr(cli, "session", lambda metrics=False: spark)
    cli.main(["all", "--folder", topics.folder, "--output", str(tmp_path / "out"), "--limit", "48"])
    files = {p.name.split("_")[0]: p for p in (tmp_path / "out").iterdir()}
    assert sorted(files) == ["query1", "query2", "query3"]
    assert spark.read.option("header", True).csv(str(files["query1"])).count() == spark.read.json(str(files["query3"])).count() == 48


def test_stream_meter_and_idle_stop(spark, tmp_path):
    spark.sql("select id, timestamp_millis(id * 400) ts, 'k' key from range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, key string").parquet(str(tmp_path / "in"))
    assert [r["ms"] for r in drained(stream_throughput(stream, "key", "ts"), "meter").orderBy("ms").collect()] == [1200, 2400, 3600]
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    stop_when_idle(query, 1.0)
    assert not query.isActive


def test_stream_state_carries_over_micro_batches(spark, sf_dir, tmp_path):
    from thermolith.streaming.windows import stream_outliers

    packed = saturation.with_saturation(tiles.packed(tiles.read_tiles(spark, sf_dir).where("batch_id < 96")))
    for i in range(3):
        packed.where(f"batch_id div 32 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda r: (r["seq"], r["batch_id"], r["saturated"], [tuple(o) for o in r["outliers"]])
    by_stream = sorted(map(key, drained(stream_outliers(stream), "carry").collect()))
    assert by_stream == sorted(map(key, stencil.outliers(packed).collect()))


class Handler(BaseHTTPRequestHandler):
    served, got = 0, []

    def do_GET(self):
        if Handler.served >= 5:
            self.send_error(404)
            return
        Handler.served += 1
        self.answer(f"batch {Handler.served}".encode())

    def do_POST(self):
        Handler.got.append((self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()))
        self.answer(b'"run-1"')

    def answer(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_source_and_sink(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    service = http_batches.Service(url, 1, 0)
    bench = service.create(name="test")
    service.start(bench)
    assert bench == "run-1"
    first = http_batches.http_batches(spark, url, bench, limit=2).collect()
    assert [bytes(r["value"]) for r in first] == [b"batch 1", b"batch 2"]
    rest = http_batches.http_batches(spark, url, bench).collect()
    assert [bytes(r["value"]) for r in rest] == [b"batch 3", b"batch 4", b"batch 5"]
    http_batches.push_results(spark.createDataFrame([(1, "one"), (2, "two")], "batch_id int, body string"), url, bench)
    service.end(bench)
    assert {("/api/result/0/run-1/1", "one"), ("/api/result/0/run-1/2", "two")} <= set(Handler.got)
    assert Handler.got[-1][0] == "/api/end/run-1"
    server.shutdown()


class Recorder:
    """Stands in for a session's readers and writers, and notes what is asked of them."""

    def __init__(self, notes):
        self.notes = notes

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.notes.append((name, args, kwargs))
            return self

        return self if name in ("read", "readStream", "write", "writeStream") else call


def test_kafka_options(spark):
    topics = Topics(servers="a:9092,b:9092", options={"kafka.security.protocol": "SSL"})
    connect = {"kafka.bootstrap.servers": "a:9092,b:9092", "kafka.security.protocol": "SSL"}
    for read in (topics.read, topics.read_stream):
        notes = []
        read(Recorder(notes), BATCHES)
        assert notes[:3] == [("format", ("kafka",), {}), ("options", (), connect | {"subscribe": BATCHES, "startingOffsets": "earliest"}), ("load", (), {})]
    notes = []
    topics.write(Recorder(notes), RESULTS[0])
    assert notes[0][0] == "select" and notes[1:] == [("format", ("kafka",), {}), ("options", (), connect | {"topic": RESULTS[0]}), ("save", (), {})]
    notes = []
    topics.write_stream(Recorder(notes), RESULTS[1], "/c")
    assert ("option", ("checkpointLocation", "/c"), {}) in notes and ("options", (), connect | {"topic": RESULTS[1]}) in notes
    assert ("trigger", (), {"availableNow": True}) in notes and notes[-1][0] == "start"


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    topics, lines = Topics(str(tmp_path)), spark.createDataFrame([("a",), ("b",)], "value string")
    for batch in ("run-0", "run-1", "run-0"):
        topics.write(lines, RESULTS[1], batch)
    topics.write(lines, RESULTS[1])
    assert topics.read(spark, RESULTS[1]).count() == 6


def test_limit_of_a_stream_is_refused(spark, tmp_path):
    with pytest.raises(SystemExit, match="limit"):
        cli.main(["run", "--folder", str(tmp_path), "--mode", "stream", "--limit", "3"])


def test_durations_in_order_only(spark):
    want = {"1s2us3ms": 1000.002, "1s2ms3us4ns": 1002.003004, "5s": 5000.0, "1s7ns": 1000.000007, "2ms": None, "x1s": None, "1s2msrest": 1002.0, "": None}
    rows = spark.createDataFrame([(t,) for t in want], "text string").select("text", duration_ms(F.col("text")).alias("ms")).collect()
    assert {r["text"]: r["ms"] for r in rows} == {t: v if v is None else pytest.approx(v) for t, v in want.items()}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from thermolith import storage

    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        )

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            storage.shared_dir(session(master))
    storage.shared_dir(session("local[2]"))


def test_forgotten_tables_are_deleted(spark):
    import os

    from thermolith import storage

    table = storage.saved(spark.range(3), "short-lived")
    folder = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    storage.forget(table, spark.range(1))
    assert not os.path.exists(folder)


def test_first_wins_beside_columns_of_its_own_names(spark):
    from thermolith.operators.measurements import first_wins

    rows = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (2, 1, "c")], "rank int, __rank int, _rank string")
    assert sorted(map(tuple, first_wins(rows, ["rank"], ["__rank"]).collect())) == [(1, 4, "b"), (2, 1, "c")]


def test_core_queries_stand_without_the_optional_package(monkeypatch):
    import importlib

    import __spark_entry__

    real = importlib.import_module

    def missing(name, *rest):
        if name.startswith(("thermolith.llm", "corpus_pipeline")):
            raise ModuleNotFoundError("No module named 'regex'")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = set(__spark_entry__.queries())
    assert "h2_top5_outliers" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names


def test_sliding_median_over_nulls_nan_ties_and_keys(spark):
    import math
    import statistics

    from thermolith.operators.measurements import sliding_median

    rng = np.random.default_rng(2)
    rows = [(k, i, None if i % 7 == 3 else float(rng.integers(0, 9)), "x") for k in (None, 1, 2) for i in range(60)] + [(3, i, math.nan if i < 4 else 1.0, "x") for i in range(12)]
    frame = spark.createDataFrame(rows, "k int, i int, v double, extra string").repartition(5)
    found = {(r["k"], r["i"]): r["median"] for r in sliding_median(frame, "v", ["k"], ["i"], 10).collect()}
    for k, i, _, _ in rows:
        held = [v for j, _, v, _ in [(x[0], 0, x[2], 0) for x in rows if x[0] == k and i - 10 < x[1] <= i] if v is not None]
        held.sort(key=lambda v: math.inf if v != v else v)
        want = statistics.median(held) if all(v == v for v in held) else (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
        assert found[k, i] == pytest.approx(want, nan_ok=True), (k, i)
    assert sliding_median(frame.where("false"), "v", ["k"], ["i"]).count() == 0


def test_charts(spark, tmp_path, monkeypatch):
    import logging
    from xml.etree import ElementTree

    from thermolith.sources import charts

    rows = [("a<b", 16.25, 1.5, 1400.0, None), ("c", 3.0, 0.1, 22000.0, 600.0), ("d", 0.0, 0.0, 0.0, 0.0)]
    stats = spark.createDataFrame(rows, "config string, throughput_mean double, throughput_stdev double, latency_mean double, latency_stdev double")
    results.write_csv(stats, f"{tmp_path}/stats")
    monkeypatch.setattr(cli, "session", lambda metrics=False: spark)
    cli.main(["--log-file", f"{tmp_path}/log", "charts", "--statistics", f"{tmp_path}/stats", "--label", "config", "--output", f"{tmp_path}/out"])
    drawn = {n: ElementTree.parse(f"{tmp_path}/out/{n}.svg").getroot() for n in ("throughput", "latency", "combined")}
    name = "{http://www.w3.org/2000/svg}"
    bars = [r for r in drawn["throughput"].iter(f"{name}rect")]
    assert [t.text for t in drawn["throughput"].iter(f"{name}text")][-3:] == ["a<b", "c", "d"]
    heights = [float(r.get("height")) for r in bars]
    assert heights[1] == pytest.approx(heights[0] * 3.0 / 16.25, abs=0.1) and heights[2] == 0
    assert len(list(drawn["combined"].iter(f"{name}rect"))) == 6 + 2
    assert "written" in open(f"{tmp_path}/log").read()
    with pytest.raises(ValueError, match="at most"):
        charts.bar_chart("t", ["x"] * 101, {})
    record = logging.LogRecord("n", logging.ERROR, "f", 1, "bad", None, None)
    assert cli.Coloured("%(message)s").format(record) == "\033[31mbad\033[0m"
