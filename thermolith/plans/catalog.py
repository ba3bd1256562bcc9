"""Every operator as a query over the driver's tables, with its SQL where SQL has one.

Tiles are the ``embeddings`` read as 8 by 8 images; events and numbers of other
tables stand in for meters, messages and run logs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..constants import EPS, MIN_POINTS, TOP, WINDOW_LAYERS
from ..functions import formats, predicates
from ..functions.durations import duration_ms, seconds
from ..operators import clusters, measurements, saturation, stencil, tiles, topk, windows
from ..sources import messages, results
from ..sources.topics import RESULTS, first_messages, query_of_column
from ..streaming.meters import stream_throughput, throughput_windows
from ..streaming.running import drained
from ..streaming.windows import ROCKSDB, stream_outliers
from . import monitoring, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.read_tiles(spark, sf_dir)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.packed(_tiles(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Saturation

_SATURATED = ["batch_id", "print_id", "tile_id", "saturated"]


@_query("d1_saturation_by_tile", oracle.SATURATION)
def _(spark, sf_dir):
    return saturation.saturation_relational(_tiles(spark, sf_dir))


@_query("d1_saturation_hof", oracle.SATURATION)
def _(spark, sf_dir):
    return saturation.saturation(_tiles(spark, sf_dir)).select(*_SATURATED)


@_query("d1_saturation_arrow", oracle.SATURATION)
def _(spark, sf_dir):
    return saturation.saturation_arrow(_packed(spark, sf_dir))


@_query(
    "d2_stacked_layers",
    f"WITH {oracle.PIXELS} SELECT tile_id, layer, y, CAST(sum(t) AS BIGINT) AS row_sum FROM px GROUP BY tile_id, layer, y",
)
def _(spark, sf_dir):
    stacked = tiles.matrix(_tiles(spark, sf_dir)).select("tile_id", "layer", F.posexplode("temperature").alias("y", "row"))
    return stacked.select("tile_id", "layer", "y", F.aggregate("row", F.lit(0).cast("long"), lambda a, t: a + t).alias("row_sum"))


@_query("d2_layer_cube", f"WITH {oracle.PIXELS} SELECT tile_id, layer, y, x, t FROM px")
def _(spark, sf_dir):
    """Tiles of a place stacked as one array of (layer, row, column), and all its cells read back."""

    def stacked(table: pa.Table) -> pa.Table:
        table = table.sort_by("layer")
        cells = tiles.cube(table.column("pixels").to_pylist(), tiles.SIDE, tiles.SIDE)
        at, y, x = (a.ravel() for a in np.indices(cells.shape))
        layers = table.column("layer").to_numpy()[at]
        tile = np.full(cells.size, table.column("tile_id")[0].as_py())
        return pa.table({"tile_id": tile, "layer": layers, "y": y.astype(np.int32), "x": x.astype(np.int32), "t": cells.ravel().astype(np.int32)})

    return _packed(spark, sf_dir).select("tile_id", "layer", "pixels").groupBy("tile_id").applyInArrow(stacked, "tile_id long, layer long, y int, x int, t int")


@_query("c6_tile_key", "SELECT vec_id AS batch_id, 'P0_' || CAST(vec_id % 16 AS VARCHAR) AS tile_key FROM embeddings")
def _(spark, sf_dir):
    return _tiles(spark, sf_dir).select("batch_id", predicates.tile_key(F.col("print_id"), F.col("tile_id")).alias("tile_key"))


@_query("c8_centre_pixels", f"WITH {oracle.PIXELS} SELECT batch_id, count(*) AS centres FROM px WHERE t > 5000 AND t < 65000 GROUP BY batch_id")
def _(spark, sf_dir):
    return tiles.pixels(_tiles(spark, sf_dir)).where(predicates.is_centre(F.col("t"))).groupBy("batch_id").agg(F.count("*").alias("centres"))


@_query(
    "b4_saturation_lines",
    f"WITH {oracle.PIXELS}, s AS (SELECT batch_id, tile_id, sum(CASE WHEN t > 65000 THEN 1 ELSE 0 END) AS n FROM px GROUP BY batch_id, tile_id) "
    "SELECT batch_id, printf('%d,P0,%d,%d', batch_id, tile_id, CAST(n AS BIGINT)) AS line FROM s",
)
def _(spark, sf_dir):
    t = saturation.saturation(_tiles(spark, sf_dir))
    return t.select("batch_id", formats.saturation_line(*(F.col(c) for c in _SATURATED)).alias("line"))


@_query("b3_line_bytes", "SELECT vec_id AS batch_id, octet_length(encode(CAST(vec_id AS VARCHAR) || ',P0')) AS bytes FROM embeddings")
def _(spark, sf_dir):
    line = F.concat_ws(",", F.col("batch_id").cast("string"), "print_id")
    return _tiles(spark, sf_dir).select("batch_id", F.octet_length(formats.line_bytes(line)).cast("long").alias("bytes"))


# Count windows


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.struct("layer", F.col("batch_id").alias("seq"))
    return windows.count_window(_tiles(spark, sf_dir), content, tiles.KEYS, ["batch_id"])


_LAG = "OVER (PARTITION BY vec_id % 16 ORDER BY vec_id)"


@_query(
    "f1_count_window_layers",
    f"SELECT batch_id, n, CASE n WHEN 1 THEN l0 WHEN 2 THEN l1 ELSE l2 END AS oldest, l0 AS newest FROM (SELECT vec_id AS batch_id, "
    f"CAST(least(3, row_number() {_LAG}) AS INTEGER) AS n, vec_id // 16 AS l0, lag(vec_id // 16, 1) {_LAG} AS l1, lag(vec_id // 16, 2) {_LAG} AS l2 FROM embeddings)",
)
def _(spark, sf_dir):
    w = F.col("window")
    return _windowed(spark, sf_dir).select("batch_id", F.size(w).alias("n"), F.get(w, F.lit(0))["layer"].alias("oldest"), windows.current(w)["layer"].alias("newest"))


#: Arrivals out of order: each user's events, with a layer that jumps.
_JUMPS = "(event_id * 7919) % 101"


@_query(
    "f3_current_is_max_layer",
    f"""WITH e AS (SELECT event_id, user_id, {_JUMPS} AS layer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events),
w AS (SELECT a.event_id, b.layer, b.event_id AS seq, row_number() OVER (PARTITION BY a.event_id ORDER BY b.layer DESC, b.event_id DESC) AS r
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.at BETWEEN a.at - 2 AND a.at)
SELECT event_id, layer AS current_layer, seq AS current_event FROM w WHERE r = 1""",
)
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_JUMPS).alias("layer"))
    w = windows.count_window(e, F.struct("layer", F.col("event_id").alias("seq")), ["user_id"], ["event_id"])
    now = windows.current(F.col("window"))
    return w.select("event_id", now["layer"].alias("current_layer"), now["seq"].alias("current_event"))


@_query(
    "f4_short_window",
    f"SELECT vec_id AS batch_id, row_number() {_LAG} < 3 AS short FROM embeddings",
)
def _(spark, sf_dir):
    return _windowed(spark, sf_dir).select("batch_id", (~windows.is_full(F.col("window"))).alias("short"))


# Stencil


def _mean_query(column: str) -> Query:
    def run(spark, sf_dir):
        return stencil.means_windowed(_tiles(spark, sf_dir)).select("batch_id", "y", "x", column)

    return run


for _name, _column in (("d4_close_mean", "close_mean"), ("d5_distant_mean", "far_mean")):
    _query(_name, f"WITH {oracle.MEANS} SELECT batch_id, y, x, {_column} FROM means")(_mean_query(_column))


@_query("d7_deviation", f"WITH {oracle.MEANS} SELECT batch_id, y, x, abs(close_mean - far_mean) AS deviation FROM means")
def _(spark, sf_dir):
    means = stencil.means_windowed(_tiles(spark, sf_dir))
    return means.select("batch_id", "y", "x", stencil.deviation(F.col("close_mean"), F.col("far_mean")).alias("deviation"))


_OUTLIERS_SQL = f"WITH {oracle.OUTLIERS} SELECT batch_id, y, x, deviation FROM outl"


@_query("q2_outliers_relational", _OUTLIERS_SQL)
def _(spark, sf_dir):
    return stencil.outliers_of(stencil.means_relational(_tiles(spark, sf_dir)))


@_query("q2_outliers_diamond", _OUTLIERS_SQL)
def _(spark, sf_dir):
    return stencil.outliers_of(stencil.means_windowed(_tiles(spark, sf_dir)))


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("batch_id", F.inline("outliers"))


@_query("q2_outliers_arrow", _OUTLIERS_SQL)
def _(spark, sf_dir):
    return _exploded(stencil.outliers(_packed(spark, sf_dir)))


@_query("h1_ranked_outliers", f"WITH {oracle.OUTLIERS} SELECT batch_id, y, x, deviation, CAST(rn AS INTEGER) AS rank FROM rnk")
def _(spark, sf_dir):
    return topk.ranked(_exploded(stencil.outliers(_packed(spark, sf_dir))))


@_query("h2_top5_outliers", oracle.top5())
def _(spark, sf_dir):
    found = stencil.outliers(_packed(spark, sf_dir)).where(F.size("outliers") > 0)
    picks = [F.get("outliers", F.lit(i))[c].alias(f"{a}{i + 1}") for i in range(TOP) for a, c in (("y", "y"), ("x", "x"), ("d", "deviation"))]
    return found.select("batch_id", *picks)


@_query("h2_top5_relational", oracle.top5())
def _(spark, sf_dir):
    return topk.top_outliers(stencil.outliers_of(stencil.means_windowed(_tiles(spark, sf_dir))))


@_query("q2_csv_rows", oracle.csv_rows())
def _(spark, sf_dir):
    found = stencil.outliers(_packed(spark, sf_dir))
    return found.select("batch_id", formats.outlier_line(*(F.col(c) for c in ("batch_id", "print_id", "tile_id", "outliers"))).alias("line"))


# Clusters

for _eps, _least in ((20.0, MIN_POINTS), (1.0, 4), (1.5, 6)):
    _suffix = f"_{str(_eps).replace('.', 'p')}_{_least}"

    def _labels(spark, sf_dir, eps=_eps, least=_least):
        return clusters.labelled_points(clusters.label_outliers(stencil.outliers(_packed(spark, sf_dir)), eps, least))

    def _centroids(spark, sf_dir, labels=_labels):
        return clusters.centroids(labels(spark, sf_dir))

    _query(f"q3_dbscan_labels{_suffix}", oracle.labels(_eps, _least) + " SELECT batch_id, y, x, label FROM labelled")(_labels)
    _query(f"q3_centroids{_suffix}", oracle.centroids(_eps, _least))(_centroids)


@_query(
    "q3_cluster_counts",
    oracle.labels(1.0, 4) + ", n AS (SELECT batch_id, CAST(count(DISTINCT label) AS INTEGER) AS clusters FROM labelled WHERE label >= 0 GROUP BY batch_id) "
    "SELECT v.vec_id AS batch_id, coalesce(n.clusters, 0) AS clusters FROM embeddings v LEFT JOIN n ON n.batch_id = v.vec_id",
)
def _(spark, sf_dir):
    found = monitoring.clusters(stencil.outliers(_packed(spark, sf_dir)), 1.0, 4)
    return found.select("batch_id", F.size("clusters").alias("clusters"))


@_query("q3_cluster_lines", oracle.cluster_lines(EPS, MIN_POINTS))
def _(spark, sf_dir):
    found = monitoring.clusters(stencil.outliers(saturation.with_saturation(_packed(spark, sf_dir))))
    return monitoring.q3_lines(found)


# Formats and consumers

_LINES = "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '  ' WHEN vec_id % 5 = 0 THEN vec_id || ',P0' ELSE ' ' || vec_id || ',P0,' || (vec_id % 16) || ',' || (vec_id * 3) || ' ' END AS value FROM embeddings"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    full = F.concat(F.lit(" "), F.concat_ws(",", v.cast("string"), F.lit("P0"), (v % 16).cast("string"), (v * 3).cast("string")), F.lit(" "))
    value = F.when(v % 7 == 0, "  ").when(v % 5 == 0, F.concat(v.cast("string"), F.lit(",P0"))).otherwise(full)
    return _table(spark, sf_dir, "embeddings").select(value.alias("value"))


@_query(
    "b7_csv_parse_min_fields",
    f"WITH l AS (SELECT string_split(trim(value), ',') AS f FROM ({_LINES}) WHERE trim(value) <> '') "
    "SELECT f[1] AS seq_id, f[2] AS print_id, f[3] AS tile_id, f[4] AS saturated FROM l WHERE len(f) >= 3",
)
def _(spark, sf_dir):
    return results.result_rows(_lines(spark, sf_dir), "query1")


def _cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of half-exact numbers per vector, in the written form."""
    v = F.col("vec_id")
    pair = F.array(*(F.struct((v + i + F.lit(0.25)).alias("x"), (v * 2 + F.lit(0.5)).alias("y"), (v + i).cast("int").alias("count")) for i in range(2)))
    return _table(spark, sf_dir, "embeddings").select(formats.cluster_line(v, F.lit("P0"), v % 16, v % 9, pair).alias("value"), "vec_id")


_CLUSTERS_SQL = "SELECT vec_id, i, vec_id + i + 0.25 AS x, vec_id * 2 + 0.5 AS y, CAST(vec_id + i AS INTEGER) AS count FROM embeddings, (SELECT unnest(range(2)) AS i)"


@_query("k10_cluster_regex", f"SELECT CAST(vec_id AS INTEGER) AS batch_id, CAST(i AS INTEGER) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, count FROM ({_CLUSTERS_SQL})")
def _(spark, sf_dir):
    rows = results.cluster_rows(_cluster_lines(spark, sf_dir))
    return rows.select("batch_id", F.posexplode("centroids").alias("i", "c")).select("batch_id", "i", "c.x", "c.y", "c.count")


@_query("k11_bracket_trim", "SELECT vec_id, 'a [' || vec_id || '] b' AS text FROM embeddings")
def _(spark, sf_dir):
    text = F.concat(F.lit(" [a ["), F.col("vec_id").cast("string"), F.lit("] b] "))
    return _table(spark, sf_dir, "embeddings").select("vec_id", formats.trim_brackets(text).alias("text"))


@_query(
    "b10_json_record",
    "SELECT printf('{\"batch_id\":%d,\"print_id\":\"P0\",\"tile_id\":%d,\"saturated\":%d,\"centroids\":[{\"x\":%d.25,\"y\":%d.5,\"count\":%d},{\"x\":%d.25,\"y\":%d.5,\"count\":%d}]}', "
    "vec_id, vec_id % 16, vec_id % 9, vec_id, vec_id * 2, vec_id, vec_id + 1, vec_id * 2, vec_id + 1) AS value FROM embeddings",
)
def _(spark, sf_dir):
    return results.json_lines(results.cluster_rows(_cluster_lines(spark, sf_dir)))


@_query(
    "b11_json_lines_to_csv",
    f"SELECT CAST(vec_id AS INTEGER) AS batch_id, CAST(vec_id % 16 AS INTEGER) AS tile_id, CAST(vec_id % 9 AS INTEGER) AS saturated, CAST(i AS INTEGER) AS i, "
    f"CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, count FROM ({_CLUSTERS_SQL})",
)
def _(spark, sf_dir):
    base = storage.fresh_dir(spark, "jsonl")
    good = results.json_lines(results.cluster_rows(_cluster_lines(spark, sf_dir)))
    bad = _table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.concat(F.lit('{"batch_id": '), F.col("vec_id").cast("string"), F.lit(", [")).alias("value"))
    good.unionByName(bad).write.text(f"{base}/in")
    results.json_lines_to_csv(spark, f"{base}/in", f"{base}/out")
    rows = spark.read.option("header", True).option("escape", '"').schema("batch_id int, print_id string, tile_id int, saturated int, centroids string").csv(f"{base}/out")
    found = rows.select("batch_id", "tile_id", "saturated", F.posexplode(F.from_json("centroids", results.CENTROIDS)).alias("i", "c"))
    return found.select("batch_id", "tile_id", "saturated", "i", "c.x", "c.y", "c.count")


@_query("b13_first_wins_dedupe", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(spark, sf_dir):
    return measurements.first_wins(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@_query(
    "k17_debug_text",
    f"""WITH {oracle.OUTLIERS}, s AS (SELECT batch_id, tile_id, layer, CAST(sum(CASE WHEN t > 65000 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM px GROUP BY batch_id, tile_id, layer)
SELECT s.batch_id, printf('(%d,%d):', x, y) || CAST(deviation AS VARCHAR) AS outlier,
       printf('tile %d of print P0, layer %d, batch %d: %d saturated', tile_id, layer, s.batch_id, n) AS tile
FROM rnk JOIN s ON s.batch_id = rnk.batch_id WHERE rn = 1""",
)
def _(spark, sf_dir):
    found = stencil.outliers(saturation.with_saturation(_packed(spark, sf_dir))).where(F.size("outliers") > 0)
    outlier = formats.outlier_debug_text(F.get("outliers", F.lit(0)))
    tile = formats.tile_debug_text(*(F.col(c) for c in ("batch_id", "print_id", "tile_id", "layer", "saturated")))
    return found.select("batch_id", outlier.alias("outlier"), tile.alias("tile"))


# Messages


_DECODED = f"SELECT CAST(batch_id AS INTEGER) AS batch_id, print_id, CAST(tile_id AS INTEGER) AS tile_id, saturated FROM ({oracle.SATURATION})"


@_query("a3_decode_roundtrip", _DECODED)
def _(spark, sf_dir):
    return saturation.saturation_arrow(messages.decode_messages(messages.encode_messages(_packed(spark, sf_dir))))


@_query("a7_base64_payload", _DECODED)
def _(spark, sf_dir):
    return saturation.saturation_arrow(messages.decode_messages(messages.encode_messages(_packed(spark, sf_dir), as_text=True)))


@_query("a4_lenient_decode", "SELECT count(*) AS tiles FROM embeddings WHERE vec_id % 3 <> 0")
def _(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    sound = messages.encode_messages(packed.where("batch_id % 3 <> 0"))
    bad = messages.encode_messages(packed.where("batch_id % 3 = 0")).select(F.substring("value", 1, 40).alias("value"))
    return messages.decode_messages(sound.unionByName(bad), mode="DROPMALFORMED").agg(F.count("*").alias("tiles"))


@_query("a14_latest_value", "SELECT event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return measurements.latest(_table(spark, sf_dir, "events"), "event_type", "event_id", ["ts", "event_id"])


@_query(
    "a16_isin_replace",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def _(spark, sf_dir):
    path = f"{storage.fresh_dir(spark, 'statistics')}/csv"
    results.write_csv(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    rows = results.read_statistics(spark, path, ["F", "O"], {"F": "finished"}, "o_orderstatus")
    return rows.select(F.col("o_orderkey").cast("long"), "o_orderstatus")


@_query("c5_not_null_filter", "SELECT event_id FROM events WHERE CASE WHEN event_id % 4 <> 0 THEN value END IS NOT NULL")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return rows.where(predicates.present(F.col("v"))).select("event_id")


@_query("h4_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 160")
def _(spark, sf_dir):
    return first_messages(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 160)


@_query(
    "c12_query_type",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE 'query' || (event_id % 5) END AS query FROM events",
)
def _(spark, sf_dir):
    n = F.col("event_id") % 5
    topic = F.when(n == 0, "gc-batches").otherwise(F.concat(F.lit("dev.query"), n.cast("string"), F.lit("-results")))
    return _table(spark, sf_dir, "events").select("event_id", query_of_column(topic).alias("query"))


# Measurements


@_query(
    "e4_perf_stats",
    "SELECT l_returnflag, count(*) AS runs, avg(l_quantity) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_stdev, "
    "max(l_quantity) AS l_quantity_max, min(l_quantity) AS l_quantity_min FROM lineitem GROUP BY l_returnflag".replace("avg(l_quantity) AS", "round(avg(l_quantity), 6) AS"),
)
def _(spark, sf_dir):
    return measurements.run_statistics(_table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"])


@_query(
    "k13_latency_parse",
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST((event_id % 7) * 1000 + event_id % 1000 AS DOUBLE) + CAST(event_id % 991 AS DOUBLE) / 1000 + CAST(event_id % 983 AS DOUBLE) / 1000000 END AS ms FROM events",
)
def _(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.when(e % 3 != 0, F.format_string("%ds", e % 7)).otherwise(""), F.format_string("%dms%dÂµs%dns", e % 1000, e % 991, e % 983))
    return _table(spark, sf_dir, "events").select("event_id", duration_ms(text).alias("ms"))


@_query("k15_to_seconds", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'none' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) / 1000 AS s FROM events")
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", seconds(text).alias("s"))


@_query("e5_running_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS elements FROM events")
def _(spark, sf_dir):
    return measurements.running_count(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("event_id", "elements")


@_query("e6_avg_by_group", "SELECT event_type, avg(user_id) AS avg_user_id FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return measurements.average_by(_table(spark, sf_dir, "events"), "event_type", "user_id")


@_query(
    "f5_latency_median100",
    "SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS median FROM events",
)
def _(spark, sf_dir):
    return measurements.sliding_median(_table(spark, sf_dir, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "median")


@_query("g6_throughput_1s", "SELECT date_trunc('second', ts) AS second, count(*) AS elements FROM events GROUP BY 1")
def _(spark, sf_dir):
    return measurements.throughput_by_second(_table(spark, sf_dir, "events"), "ts")


@_query(
    "g7_latency",
    "SELECT event_id, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS ms FROM events",
)
def _(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select("event_id", measurements.latency_ms(before, F.col("ts")).alias("ms"))


# Streams: the tables as files that arrive, drained once


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = _table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet")


def _tile_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_from_embeddings(_stream(spark, sf_dir, "embeddings"))


@_query("q1_stream", oracle.SATURATION)
def _(spark, sf_dir):
    return drained(saturation.saturation(_tile_stream(spark, sf_dir)).select(*_SATURATED), "q1")


def _outlier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(stream_outliers(saturation.with_saturation(tiles.packed(_tile_stream(spark, sf_dir)))), "q2")


_WINDOWS_SQL = f"""WITH {oracle.OUTLIERS}, n AS (SELECT batch_id, count(*) AS n, max(deviation) AS top FROM outl GROUP BY batch_id),
s AS (SELECT batch_id, CAST(sum(CASE WHEN t > 65000 THEN 1 ELSE 0 END) AS INTEGER) AS saturated FROM px GROUP BY batch_id)
SELECT vec_id AS batch_id, vec_id % 16 AS tile_id, vec_id // 16 AS layer, saturated, CAST(coalesce(n, 0) AS INTEGER) AS outliers, top
FROM embeddings JOIN s ON s.batch_id = vec_id LEFT JOIN n ON n.batch_id = vec_id"""


def _window_rows(found: DataFrame) -> DataFrame:
    """Every arrival's window: its tile, and its outliers' number and largest deviation."""
    return found.select("batch_id", "tile_id", "layer", "saturated", F.size("outliers").alias("outliers"), F.get("outliers", F.lit(0))["deviation"].alias("top"))


@_query("g1_stream_count_window", _WINDOWS_SQL)
def _(spark, sf_dir):
    return _window_rows(_outlier_stream(spark, sf_dir))


@_query("g2_rocksdb_count_window", _WINDOWS_SQL)
def _(spark, sf_dir):
    """The same with the state of keys in RocksDB, as the command line keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return _window_rows(_outlier_stream(spark, sf_dir))
    finally:
        spark.conf.set(name, before)


@_query("q2_stream", _OUTLIERS_SQL)
def _(spark, sf_dir):
    return _exploded(_outlier_stream(spark, sf_dir))


@_query("q3_stream", oracle.centroids(1.0, 4))
def _(spark, sf_dir):
    return clusters.centroids(clusters.labelled_points(clusters.label_outliers(_outlier_stream(spark, sf_dir), 1.0, 4)))


@_query("g6_stream_throughput", "SELECT date_trunc('second', ts) AS second, count(*) AS elements FROM events GROUP BY 1")
def _(spark, sf_dir):
    # A file sink keeps no updates, so the drained stream is counted again: seconds that micro-batches share add up.
    rows = drained(_stream(spark, sf_dir, "events").select("ts"), "events")
    return throughput_windows(rows, "ts")


@_query(
    "g6_stream_meter",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
m AS (SELECT user_id, rn, ms, ms AS began, 1 AS n, CAST(NULL AS DOUBLE) AS per_second FROM e WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.rn, e.ms, CASE WHEN e.ms - m.began >= 1000 THEN e.ms ELSE m.began END, CASE WHEN e.ms - m.began >= 1000 THEN 0 ELSE m.n + 1 END,
             CASE WHEN e.ms - m.began >= 1000 THEN CAST(m.n + 1 AS DOUBLE) / (CAST(e.ms - m.began AS DOUBLE) / CAST(1000 AS DOUBLE)) END
      FROM m JOIN e ON e.user_id = m.user_id AND e.rn = m.rn + 1)
SELECT CAST(user_id AS VARCHAR) AS key, ms, per_second FROM m WHERE per_second IS NOT NULL""",
)
def _(spark, sf_dir):
    """The meter that elements drive: a reading whenever a second or more has passed since the key's last."""
    return drained(stream_throughput(_stream(spark, sf_dir, "events"), "user_id", "ts"), "meter")


# Result files, written and read back


@_query(
    "a15_run_log",
    "SELECT event_id AS count, event_id % 5 AS missing, CAST(event_id AS DOUBLE) / 4 AS throughput, "
    "CAST(event_id % 7 * 1000 + event_id % 1000 AS DOUBLE) AS latency_mean FROM events",
)
def _(spark, sf_dir):
    path, e = f"{storage.fresh_dir(spark, 'runs')}/log", F.col("event_id")
    run = F.struct(
        e.alias("count"), (e % 5).alias("missing"), (e / 4).alias("throughput"), F.format_string("%ds%dms", e % 7, e % 1000).alias("latency_mean")
    )
    _table(spark, sf_dir, "events").select(F.to_json(run).alias("value")).write.text(path)
    rows = results.read_run_log(spark, path)
    return rows.select(F.col("count").cast("long"), F.col("missing").cast("long"), "throughput", "latency_mean")


@_query("b14_statistics_csv", ORACLE_SQL["e4_perf_stats"])
def _(spark, sf_dir):
    path = f"{storage.fresh_dir(spark, 'statistics')}/csv"
    found = measurements.run_statistics(_table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"])
    results.write_csv(found, path)
    return spark.read.option("header", True).schema(found.schema).csv(path)


@_query(
    "b9_names_and_headers",
    "SELECT * FROM (VALUES ('query1_20240102_030405.csv', 'seq_id,print_id,tile_id,saturated'), "
    "('query2_20240102_030405.csv', 'seq_id,print_id,tile_id,P1,dP1,P2,dP2,P3,dP3,P4,dP4,P5,dP5'), "
    "('query3_20240102_030405.jsonl', 'batch_id,print_id,tile_id,saturated,centroids')) AS t(name, header)",
)
def _(spark, sf_dir):
    when = datetime(2024, 1, 2, 3, 4, 5)
    ends = {RESULTS[2]: "jsonl"}
    return spark.createDataFrame(
        [(results.output_name(t, when, ends.get(t, "csv")), ",".join(formats.HEADERS[t.removesuffix("-results")])) for t in RESULTS], "name string, header string"
    )
