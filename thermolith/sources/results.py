"""Result files: consuming lines, CSV and JSON lines, run logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import HEADERS, fields, parse_clusters
from ..operators.measurements import parsed_run_log

MIN_FIELDS = 3
CENTROIDS = "array<struct<x:double,y:double,count:int>>"


def output_name(topic: str, now: datetime, extension: str = "csv") -> str:
    """``<topic without -results>_<time>.<extension>``."""
    return f"{topic.removesuffix('-results')}_{now:%Y%m%d_%H%M%S}.{extension}"


def parsed_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Stripped, non-empty lines of at least three fields, with their fields."""
    text = F.trim(F.col(value_col).cast("string"))
    return lines.select(text.alias("line")).where("line <> ''").withColumn("fields", fields(F.col("line"))).where(F.size("fields") >= MIN_FIELDS)


def result_rows(lines: DataFrame, query: str, value_col: str = "value") -> DataFrame:
    """Lines of query1 or query2 as columns of their header; missing fields are null."""
    rows = parsed_lines(lines, value_col)
    return rows.select(*(F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(HEADERS[query])))


def cluster_rows(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Lines of query3 as batch_id, print_id, tile_id, saturated and an array of centroids."""
    rows = parsed_lines(lines, value_col)
    rest = F.array_join(F.slice("fields", 5, F.greatest(F.size("fields") - 4, F.lit(0))), ",")
    plain = [F.get("fields", F.lit(i)) for i in range(4)]
    kinds = ("int", "string", "int", "int")
    return rows.select(*(c.try_cast(k).alias(n) for c, k, n in zip(plain, kinds, HEADERS["query3"], strict=False)), parse_clusters(rest).alias("centroids"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; quotes inside a field are doubled."""
    rows.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.text(path)


def json_lines_to_csv(spark: SparkSession, source: str, target: str) -> None:
    """Clusters as JSON lines to CSV with the centroids as JSON text; bad lines are left out."""
    schema = f"batch_id int, print_id string, tile_id int, saturated int, centroids {CENTROIDS}"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(source)
    write_csv(rows.withColumn("centroids", F.to_json("centroids")), target)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object per line, with latencies in milliseconds and their file."""
    schema = "count int, missing int, throughput double, latency_mean string, latency_min string, latency_max string, latency_p99 string"
    return parsed_run_log(spark.read.schema(schema).json(path).withColumn("file", F.input_file_name()))


def read_statistics(spark: SparkSession, path: str, configs: list[str] | None = None, labels: dict[str, str] | None = None, column: str = "file") -> DataFrame:
    """A statistics CSV, some of its configurations, under other labels."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if configs is not None:
        rows = rows.where(F.col(column).isin(configs))
    return rows.replace(labels, subset=[column]) if labels else rows
