"""``python -m thermolith``: run the queries over a topic of messages, drain their results to files, do both, or draw statistics."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession

from . import storage
from .plans import monitoring
from .sources.charts import statistics_charts, write_text
from .sources.messages import MODES, decode_messages
from .sources.results import cluster_rows, output_name, read_statistics, result_rows, write_csv, write_json_lines
from .sources.topics import BATCHES, RESULTS, Topics, first_messages
from .streaming.windows import ROCKSDB

log = logging.getLogger("thermolith")

# Colours of a terminal by level.
_COLOURS = {logging.WARNING: "\033[33m", logging.ERROR: "\033[31m", logging.INFO: "\033[36m"}


class Coloured(logging.Formatter):
    """Lines coloured by level."""

    def format(self, record: logging.LogRecord) -> str:
        line = super().format(record)
        colour = _COLOURS.get(record.levelno)
        return f"{colour}{line}\033[0m" if colour else line


def session(metrics: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName("thermolith").config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if metrics:  # Prometheus text at /metrics/executors/prometheus of the driver's UI
        builder = builder.config("spark.ui.prometheus.enabled", "true").config("spark.sql.streaming.metricsEnabled", "true")
    return builder.getOrCreate()


def run(args: argparse.Namespace) -> None:
    spark, queries = session(args.metrics), tuple(args.queries.split(","))
    if unknown := set(queries) - set(monitoring.QUERIES):
        raise SystemExit(f"unknown queries: {', '.join(sorted(unknown))}")
    topics, began = Topics(args.folder, args.servers), time.monotonic()
    if args.mode == "batch":
        messages = first_messages(topics.read(spark, args.topic), args.limit)
        monitoring.run_batch(decode_messages(messages, mode=args.malformed), topics, queries)
    else:
        if args.limit is not None:
            raise SystemExit("--limit needs --mode batch: a stream has no first messages across its restarts")
        tiles = decode_messages(topics.read_stream(spark, args.topic), mode=args.malformed)
        for query in monitoring.run_stream(tiles, topics, args.checkpoint or storage.fresh_dir(spark, "run"), queries, not args.forever):
            query.awaitTermination()
    if args.profile:
        log.info("%s took %.1f s", args.queries, time.monotonic() - began)


def drain(args: argparse.Namespace) -> None:
    """Results of q3, q2 and q1, in this order, as dated files; short runs have no q3."""
    spark, topics = session(), Topics(args.folder, args.servers)
    for topic in reversed(RESULTS[:2] if args.short else RESULTS):
        lines, query = topics.read(spark, topic), topic.removesuffix("-results")
        is_clusters = query == "query3"
        path = f"{args.output}/{output_name(topic, datetime.now(), 'jsonl' if is_clusters else 'csv')}"
        (write_json_lines if is_clusters else write_csv)(cluster_rows(lines) if is_clusters else result_rows(lines, query), path)
        log.info("%s written to %s", topic, path)


def everything(args: argparse.Namespace) -> None:
    """The queries over all messages at hand, then their results as files."""
    run(args)
    drain(args)


def charts(args: argparse.Namespace) -> None:
    """Bar charts of a statistics CSV, one for each measure and one of all."""
    spark = session()
    statistics = read_statistics(spark, args.statistics, column=args.label)
    measures = [c.removesuffix("_mean") for c in statistics.columns if c.endswith("_mean") and f"{c.removesuffix('_mean')}_stdev" in statistics.columns]
    for name, text in statistics_charts(statistics, args.label, measures).items():
        write_text(spark, text, f"{args.output}/{name}.svg")
        log.info("%s.svg written to %s", name, args.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thermolith", description=__doc__)
    commands = p.add_subparsers(required=True)
    p.add_argument("--log-file", help="also write log lines here")
    c = commands.add_parser("charts", help=charts.__doc__)
    c.set_defaults(call=charts)
    c.add_argument("--statistics", required=True)
    c.add_argument("--label", default="file")
    c.add_argument("--output", required=True)
    for name, call in (("run", run), ("drain", drain), ("all", everything)):
        c = commands.add_parser(name, help=call.__doc__)
        c.set_defaults(call=call)
        where = c.add_mutually_exclusive_group(required=True)
        where.add_argument("--folder", help="folder that holds topics as folders of Parquet files")
        where.add_argument("--servers", help="Kafka brokers")
        if name != "drain":
            c.add_argument("--queries", default="q1,q2,q3")
            c.add_argument("--mode", choices=("batch", "stream"), default="batch")
            c.add_argument("--malformed", choices=MODES, default="FAILFAST")
            c.add_argument("--topic", default=BATCHES)
            c.add_argument("--limit", type=int)
            c.add_argument("--checkpoint")
            c.add_argument("--forever", action="store_true", help="don't stop when all messages at hand are read")
            c.add_argument("--metrics", action="store_true")
            c.add_argument("--profile", action="store_true")
        if name != "run":
            c.add_argument("--output", required=True)
            c.add_argument("--short", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args, form = parser().parse_args(argv), "%(asctime)s %(message)s"
    console = logging.StreamHandler()
    console.setFormatter((Coloured if console.stream.isatty() else logging.Formatter)(form))
    handlers: list[logging.Handler] = [console]
    if args.log_file:
        handlers.append(logging.FileHandler(args.log_file))
        handlers[-1].setFormatter(logging.Formatter(form))
    log.handlers[:] = handlers
    log.setLevel(logging.INFO)
    args.call(args)


if __name__ == "__main__":
    main(sys.argv[1:])
