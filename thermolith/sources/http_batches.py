"""Batches from an HTTP service, and results to it, as Python data sources.

The service: POST ``create`` and ``start/ID`` open a run, GET
``next_batch/ID`` gives one message until it answers 404, POST
``result/QUERY/ID/BATCH`` takes a result, POST ``end/ID`` closes the run.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from .waiting import retried


class Service:
    """A run of the service at ``url``."""

    def __init__(self, url: str, retries: int = 10, pause: float = 3.0):
        self.url, self.retries, self.pause = url.rstrip("/"), retries, pause

    def call(self, path: str, body: bytes | None = None, post: bool = False) -> bytes | None:
        """The answer's bytes; None for 404."""

        def ask() -> bytes | None:
            request = urllib.request.Request(f"{self.url}/api/{path}", data=body if body is not None else (b"" if post else None))
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                raise

        return retried(ask, self.retries, self.pause)

    def create(self, **wanted) -> str:
        return (self.call("create", json.dumps(wanted).encode()) or b"").decode().strip().strip('"')

    def start(self, bench_id: str) -> None:
        self.call(f"start/{bench_id}", post=True)

    def next_batch(self, bench_id: str) -> bytes | None:
        return self.call(f"next_batch/{bench_id}")

    def result(self, query: int, bench_id: str, batch: int, body: bytes) -> None:
        self.call(f"result/{query}/{bench_id}/{batch}", body)

    def end(self, bench_id: str) -> str:
        return (self.call(f"end/{bench_id}", post=True) or b"").decode()

    def batches(self, bench_id: str, limit: int | None = None) -> Iterator[bytes]:
        n = 0
        while (limit is None or n < limit) and (message := self.next_batch(bench_id)) is not None:
            yield message
            n += 1


class _Options:
    def __init__(self, options: dict):
        self.service = Service(options["url"], int(options.get("retries", 10)), float(options.get("pause", 3)))
        self.bench_id = options["bench_id"]
        self.limit = int(options["limit"]) if "limit" in options else None
        self.query = int(options.get("query", 0))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # the service hands out one batch after another

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = _Options(self.options)
        for message in o.service.batches(o.bench_id, o.limit):
            yield (message,)


class _StreamReader(SimpleDataSourceStreamReader):
    """Up to ``per_trigger`` batches each time; the service doesn't repeat itself, so what was read is kept until committed."""

    def __init__(self, options: dict):
        self.options, self.kept, self.done = options, [], False

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        o, rows, at = _Options(self.options), [], start["at"]
        while len(rows) < int(self.options.get("per_trigger", 16)) and not self.done:
            message = o.service.next_batch(o.bench_id) if o.limit is None or at < o.limit else None
            if message is None:
                self.done = True
                break
            rows.append((message,))
            at += 1
        self.kept.append((start["at"], rows))
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for at, rows in self.kept:
            if start["at"] <= at < end["at"]:
                yield from rows

    def commit(self, end: dict) -> None:
        self.kept = [(at, rows) for at, rows in self.kept if at >= end["at"]]


class _Writer(DataSourceWriter, DataSourceStreamWriter):
    """Posts each row (batch_id, body); a repeated batch is the service's to ignore."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, rows: Iterator) -> WriterCommitMessage:
        o = _Options(self.options)
        for row in rows:
            o.service.result(o.query, o.bench_id, row["batch_id"], row["body"].encode())
        return WriterCommitMessage()

    def commit(self, messages, batchId=None) -> None:
        pass

    def abort(self, messages, batchId=None) -> None:
        pass


class HttpBatches(DataSource):
    """``spark.read.format("http_batches").option("url", …).option("bench_id", …)``, the same for streams and writers."""

    @classmethod
    def name(cls) -> str:
        return "http_batches"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options)


def http_batches(spark: SparkSession, url: str, bench_id: str, limit: int | None = None, **options) -> DataFrame:
    spark.dataSource.register(HttpBatches)
    wanted = {"url": url, "bench_id": bench_id, **options} | ({"limit": limit} if limit is not None else {})
    return spark.read.format("http_batches").options(**wanted).load()


def push_results(results: DataFrame, url: str, bench_id: str, query: int = 0, **options) -> None:
    """Post rows (batch_id, body), the first of each batch only if the caller kept it so."""
    results.sparkSession.dataSource.register(HttpBatches)
    results.select("batch_id", "body").write.format("http_batches").options(url=url, bench_id=bench_id, query=query, **options).mode("append").save()
