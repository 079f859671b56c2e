"""Streaming pipelines: dispatch micro-batches to topic handlers, with statistics and a dead-letter table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial, reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.operators import stats
from sluice.operators.ranking import newest
from sluice.operators.routing import Route, route
from sluice.operators.scripts import Console, Context, Handler
from sluice.session import shared_dir
from sluice.sinks.http import RESULTS
from sluice.sinks.journal import Journal
from sluice.sinks.tables import read_epochs, write_epoch


class RestError(RuntimeError):
    """A handler's HTTP requests did not all return 200."""


class ConversionError(RuntimeError):
    """A message could not be converted."""


def error_kind(error: BaseException) -> str:
    """``compile`` for a script that does not analyse, ``rest``, ``convert``, else ``expression``."""
    if isinstance(error, AnalysisException):
        return "compile"
    if isinstance(error, RestError):
        return "rest"
    if isinstance(error, ConversionError):
        return "convert"
    return "expression"


# One row of the journal; each kind fills its own columns.
JOURNAL = (
    "topic string, partition int, offset bigint, handler string, error_kind string, error string, key string, message string, "
    "content string, headers map<string,string>, timestamp bigint, records bigint, batches bigint, failed boolean, "
    "stream string, seq int, line string"
)
DEAD = ("topic", "partition", "offset", "handler", "error_kind", "error", "key", "content", "headers", "timestamp", "pipeline", "epoch")
RECENT = ("topic", "`partition`", "`offset`", "key", "message", "content AS value", "timestamp", "pipeline", "epoch")
LOGS = "stream string, seq int, line string"


@dataclass
class Tables:
    """Folders a pipeline writes to, below one base folder."""

    base: str

    def output(self, handler: str) -> str:
        # a handler may be named like a path
        return f"{self.base}/output/handler={quote(handler, safe='')}"

    @property
    def journal(self) -> str:
        return f"{self.base}/journal"

    @property
    def http(self) -> str:
        return f"{self.base}/http"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"


def _failed(failures: Mapping[str, object]) -> Column:
    return F.col("handler").isNull() | F.col("handler").isin(*failures)


def _newest(kind: str, rows: DataFrame) -> DataFrame:
    """Of records or errors the newest; more records than errors are kept."""
    order = [F.desc("timestamp"), F.desc("offset"), F.asc("topic"), F.asc("partition")]
    n = stats.RECENT_RECORDS if kind == "record" else stats.ERRORS
    return newest(rows.withColumn("_kind", F.lit(kind)), ["_kind"], order, n, "offset", "_recency").drop("_kind", "_recency")


def _totals(rows: DataFrame) -> DataFrame:
    """Counts of several epochs as the journal has those of one."""
    summed = rows.groupBy("topic", "failed").agg(F.sum("records").alias("records"), F.sum("batches").alias("batches"), F.max("epoch").alias("epoch"))
    return _journaled(summed, keep=("epoch",))


def _journaled(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with all columns of the journal, NULL where they have none."""
    columns = T._parse_datatype_string(JOURNAL).fields
    named = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns]
    return rows.select(*named, *keep)


# Counts add up and newest lists are lists of their newest; console lines stay as they are. Dead letters are not merged.
MERGES = {"stat": _totals, "record": partial(_newest, "record"), "error": partial(_newest, "error"), "log": lambda rows: rows}


@dataclass
class Pipeline:
    """Routes, handlers and tables of one pipeline."""

    name: str
    routes: list[Route]
    handlers: Mapping[str, Handler]
    tables: Tables
    context: Context = field(default_factory=Context)
    _unrouted: bool = False

    def dispatch(self, batch: DataFrame, epoch: int) -> int:
        """Run each handler on its topics' messages; returns the number of messages.

        A failing handler does not stop the stream: its messages go to the dead-letter table with the
        error, as do messages without a route. All tables are written per epoch, so a replay after a
        failure overwrites instead of adding. Beside the handlers' own jobs there are one that counts
        and one that writes the journal.
        """
        spark = batch.sparkSession
        routed = route(batch, self.routes).persist()
        try:
            # one row per configured handler, however many messages or topics there are
            counts = {r["handler"]: r["n"] for r in routed.groupBy("handler").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not counts:
                return 0
            self.context.console = Console(self.name)
            self._unrouted = None in counts
            failures: dict[str, tuple[str, str]] = {}
            for handler in sorted(h for h in counts if h is not None):
                try:
                    self._run(handler, routed.where(F.col("handler") == handler).drop("route_error"), epoch)
                except Exception as error:
                    failures[handler] = (error_kind(error), f"{type(error).__name__}: {error}")
                    self.context.console.err(f"{handler}: {type(error).__name__}")
            self.journal.write(self._rows(routed, failures), epoch)
            return sum(counts.values())
        finally:
            routed.unpersist()

    def _run(self, name: str, messages: DataFrame, epoch: int) -> None:
        if name not in self.handlers:
            raise ConversionError(f"no handler named {name}")
        self.context.keep = lambda sent: self._kept(name, sent, epoch)
        produced = self.handlers[name](messages, self.context)
        if produced is not None:
            write_epoch(produced, self.tables.output(name), self.name, epoch)

    def _kept(self, handler: str, sent: DataFrame, epoch: int) -> DataFrame:
        """Write a handler's HTTP results, which sends its requests, and read them back."""
        rows = sent.select("topic", "partition", "offset", "results")
        write_epoch(rows, f"{self.tables.http}/handler={quote(handler, safe='')}", self.name, epoch)
        written = f"{self.tables.http}/handler={quote(handler, safe='')}/pipeline={self.name}/epoch={epoch}"
        return sent.sparkSession.read.schema(rows.schema).parquet(written)

    @property
    def journal(self) -> Journal:
        return Journal(f"{self.tables.journal}/pipeline={quote(self.name, safe='')}", JOURNAL, MERGES)

    def _rows(self, routed: DataFrame, failures: dict[str, tuple[str, str]]) -> DataFrame:
        """All that an epoch adds to the journal, as one table for one write.

        Dead letters have all that it takes to send the message again. Of the newest records and failed records more than
        an epoch's own newest cannot be among the newest overall.
        """
        kind, text = F.when(F.col("handler").isNull(), "compile"), F.when(F.col("handler").isNull(), F.col("route_error"))
        for handler, (failed_kind, failed_text) in failures.items():
            kind = kind.when(F.col("handler") == handler, failed_kind)
            text = text.when(F.col("handler") == handler, failed_text)
        failed = _failed(failures)
        letters = routed.where(failed).select(
            "topic", "partition", "offset", "handler", kind.alias("error_kind"), text.alias("error"),
            F.to_json("key").alias("key"), F.to_json("content").alias("content"), "headers", "timestamp",
        )
        places = routed.select("topic", "partition", "offset", "key", "content", "timestamp", failed.alias("_failed"))

        def recent(name: str) -> DataFrame:
            # texts are made for the few rows that stay
            kept = _newest(name, places if name == "record" else places.where("_failed"))
            return kept.select(
                "topic", "partition", "offset", stats.coords(F.col("topic"), F.col("offset"), F.col("partition"), F.col("key"))["key"].alias("key"),
                stats.batch_message(F.col("topic"), F.col("partition"), F.col("offset")).alias("message"), F.to_json("content").alias("content"), "timestamp")

        counted = routed.groupBy("topic", "handler").agg(F.count(F.lit(1)).alias("records")).select(
            "topic", "handler", "records", F.lit(1).cast("bigint").alias("batches"), failed.alias("failed"))
        lines = [(s, n, t) for n, (s, t) in enumerate(self.context.console.lines)]
        parts = {"stat": counted, "record": recent("record")}
        if failures or self._unrouted:
            parts |= {"dead": letters, "error": recent("error")}
        if lines:
            parts["log"] = routed.sparkSession.createDataFrame(lines, LOGS)
        return reduce(DataFrame.unionByName, [_journaled(rows).withColumn("kind", F.lit(name)) for name, rows in parts.items()])

    def start(self, messages: DataFrame, trigger: Mapping[str, object]) -> StreamingQuery:
        """Start the stream. Offsets are committed after ``dispatch`` returns: at least once."""
        return (
            messages.writeStream.queryName(self.name)
            .option("checkpointLocation", self.tables.checkpoint)
            .trigger(**trigger)
            .foreachBatch(lambda batch, epoch: self.dispatch(batch, epoch) and None)
            .start()
        )

    def output(self, spark: SparkSession, handler: str, schema: str) -> DataFrame:
        return read_epochs(spark, self.tables.output(handler), schema)

    def _journal(self, spark: SparkSession, kind: str) -> DataFrame:
        return self.journal.read(spark, kind).withColumn("pipeline", F.lit(self.name))

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return self._journal(spark, "dead").select(*DEAD)

    def statistics(self, spark: SparkSession) -> DataFrame:
        """Records, batches and failed batches per topic, over all epochs."""
        return self._journal(spark, "stat").groupBy("pipeline", "topic").agg(
            F.sum("records").alias("total_records"),
            F.sum("batches").alias("total_batches"),
            F.sum(F.when(F.col("failed"), F.col("batches")).otherwise(0)).alias("failed_batches"),
        )

    def recent_records(self, spark: SparkSession) -> DataFrame:
        """The newest records of all topics."""
        return _newest("record", self._journal(spark, "record")).selectExpr(*RECENT)

    def recent_errors(self, spark: SparkSession) -> DataFrame:
        """The newest failed records of all topics."""
        return _newest("error", self._journal(spark, "error")).selectExpr(*RECENT)

    def http_results(self, spark: SparkSession) -> DataFrame:
        """The results that handlers kept, one row a message: as text, as JSON, and whether all were answered with 200."""
        rows = read_epochs(spark, self.tables.http, f"topic string, partition int, offset bigint, results {RESULTS}, handler string")
        results = F.col("results")
        return rows.select(
            "topic", "partition", "offset", "handler", stats.results_text(results).alias("message"),
            F.to_json(stats.results_json(results)).alias("json"), stats.all_ok(results).alias("ok"), "pipeline", "epoch")

    def console(self, spark: SparkSession) -> DataFrame:
        """Handler output, newest first."""
        return self._journal(spark, "log").select("stream", "seq", "line", "pipeline", "epoch").orderBy(F.desc("epoch"), F.desc("seq"))


@dataclass
class Running:
    id: str
    config: str
    started_at: int
    pipeline: Pipeline
    query: StreamingQuery


class Manager:
    """Starts, stops and lists pipelines of one session."""

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark = spark
        self.base = base or shared_dir(spark, "pipelines")
        self._running: dict[str, Running] = {}
        self._known: dict[str, Pipeline] = {}

    def start(self, messages: DataFrame, routes: list[Route], handlers: Mapping[str, Handler], *,
              trigger: Mapping[str, object] | None = None, config: str = "", context: Context | None = None,
              name: str | None = None) -> str:
        """Start a pipeline and return its id. The same ``name`` resumes from its checkpoint."""
        id_ = name or uuid.uuid4().hex
        if id_ in self._running and self._running[id_].query.isActive:
            raise ValueError(f"pipeline {id_} is already running")
        pipeline = Pipeline(id_, routes, handlers, Tables(f"{self.base}/{id_}"), context or Context())
        query = pipeline.start(messages, trigger or {"processingTime": "10 seconds"})
        self._known[id_] = pipeline
        self._running[id_] = Running(id_, config, time.time_ns(), pipeline, query)
        return id_

    def stop(self, id_: str) -> bool:
        """Stop a pipeline; False if it was not running."""
        found = self._running.pop(id_, None)
        if found is None or not found.query.isActive:
            return False
        found.query.stop()
        return True

    def running(self) -> list[Running]:
        """Running pipelines by start time; those that have ended or failed are none."""
        return sorted((r for r in self._running.values() if r.query.isActive), key=lambda r: r.started_at)

    def pipeline(self, id_: str) -> Pipeline | None:
        """A pipeline this manager has started, also after it was stopped."""
        return self._known.get(id_)

    def stats(self, id_: str) -> DataFrame | None:
        """Statistics of a pipeline, None if it is not known."""
        found = self.pipeline(id_)
        return found.statistics(self.spark) if found else None

    def input_rows(self, id_: str) -> int:
        """Messages a pipeline has dispatched, in all its micro-batches."""
        known = self.stats(id_)
        return 0 if known is None else known.agg(F.sum("total_records")).first()[0] or 0


def run_once(messages: DataFrame, pipeline: Pipeline, timeout: int | None = None) -> None:
    """Process all available input, then stop; a failed stream raises."""
    query = pipeline.start(messages, {"availableNow": True})
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
