"""Pipeline statistics: totals, newest records, outcomes and HTTP results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import dynamic as D, http as H, text as X
from sluice.operators.ranking import newest

# How many entries the statistics keep.
RECENT_RECORDS = 100
RECENT_OUTCOMES = 20
ERRORS = 20


def totals(df: DataFrame, pipeline: str = "pipeline") -> DataFrame:
    """Records per pipeline."""
    return df.groupBy(pipeline).agg(F.count(F.lit(1)).alias("total_records"))


def recent(df: DataFrame, order: list[Column], spread: str, pipeline: str = "pipeline", n: int = RECENT_RECORDS) -> DataFrame:
    """The newest ``n`` records per pipeline; rank 1 is the newest."""
    return newest(df, [pipeline], order, n, spread, "recency")


def coords(topic: Column, offset: Column, partition: Column, key: Column) -> Column:
    """Record coordinates; a NULL key reads ``NULL``."""
    return F.struct(
        topic.alias("topic"),
        offset.alias("offset"),
        partition.alias("partition"),
        F.coalesce(F.when(key.isNotNull(), D.as_string(key)), F.lit("NULL")).alias("key"),
    )


def batch_message(topic: Column, partition: Column, offset: Column) -> Column:
    """``topic partition:offset``"""
    return F.concat(topic, F.lit(" "), X.position(partition, offset))


def outcome_totals(df: DataFrame, outcome: str = "failed", batch: tuple[str, ...] = ("chunk", "topic"),
                   pipeline: str = "pipeline") -> DataFrame:
    """Records, batches and failed batches per pipeline, from records marked with their batch's outcome.

    Records are first folded to one row per batch, so nothing is gathered per pipeline but counts.
    """
    keys = list(dict.fromkeys([pipeline, *batch]))
    per_batch = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.bool_or(outcome).alias("failed"))
    return per_batch.groupBy(pipeline).agg(
        F.sum("records").alias("total_records"),
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if("failed").alias("failed_batches"),
    )


def recent_outcomes(df: DataFrame, order: list[Column], spread: str, pipeline: str = "pipeline",
                    n: int = RECENT_OUTCOMES) -> DataFrame:
    return newest(df, [pipeline], order, n, spread, "recency")


def recent_errors(df: DataFrame, order: list[Column], spread: str, outcome: str = "failed", pipeline: str = "pipeline",
                  n: int = ERRORS) -> DataFrame:
    """The newest failed records per pipeline."""
    return newest(df.where(F.col(outcome)), [pipeline], order, n, spread, "recency")


def result_text(result: Column) -> Column:
    """``url yields code``, or ``Error: `` and why there was no response."""
    url = result["request"]["url"]
    answered = F.concat(url, F.lit(" yields "), result["response"]["statusCode"].cast("string"))
    return F.coalesce(answered, F.concat(F.lit("Error: "), _error(result)))


def _error(result: Column) -> Column:
    """The sink's error; without one, that no response came."""
    return F.coalesce(result["error"], F.concat(F.lit("no response from "), F.coalesce(result["request"]["url"], F.lit("an unknown address"))))


def results_text(results: Column) -> Column:
    """Text of one record's HTTP results, an array of STRUCT(request, response, error, ..) as the sink gives it."""
    lines = F.transform(results, result_text)
    many = F.concat(F.size(results).cast("string"), F.lit(" requests: [\n"), F.array_join(lines, "\n"), F.lit("\n]"))
    return F.when(F.size(results) == 1, F.element_at(lines, 1)).otherwise(many)


def results_json(results: Column) -> Column:
    """JSON of one record's HTTP results: one object, or an array unless there is exactly one.

    A request without a response gives an object with the field ``error``, which says why.
    """

    def object_(r: Column) -> Column:
        answered = F.struct(H.to_json(r["request"]).alias("request"), H.response_json(r["response"]).alias("response"))
        failed = F.struct(_error(r).alias("error"))
        return F.when(r["response"].isNull(), F.to_variant_object(failed)).otherwise(F.to_variant_object(answered))

    objects = F.transform(results, object_)
    return F.when(F.size(results) == 1, F.element_at(objects, 1)).otherwise(F.to_variant_object(objects))


def all_ok(results: Column) -> Column:
    """True when every response of the record has status 200; a request without a response failed."""
    return F.forall(results, lambda r: F.coalesce(r["response"]["statusCode"] == 200, F.lit(False)))


def rest_failures(df: DataFrame, results: str = "results") -> DataFrame:
    """Records with a non-200 response, each with all of its results."""
    return df.where(~all_ok(F.col(results))).withColumn(
        "error", F.concat(F.lit("Not all rest results returned successfully: "), results_text(F.col(results)))
    )
