"""Keyed documents as a change log: upserts, deletes, lookups and listings by path prefix.

A change log has the columns ``seq`` (integral, unique), ``path``, ``op`` (``put`` or ``delete``) and ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators.ranking import BUCKET_WIDTH, LEVELS, with_previous


def current(log: DataFrame) -> DataFrame:
    """Latest document per path; deleted paths are absent. Folds before its only shuffle."""
    last = log.groupBy("path").agg(F.max_by(F.struct("op", "body", "seq"), "seq").alias("last"))
    return last.where(F.col("last.op") == "put").select("path", "last.body", "last.seq")


def outcomes(log: DataFrame, width: int = BUCKET_WIDTH, levels: int = LEVELS) -> DataFrame:
    """Each change with ``existed``: whether the path held a document before it.

    ``status`` is 201 for a created and 200 for an updated document, 200 or 410 for a delete of an
    existing or a missing one.
    """
    seen = with_previous(log, ["path"], "seq", "op", "_before", width, levels)
    existed = F.coalesce(F.col("_before") == "put", F.lit(False))
    status = F.when(F.col("op") == "put", F.when(existed, 200).otherwise(201)).otherwise(F.when(existed, 200).otherwise(410))
    return seen.withColumns({"existed": existed, "status": status}).drop("_before")


def lookup(paths: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of the asked paths; a missing one has status 410 and no body."""
    found = paths.join(documents.select("path", "body", F.lit(True).alias("_found")), "path", "left")
    return found.withColumn("status", F.when(F.col("_found"), 200).otherwise(410)).drop("_found")


def listing(documents: DataFrame, prefix: str | Column) -> DataFrame:
    """Children of a path: documents as ``leaf`` with their full path, deeper levels once as ``dir``.

    The path of a document lists that document.
    """
    base = F.lit(prefix) if isinstance(prefix, str) else prefix
    below = (base == "") | F.startswith(F.col("path"), F.concat(base, F.lit("/")))
    rest = F.when(base == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length(base) + 2, F.length("path")))
    segment = F.substring_index(rest, "/", 1)
    is_leaf = ~rest.contains("/")
    itself = F.col("path") == base
    return (
        documents.where(itself | below)
        .select(
            F.when(itself | is_leaf, "leaf").otherwise("dir").alias("kind"),
            F.when(itself | is_leaf, F.col("path")).otherwise(segment).alias("name"),
        )
        .distinct()
    )
