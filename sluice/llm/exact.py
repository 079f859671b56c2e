"""Exact duplicates by most-significant-byte-first radix partitioning.

Documents are split by successive runs of bytes of their normalised text until a group has one member or
its texts have ended. Each round compares the bytes themselves, so equality rests on no digest. A round
shuffles only the documents that still share a group, and every run is longer than the one before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sluice.llm.shared import fresh, numbered, staged, text_or_empty, without_blanks

FIRST_RUN, GROWTH = 32, 16


def exact_groups(rows: DataFrame, text_column: str = "text", id_column: str = "doc_id", row_column: str = "_rid") -> DataFrame:
    """One row per row of a numbered table: its group's size and which document stays.

    Texts are equal when identical without ASCII white space; null counts as empty. The document with the
    most code points stays, then the smallest id, then the smallest row number, so of repeated rows one
    stays; a null id comes last. Columns: the row number, ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` of the normalised text.
    """
    text = text_or_empty(text_column)
    plain = without_blanks(text)
    active = rows.select(
        F.col(row_column).alias("_rid"), F.col(f"`{id_column}`").alias("doc_id"), F.length(text).alias("_n"),
        F.sha2(plain, 256).alias("text_sha256"), F.lit(0).cast("long").alias("_gid"), plain.cast("binary").alias("_rest"),
    )
    done, width = [], FIRST_RUN
    best = F.struct(-F.col("_n"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    while True:
        run = active.withColumn("_run", F.substring("_rest", 1, width))
        groups = run.groupBy("_gid", "_run").agg(F.count("*").alias("_size"), F.min(best).alias("_best"))
        shared = staged(groups.where("_size > 1").withColumn("_next", F.monotonically_increasing_id()), "radix-groups")
        split = run.withColumn("_rest", F.expr(f"substring(_rest, {width + 1})")).join(
            shared.hint("merge"), ["_gid", "_run"], "left")
        ended = F.col("_next").isNull() | (F.octet_length("_run") < width)
        round_ = staged(split.select(
            "_rid", "doc_id", "_n", "text_sha256", "_next", "_size", "_best", ended.alias("_ended"),
            F.when(~ended, F.col("_rest")).alias("_rest")), "radix-rows")
        done.append(round_.where("_ended").select(
            "_rid", "doc_id", F.coalesce(F.col("_best.id"), F.when(F.col("_next").isNull(), F.col("doc_id"))).alias("keep_id"),
            F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("_best.rid") == F.col("_rid"), F.lit(True)).alias("kept"), "text_sha256"))
        active = round_.where("NOT _ended").select(
            "_rid", "doc_id", "_n", "text_sha256", F.col("_next").alias("_gid"), "_rest")
        if active.isEmpty():
            return reduce(DataFrame.unionAll, done)
        width *= GROWTH


def without_copies(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns."""
    rid = fresh(docs, "_rid")
    table = numbered(docs, "radix-input", rid)
    kept = exact_groups(table, text_column, id_column, rid).where("kept").select(F.col("_rid").alias(rid))
    return table.join(kept, rid, "left_semi").drop(rid)
