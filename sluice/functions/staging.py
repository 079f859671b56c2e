"""Compute an expensive expression once per row, however often later steps use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns whose formulas later filters must not repeat.

    The optimizer copies a formula into every filter pushed below its projection, and a JSON
    accessor mentions its input several times. Passing the values through a one-element ``explode``
    keeps them; filters on other columns still move down to the scan. The values are computed even
    when nothing reads them, so use this only for columns that are read.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    names = [*df.columns, *(n for n in columns if n not in df.columns)]
    # a projection computes repeated parts once, a generator does not: compute first, then hold
    made = df.select(*others, *[c.alias(f"_new_{n}") for n, c in columns.items()])
    held = F.explode(F.array(F.struct(*[F.col(f"`_new_{n}`").alias(n) for n in columns])))
    staged = made.select(*others, held.alias("_held"))
    return staged.select(*[F.col("_held")[n].alias(n) if n in columns else F.col(f"`{n}`") for n in names])
