"""Epochs merged in levels: what counts, what is read, what a replay changes."""

import random

from pyspark.sql import functions as F

from sluice import session
from sluice.sinks.journal import Journal, covering


def test_covering_has_every_epoch_once():
    draw = random.Random(1)
    for fan in (2, 3, 8):
        for n in (1, 5, 17, 64, 200):
            found = {(0, e) for e in range(n)}
            for level in (1, 2, 3):
                width = fan**level
                found |= {(level, s) for s in range(0, n - width + 1, width) if s + width < n}
            kept = covering(found, fan)
            assert sorted(e for level, s in kept for e in range(s, s + fan**level)) == list(range(n))
            # what is merged may be there still, or gone already
            rest = [f for f in found if f in kept or draw.random() < 0.5]
            assert covering(rest, fan) == kept
    assert covering([]) == []


def totals(rows):
    summed = rows.groupBy("topic").agg(F.sum("n").alias("n"), F.max("epoch").alias("epoch"))
    return summed.select("topic", "n", F.lit(None).cast("string").alias("line"), "epoch")


def test_two_hundred_epochs_are_read_from_few_files(spark):
    journal = Journal(session.shared_dir(spark, "journal"), "topic string, n bigint, line string", {"stat": totals, "log": lambda rows: rows}, fan=6)

    def rows_of(*epochs):
        rows = [r for e in epochs for r in (
            ("stat", "a", e, None, e), ("stat", "b", 1, None, e), ("dead", "a", e, "x", e), *([("log", None, None, str(e), e)] if e % 50 == 0 else []))]
        return spark.createDataFrame(rows, "kind string, topic string, n bigint, line string, epoch bigint").coalesce(1)

    for first in range(0, 200, 6):
        journal.write(rows_of(first).drop("epoch"), first)
        if first in (36, 72, 120):
            journal.write(rows_of(first).drop("epoch"), first)
        # the epochs until the next merge in one job, as if one after the other
        later = range(first + 1, min(first + 6, 200))
        if later:
            part = f"{journal.path}-part"
            rows_of(*later).withColumn("_e", F.col("epoch")).write.mode("overwrite").partitionBy("_e", "kind").parquet(part)
            files = journal._files(spark)
            for e in later:
                files.rename(journal._path(spark, f"{part}/_e={e}"), journal._path(spark, journal._folder(0, e)))
                files.create(journal._path(spark, f"{journal._folder(0, e)}/_SUCCESS")).close()
    found = journal.read(spark, "stat")
    # 200 in base 6 is 532: ten folders of one file each or few
    assert len(found.inputFiles()) <= 2 * (5 + 3 + 2)
    assert {r["topic"]: r["n"] for r in found.groupBy("topic").agg(F.sum("n").alias("n")).collect()} == {"a": sum(range(200)), "b": 200}
    assert sorted(int(r["line"]) for r in journal.read(spark, "log").collect()) == [0, 50, 100, 150]
    dead = journal.read(spark, "dead")
    assert sorted(r["epoch"] for r in dead.collect()) == list(range(200))
    # merged parts go, but not those of the last merge
    assert len([f for f in journal.folders(spark) if f[0] == 0 and "kind=stat" in journal._names(spark, journal._folder(*f))]) <= 12
