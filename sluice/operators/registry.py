"""Reports over a schema registry table: subject, version, id, schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.functions import text as X
from sluice.operators.ranking import newest


def versions(registry: DataFrame) -> DataFrame:
    """Distinct versions per subject."""
    return registry.select("subject", "version").distinct()


def latest(registry: DataFrame) -> DataFrame:
    """Highest version of each subject, with its id and schema."""
    best = registry.groupBy("subject").agg(F.max_by(F.struct("version", "id", "schema"), "version").alias("m"))
    return best.select("subject", "m.version", "m.id", "m.schema")


def summary(registry: DataFrame) -> DataFrame:
    """Number of versions and the latest version per subject."""
    return versions(registry).groupBy("subject").agg(
        F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest")
    )


def version_text(registry: DataFrame) -> DataFrame:
    """``  subject: [v1,v2]`` per subject. The line holds each distinct version once."""
    listed = versions(registry).groupBy("subject").agg(F.sort_array(F.collect_list("version")).alias("v"))
    numbers = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return listed.select("subject", F.concat(F.lit("  "), "subject", F.lit(": ["), numbers, F.lit("]")).alias("line"))


def subject_kinds(subjects: DataFrame) -> DataFrame:
    """Each distinct subject as (kind, name): ``key`` and ``value`` subjects without their suffix, ``other``."""
    subject = F.col("subject")
    kind = F.when(subject.endswith("-key"), "key").when(subject.endswith("-value"), "value").otherwise("other")
    return subjects.select("subject").distinct().select(kind.alias("kind"), X.strip_suffix(subject).alias("name"))


def sorted_kinds(subjects: DataFrame) -> DataFrame:
    """``subject_kinds`` in order of kind and name, by a range-partitioned sort."""
    return subject_kinds(subjects).orderBy("kind", "name")


def topic_subjects(topics: DataFrame, registry: DataFrame) -> DataFrame:
    """For each topic its latest key, value and plain subject, NULL where the registry has none.

    One join on the topic name: the registry is folded to one row per topic first.
    """
    newest_schema = latest(registry)
    bare = X.strip_suffix(F.col("subject"))
    as_suffixed = newest_schema.where(bare != F.col("subject")).select(
        bare.alias("topic"), F.when(F.col("subject").endswith("-key"), "key").otherwise("value").alias("kind"),
        "subject", "version", "schema",
    )
    as_plain = newest_schema.select(F.col("subject").alias("topic"), F.lit("other").alias("kind"), "subject", "version", "schema")
    entry = F.struct("subject", "version", "schema")
    by_topic = as_suffixed.unionByName(as_plain).groupBy("topic").agg(
        *[F.max(F.when(F.col("kind") == k, entry)).alias(k) for k in ("key", "value", "other")]
    )
    wanted = topics.select(X.strip_suffix(F.col("topic")).alias("topic")).distinct()
    return wanted.join(by_topic, "topic", "left")


def previous_pairs(registry: DataFrame) -> DataFrame:
    """Latest and previous schema of every subject with more than one version."""
    once = registry.dropDuplicates(["subject", "version"])
    ranked = newest(once, ["subject"], [F.desc("version")], 2, "version", "age")
    pair = ranked.groupBy("subject").agg(
        *[F.max(F.when(F.col("age") == age, F.col(c))).alias(f"{label}_{c}")
          for age, label in ((2, "previous"), (1, "latest")) for c in ("version", "schema")]
    )
    return pair.where(F.col("previous_version").isNotNull())
