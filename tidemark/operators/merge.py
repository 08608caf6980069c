"""Merging sorted runs, and which versions a compaction keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_SEQ


def by_age() -> WindowSpec:
    """Versions of each key, the newest first."""
    return W.partitionBy("user_key").orderBy(F.desc("seq"), "vtype")


def merge(*runs: DataFrame) -> DataFrame:
    """All versions of all runs, duplicates kept, by key ascending and seq descending."""
    return reduce(DataFrame.unionByName, runs).orderBy("user_key", F.desc("seq"), "vtype")


def annotate(log: DataFrame, oldest: int, covered: Column | None = None) -> DataFrame:
    """Add ``fate``: kept, superseded (a newer version is visible to the oldest snapshot) or tombstone.

    ``covered``: whether a deeper file's range holds the key; a deletion may go
    only where it is false. Without it every level is taken for the last one.
    The neighbour is the version before in the input, kept or not.
    """
    newer = F.lag("seq").over(by_age())
    base = F.lit(True) if covered is None else ~covered
    fate = F.when(F.coalesce(newer <= oldest, F.lit(False)), "superseded").when((F.col("vtype") == DELETE) & (F.col("seq") <= oldest) & base, "tombstone").otherwise("kept")
    return log.withColumn("fate", fate)


def mark_covered(log: DataFrame, deeper: DataFrame, out: str = "covered") -> DataFrame:
    """Add whether any range (smallest, largest) of ``deeper`` holds the key.

    Ranges are a file's metadata: thousands where the log has billions. The
    keys are tested once each, and only those of deletions.
    """
    keys = log.where(F.col("vtype") == DELETE).select("user_key").distinct()
    hit = keys.join(deeper.select("smallest", "largest"), F.col("user_key").between(F.col("smallest"), F.col("largest")), "left_semi").withColumn(out, F.lit(True))
    return log.join(hit, "user_key", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def retain(log: DataFrame, oldest: int = MAX_SEQ, deeper: DataFrame | None = None) -> DataFrame:
    """The versions that a compaction keeps for snapshots at ``oldest`` and above."""
    cols = log.columns
    if deeper is None:
        kept = annotate(log, oldest)
    else:
        kept = annotate(mark_covered(log, deeper), oldest, F.col("covered"))
    return kept.where("fate = 'kept'").select(*cols)


def gc_stats(log: DataFrame, oldest: int) -> DataFrame:
    """user_key with the number of versions of each fate."""
    n = lambda f: F.sum(F.when(F.col("fate") == f, 1).otherwise(0)).cast("long")
    return annotate(log, oldest).groupBy("user_key").agg(n("kept").alias("kept"), n("superseded").alias("superseded"), n("tombstone").alias("tombstones"))


def revived(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a put right above a deletion."""
    below = F.lead("vtype").over(by_age())
    return log.withColumn("__b", below).withColumn("__n", F.row_number().over(by_age())).where((F.col("__n") == 1) & (F.col("vtype") != DELETE) & (F.col("__b") == DELETE)).select("user_key", "seq")
