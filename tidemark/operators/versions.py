"""Reads of a change log: latest and point-in-time values, lookups of many keys, ordered scans.

A log is any DataFrame with user_key, seq, vtype and value. A deletion is a
version, so it is dropped only after the newest visible version is chosen; the
bound on seq goes below that choice, where the scan can use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_SEQ


def by_age() -> WindowSpec:
    """Versions of each key, the newest first."""
    return W.partitionBy("user_key").orderBy(F.desc("seq"), "vtype")


def newest(log: DataFrame, seq: int = MAX_SEQ) -> DataFrame:
    """The newest version of each key with seq at most ``seq``, deletions included.

    Row-number 1 becomes a window group limit on both sides of the exchange:
    what is sent is a row for each key and task.
    """
    if seq < MAX_SEQ:
        log = log.where(F.col("seq") <= seq)
    return log.withColumn("__n", F.row_number().over(by_age())).where("__n = 1").drop("__n")


def as_of(log: DataFrame, seq: int = MAX_SEQ) -> DataFrame:
    """user_key, value visible at ``seq``."""
    return newest(log, seq).where(F.col("vtype") != DELETE).select("user_key", "value")


def get(log: DataFrame, key, seq: int = MAX_SEQ) -> DataFrame:
    """The visible value of one key; the equality reaches the scan where user_key is a stored column."""
    return as_of(log.where(F.col("user_key") == F.lit(key)), seq)


def history(log: DataFrame) -> DataFrame:
    """All versions with their depth, 1 for the newest."""
    return log.withColumn("depth", F.row_number().over(by_age()).cast("long"))


def status(log: DataFrame, probes: DataFrame, seq: int = MAX_SEQ) -> DataFrame:
    """user_key, status (missing, deleted, present), value for every probe.

    Only the probes' keys are versioned: the log is cut by a semi join first.
    """
    keys = probes.select("user_key").distinct()
    found = newest(log.join(keys, "user_key", "left_semi"), seq).select("user_key", "vtype", "value")
    state = F.when(F.col("vtype").isNull(), "missing").when(F.col("vtype") == DELETE, "deleted").otherwise("present")
    return probes.join(found, "user_key", "left").select("user_key", state.alias("status"), F.when(F.col("vtype") != DELETE, F.col("value")).alias("value"))


def multi_get(log: DataFrame, probes: DataFrame, seq: int = MAX_SEQ) -> DataFrame:
    """user_key, value for every probe; null where nothing is visible."""
    return status(log, probes, seq).select("user_key", "value")


def lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """user_key, at, seq, value: for each probe (user_key, at) the newest version with seq at most ``at``; a deletion is null.

    Probes are sorted in among the versions of their key and take the last one
    before them: one exchange by key, no pairs of probes and versions.
    """
    both = log.select("user_key", F.col("seq").alias("__at"), F.lit(0).alias("__p"), F.struct("seq", "vtype", "value").alias("__v")).unionByName(
        probes.select("user_key", F.col("at").alias("__at"), F.lit(1).alias("__p"), F.lit(None).cast(log.select(F.struct("seq", "vtype", "value")).schema[0].dataType).alias("__v"))
    )
    w = W.partitionBy("user_key").orderBy("__at", "__p").rowsBetween(W.unboundedPreceding, 0)
    hit = both.withColumn("__l", F.last("__v", ignorenulls=True).over(w)).where("__p = 1")
    live = F.col("__l.vtype") != DELETE
    return hit.select("user_key", F.col("__at").alias("at"), F.when(live, F.col("__l.seq")).alias("seq"), F.when(live, F.col("__l.value")).alias("value"))


def scan(log: DataFrame, seq: int = MAX_SEQ, low=None, high=None, prefix=None, limit: int | None = None) -> DataFrame:
    """Visible pairs in ascending order of keys. Bounds (inclusive), prefix and limit are extensions; bounds reach the scan."""
    if low is not None:
        log = log.where(F.col("user_key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("user_key") <= F.lit(high))
    if prefix is not None:
        log = log.where(F.startswith(F.col("user_key"), F.lit(prefix)))
    out = as_of(log, seq).orderBy("user_key")
    return out if limit is None else out.limit(limit)


def lower_bound(keys: DataFrame, targets: DataFrame, chars: int = 3, value: str | None = None) -> DataFrame:
    """target, user_key (and ``value``): the smallest key at or above each target, null if there is none.

    With ``value`` a key's smallest value goes along. Targets are sorted in
    among the keys that share their first characters and take the first key
    after them; where none follows, the head of the next prefix, from a table of
    one row for each prefix. No pairs of keys and targets are formed.
    """
    own = F.struct("user_key", *([value] if value else []))
    k = keys.select(F.col("user_key").alias("__k"), own.alias("__v"), F.lit(1).alias("__f"))
    t = targets.select(F.col("target").alias("__k"), F.lit(None).cast(k.schema["__v"].dataType).alias("__v"), F.lit(0).alias("__f")).distinct()
    both = k.groupBy("__k", "__f").agg(F.min("__v").alias("__v")).select("__k", "__v", "__f").unionByName(t).withColumn("__p", F.substring("__k", 1, chars))
    heads = both.groupBy("__p").agg(F.min_by("__v", F.when(F.col("__f") == 1, F.col("__k"))).alias("__h"))
    after = heads.withColumn("__c", F.first("__h", ignorenulls=True).over(W.orderBy("__p").rowsBetween(1, W.unboundedFollowing))).select("__p", "__c")
    w = W.partitionBy("__p").orderBy("__k", "__f").rowsBetween(0, W.unboundedFollowing)
    met = both.withColumn("__n", F.first("__v", ignorenulls=True).over(w)).where("__f = 0").join(after, "__p")
    hit = F.coalesce("__n", "__c")
    return met.select(F.col("__k").alias("target"), hit["user_key"].alias("user_key"), *([hit[value].alias(value)] if value else []))
