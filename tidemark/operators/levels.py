"""Runs, levels and ranges: what a store knows of its files, and what to compact next.

``files`` has level, number, file_size, smallest and largest key. It is
metadata, small beside the data; the theta joins below compare files with files
or with one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import L0_STOP, L0_TRIGGER, LEVEL_BASE_BYTES, LEVEL_FACTOR, MAX_SEQ, NUM_LEVELS


def assign_runs(log: DataFrame, entries: int = 1000) -> DataFrame:
    """Number the flushes of a log whose seq is dense: the n-th entry itself triggers one."""
    return log.withColumn("run_no", F.floor((F.col("seq") - 1) / entries).cast("long"))


def run_bounds(runs: DataFrame) -> DataFrame:
    """Entries, smallest and largest key with its seq, for each run."""
    asc, desc = F.struct("user_key", (-F.col("seq")).alias("n")), F.struct("user_key", (-F.col("seq")).alias("n"))
    out = runs.groupBy("run_no").agg(F.count("*").alias("entries"), F.min(asc).alias("a"), F.max(desc).alias("z"))
    return out.select("run_no", "entries", F.col("a.user_key").alias("smallest"), (-F.col("a.n")).alias("smallest_seq"), F.col("z.user_key").alias("largest"), (-F.col("z.n")).alias("largest_seq"))


def memtable_stats(log: DataFrame) -> DataFrame:
    """Entries, bytes of keys and values, last sequence number."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.max("seq").alias("last_seq"))


def oldest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The smallest seq any handle holds, or the maximum if there is none. One row for each handle."""
    return snapshots.agg(F.coalesce(F.min("seq"), F.lit(MAX_SEQ)).alias("oldest"))


def level_limit(level: Column) -> Column:
    return (F.lit(float(LEVEL_BASE_BYTES)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.greatest(level - 1, F.lit(0)))).cast("long")


def level_stats(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files and bytes of each of the levels, empty ones too, and their limit."""
    own = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    every = spark.range(NUM_LEVELS).select(F.col("id").cast("int").alias("level"))
    return every.join(own, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("b", F.lit(0)).cast("long").alias("bytes"), level_limit(F.col("level")).alias("byte_limit"))


def compaction_scores(files: DataFrame) -> DataFrame:
    """level, score of every level that can be compacted: files over the trigger at level 0, bytes over the limit below. The last level has nowhere to go."""
    score = F.when(F.col("level") == 0, F.count("*") / float(L0_TRIGGER)).otherwise(F.sum("file_size") / level_limit(F.col("level")))
    return files.where(F.col("level") < NUM_LEVELS - 1).groupBy("level").agg(score.alias("score")).where("score > 0")


def compaction_score(files: DataFrame) -> DataFrame:
    """level, score of the level most in need; the lowest of equals."""
    return compaction_scores(files).orderBy(F.desc("score"), "level").limit(1)


def must_stall(files: DataFrame) -> DataFrame:
    """Whether writers would wait for a compaction."""
    n = F.count(F.when(F.col("level") == 0, 1))
    return files.agg(n.alias("l0_files"), (n >= L0_STOP).alias("stall"))


def overlap(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    return (F.col(a_high) >= F.col(b_low)) & (F.col(a_low) <= F.col(b_high))


def file_for_key(files: DataFrame, keys: DataFrame) -> DataFrame:
    """user_key, level, number of every file whose range holds a key."""
    return keys.join(files.select("level", "number", "smallest", "largest"), F.col("user_key").between(F.col("smallest"), F.col("largest"))).select("user_key", "level", "number")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """number, other: pairs of files whose ranges meet."""
    b = right.select(F.col("number").alias("other"), F.col("smallest").alias("__lo"), F.col("largest").alias("__hi"))
    return left.join(b, overlap("smallest", "largest", "__lo", "__hi")).select("number", "other")


def envelope(files: DataFrame) -> DataFrame:
    return files.agg(F.min("smallest").alias("__lo"), F.max("largest").alias("__hi"))


def in_envelope(files: DataFrame, of: DataFrame) -> DataFrame:
    """Files that meet the range from the smallest to the largest key of ``of``."""
    return files.join(envelope(of), overlap("smallest", "largest", "__lo", "__hi")).drop("__lo", "__hi")


def pick_inputs(files: DataFrame, level: int, pointer=None) -> DataFrame:
    """role (input, next, grandparent), level, number, file_size of a compaction of ``level``.

    Level 0 goes as a whole; below, the first file past the pointer, or the
    first of all when none is left. The last level has no compaction.
    """
    if level + 1 >= NUM_LEVELS:
        return files.where("false").select(F.lit("input").alias("role"), "level", "number", "file_size")
    own = files.where(F.col("level") == level)
    if level > 0:
        past = F.lit(0) if pointer is None else F.when(F.col("largest") > F.lit(pointer), 0).otherwise(1)
        own = own.withColumn("__p", past).orderBy("__p", "smallest", "number").limit(1).drop("__p")
    below = in_envelope(files.where(F.col("level") == level + 1), own)
    both = own.select(*files.columns).unionByName(below.select(*files.columns))
    grand = in_envelope(files.where(F.col("level") == level + 2), both)
    pick = lambda df, role: df.select(F.lit(role).alias("role"), "level", "number", "file_size")
    return pick(own, "input").unionByName(pick(below, "next")).unionByName(pick(grand, "grandparent"))


def grandparent_bytes(files: DataFrame, level: int) -> DataFrame:
    """number, bytes of the files two levels below whose ranges each file of ``level`` meets."""
    a, g = files.where(F.col("level") == level), files.where(F.col("level") == level + 2)
    met = overlaps(a, g).join(g.select(F.col("number").alias("other"), "file_size"), "other")
    return a.select("number").join(met.groupBy("number").agg(F.sum("file_size").alias("b")), "number", "left").select("number", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def lru_contents(accesses: DataFrame, capacity: int) -> DataFrame:
    """The files that a cache of ``capacity`` holds after all accesses: those accessed last."""
    if capacity <= 0:
        return accesses.where("false").select("file_number", F.col("access_no").alias("last_access"))
    return accesses.groupBy("file_number").agg(F.max("access_no").alias("last_access")).orderBy(F.desc("last_access"), "file_number").limit(capacity)
