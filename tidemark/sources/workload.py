"""Views of the test tables as change logs, files, edits and log pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """A new path for a store: in the folder the cluster shares, or a temporary one in a local session."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = tempfile.mkdtemp(prefix="tidemark-")
    return f"{top.rstrip('/')}/store-{uuid.uuid4().hex}"


def operations(log: DataFrame) -> DataFrame:
    """A change log as operations in the order of seq."""
    return log.select(F.col("seq").alias("op_no"), F.col("vtype").cast("int").alias("vtype"), F.encode("user_key", "UTF-8").alias("user_key"), F.encode("value", "UTF-8").alias("value"))


def events_log(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    """user_key, seq, vtype, value: every event is a version of its user, errors are deletions.

    ``upto`` bounds seq; it is written on the stored column so that the scan gets it.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if upto is not None:
        e = e.where(F.col("event_id") <= upto - 1)
    gone = F.col("event_type") == "error"
    return e.select(
        F.format_string("u%04d", "user_id").alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 1).otherwise(0).cast("tinyint").alias("vtype"),
        F.when(gone, "").otherwise(F.col("props")).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a version of its customer; finished orders are deletions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.col("o_orderstatus") == "F"
    return o.select(
        F.format_string("c%06d", "o_custkey").alias("user_key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.when(gone, 1).otherwise(0).cast("tinyint").alias("vtype"),
        F.when(gone, "").otherwise(F.col("o_orderpriority")).alias("value"),
    )


def last_seq(spark: SparkSession, sf_dir: str) -> int:
    """The largest sequence number, from the scan's statistics."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) + 1


def files(log: DataFrame) -> DataFrame:
    """level, number, file_size, smallest, largest: the log as if stored in files, by level and range of keys.

    The level is seq modulo 4; a file takes 25 users, level 0 files take 60.
    """
    uid = F.substring("user_key", 2, 10).cast("long")
    level = F.pmod(F.col("seq"), F.lit(4)).cast("int")
    part = F.floor(uid / F.when(level == 0, 60).otherwise(25)).cast("long")
    return (
        log.select(level.alias("level"), part.alias("part"), "user_key", (F.length("user_key") + F.length("value")).alias("b"))
        .groupBy("level", "part")
        .agg((F.sum("b") * 1000).alias("file_size"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"))
        .select("level", (F.col("level") * 100_000 + F.col("part")).alias("number"), "file_size", "smallest", "largest")
    )


def edits(log: DataFrame, run: int = 1000) -> DataFrame:
    """edit_no, adds and deletes of files, scalars: one edit for each run of ``run`` versions.

    Edit n adds file n at level 0; every fourth edit deletes the four files
    before and adds file 10000 + n at level 1.
    """
    n = F.floor((F.col("seq") - 1) / run).cast("long")
    every = (F.col("edit_no") % 4 == 3) & (F.col("edit_no") > 0)
    return (
        log.groupBy(n.alias("edit_no"))
        .agg(F.max("seq").alias("last_sequence"), F.max("user_key").alias("top"))
        .select(
            "edit_no",
            F.when(F.col("edit_no") % 3 == 0, F.col("edit_no") + 2).alias("log_number"),
            (F.col("edit_no") + 3).alias("next_file_number"),
            "last_sequence",
            F.when(every, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.lit(0).alias("level"), (F.col("edit_no") - i + 0).alias("number")))).otherwise(F.array().cast("array<struct<level:int,number:bigint>>")).alias("deleted_files"),
            F.when(every, F.array(F.struct(F.lit(0).alias("level"), F.col("edit_no").alias("number")), F.struct(F.lit(1).alias("level"), (F.col("edit_no") + 10_000).alias("number"))))
            .otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("edit_no").alias("number"))))
            .alias("new_files"),
            F.when(every, F.array(F.struct((F.col("edit_no") % 3).cast("int").alias("level"), F.col("top").alias("user_key")))).otherwise(F.array().cast("array<struct<level:int,user_key:string>>")).alias("compact_pointers"),
        )
    )


def wal_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, rtype, length, crc_ok, data: events as pieces of log records, the 97th hundredth piece broken."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = last_seq(spark, sf_dir)
    kind = F.when(F.col("event_id") % 7 == 0, 2).when(F.col("event_id") % 7 == 1, 3).when(F.col("event_id") % 7 == 2, 4).when(F.col("event_id") % 11 == 0, 3).when(F.col("event_id") % 13 == 0, 2).otherwise(1)
    return e.select(F.col("event_id").alias("pos"), kind.cast("tinyint").alias("rtype"), F.length("event_type").cast("int").alias("length"), (F.col("event_id") != n * 97 // 100).alias("crc_ok"), F.col("event_type").alias("data"))
