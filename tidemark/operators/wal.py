"""Recovery of a log from its pieces: valid prefix, re-assembly of records, replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import FIRST, FULL, LAST, LOG_BLOCK, LOG_HEADER, MIDDLE

#: Pieces in one partition of the running count below.
STRETCH = 1 << 16


def valid_prefix(pieces: DataFrame) -> DataFrame:
    """Pieces before the first bad one; type 0 is padding and is skipped."""
    bad = ~F.col("crc_ok") | ~F.col("rtype").between(0, LAST)
    first = pieces.agg(F.min(F.when(bad, F.col("pos"))).alias("__bad"))
    return pieces.join(F.broadcast(first), F.coalesce(F.col("pos") < F.col("__bad"), F.lit(True))).where("rtype <> 0").drop("__bad")


def _groups(pieces: DataFrame) -> DataFrame:
    """Add ``grp``: the position of the record start at or before each piece.

    The running maximum is taken in stretches of positions; a second, small
    window carries it from one stretch to the next, so no task sees all pieces.
    """
    start = F.when(F.col("rtype").isin(FULL, FIRST), F.col("pos"))
    p = pieces.withColumn("__s", F.floor(F.col("pos") / STRETCH)).withColumn("__x", start)
    tops = p.groupBy("__s").agg(F.max("__x").alias("__top"))
    carry = tops.withColumn("__c", F.max("__top").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))).select("__s", "__c")
    own = F.max("__x").over(W.partitionBy("__s").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return p.join(carry, "__s").withColumn("grp", F.coalesce(own, F.col("__c"))).drop("__s", "__x", "__c")


def assemble(pieces: DataFrame) -> DataFrame:
    """pos, data of every complete record.

    A full piece is a record; a first piece runs to the first last piece after
    it, and is lost if another record starts before. Pieces without a start are
    dropped.
    """
    w = W.partitionBy("grp").orderBy("pos")
    g = _groups(pieces).where("grp is not null")
    g = g.withColumn("__lead", F.first("rtype").over(w)).withColumn("__done", F.count(F.when(F.col("rtype") == LAST, 1)).over(w.rowsBetween(W.unboundedPreceding, -1)))
    g = g.where((F.col("rtype") == FULL) | ((F.col("__lead") == FIRST) & (F.col("__done") == 0) & F.col("rtype").isin(FIRST, MIDDLE, LAST)))
    whole = g.groupBy("grp").agg(F.max(F.col("rtype").isin(FULL, LAST)).alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("x"))
    return whole.where("ok").select(F.col("grp").alias("pos"), F.array_join(F.transform("x", lambda e: e.data), "").alias("data"))


def replay(base: DataFrame, tail: DataFrame) -> DataFrame:
    """All versions of the stored runs and of the log's tail, each once."""
    return base.unionByName(tail).dropDuplicates(["user_key", "seq"])


def split_record(records: DataFrame) -> DataFrame:
    """record, piece, rtype, length: how records that each start a block are cut into pieces of a block at most."""
    most = LOG_BLOCK - LOG_HEADER
    n = F.greatest(F.ceil(F.col("length") / most), F.lit(1)).cast("int")
    out = records.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n"))))
    kind = F.when(F.col("n") == 1, FULL).when(F.col("piece") == 1, FIRST).when(F.col("piece") == F.col("n"), LAST).otherwise(MIDDLE)
    size = F.when(F.col("piece") < F.col("n"), F.lit(most)).otherwise(F.col("length") - (F.col("n") - 1) * most)
    return out.select("record", F.col("piece").cast("long").alias("piece"), kind.cast("tinyint").alias("rtype"), size.cast("long").alias("length"))


def split_log(records: DataFrame, group: str = "log") -> DataFrame:
    """``group``, record, piece, rtype, length, offset, trailer: how the records of a log, one after the other, are cut into pieces.

    A piece takes what is left of its block; where less than a header is left,
    the block ends with so many zero bytes (``trailer``, on the piece after).
    Each place depends on the one before, so a log is read in order, in one
    task; logs are files of bounded size.
    """
    kind = records.schema[group].dataType.simpleString()

    def f(pdf):
        out, at = [], 0
        for who, record, left in pdf.sort_values("record")[[group, "record", "length"]].itertuples(index=False):
            piece, first = 0, True
            while first or left > 0:
                room = LOG_BLOCK - at % LOG_BLOCK
                pad = room if room < LOG_HEADER else 0
                at += pad
                take = min(left, LOG_BLOCK - at % LOG_BLOCK - LOG_HEADER)
                left -= take
                piece += 1
                out.append((who, record, piece, FULL if first and not left else FIRST if first else MIDDLE if left else LAST, take, at, pad))
                at += LOG_HEADER + take
                first = False
        return pd.DataFrame(out, columns=[group, "record", "piece", "rtype", "length", "offset", "trailer"])

    return records.groupBy(group).applyInPandas(f, f"`{group}` {kind}, record long, piece long, rtype tinyint, length long, offset long, trailer long")
