"""Replay of metadata edits as a set operation, and what a directory holds beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NUM_LEVELS, Corrupted

SCALARS = ("log_number", "prev_log_number", "next_file_number", "last_sequence")


def _moves(edits: DataFrame, col: str) -> DataFrame:
    return edits.select("edit_no", F.explode(col).alias("x"))


def live_files(edits: DataFrame) -> DataFrame:
    """level, number (and meta, where edits have it) of files that no later edit deletes.

    Within an edit deletions come first, so a file added by the edit that
    deletes it stays. The last move of each file decides: one aggregate instead
    of a join of additions with deletions.
    """
    adds = _moves(edits, "new_files")
    meta = [F.col("x.meta").alias("meta")] if "meta" in adds.schema["x"].dataType.names else []
    number = F.col("x.meta.number") if meta else F.col("x.number")
    a = adds.select("edit_no", F.col("x.level").alias("level"), number.alias("number"), F.lit(1).alias("on"), *meta)
    d = _moves(edits, "deleted_files").select("edit_no", F.col("x.level").alias("level"), F.col("x.number").alias("number"), F.lit(0).alias("on"))
    both = a.unionByName(d, allowMissingColumns=True)
    order = F.struct("edit_no", "on")
    keep = F.struct("on", *(["meta"] if meta else []))
    last = both.groupBy("level", "number").agg(F.max_by(keep, order).alias("l"))
    return last.where("l.on = 1").select("level", "number", *([F.col("l.meta").alias("meta")] if meta else []))


def check_levels(edits: DataFrame) -> DataFrame:
    """The edits; an action on them fails where an edit names a level that doesn't exist."""
    bad = F.exists("new_files", lambda f: (f.level >= NUM_LEVELS) | (f.level < 0)) | F.exists("deleted_files", lambda f: (f.level >= NUM_LEVELS) | (f.level < 0))
    return edits.withColumn("edit_no", F.when(bad, F.raise_error(F.lit("level out of range"))).otherwise(F.col("edit_no")))


def scalars(edits: DataFrame) -> DataFrame:
    """Each scalar as the last edit that sets it has it, or 0."""
    return edits.agg(*(F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_no"))), F.lit(0)).alias(c) for c in SCALARS if c in edits.columns))


def compact_pointers(edits: DataFrame) -> DataFrame:
    """level, user_key: the last pointer of each level."""
    return _moves(edits, "compact_pointers").groupBy(F.col("x.level").alias("level")).agg(F.max_by(F.col("x.user_key"), F.col("edit_no")).alias("user_key"))


def parse_name(name: str = "name") -> tuple[Column, Column]:
    """Kind (sst, log, manifest, tmp, current or null) and number of a file name."""
    c = F.col(name)
    kind = F.when(c.rlike(r"^[0-9]+\.sst$"), "sst").when(c.rlike(r"^[0-9]+\.log$"), "log").when(c.rlike(r"^MANIFEST-[0-9]+$"), "manifest").when(c == "CURRENT", "current").when(c == "CURRENT.dbtmp", "tmp")
    return kind, F.regexp_extract(c, r"([0-9]+)", 1).try_cast("bigint")


def file_name(kind: str, number: Column) -> Column:
    return F.format_string({"sst": "%06d.sst", "log": "%06d.log", "manifest": "MANIFEST-%06d"}[kind], number)


def obsolete(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Names that may go: files of a known kind that ``live`` (kind, number) doesn't hold, and the temporary pointer. Unknown names stay."""
    kind, number = parse_name()
    named = listing.select("name", kind.alias("kind"), number.alias("number")).where("kind is not null and kind <> 'current'")
    return named.join(live.select("kind", "number"), ["kind", "number"], "left_anti").select("name")


def require_no_unknown(edits: DataFrame) -> None:
    if edits.where(F.col("edit_no").isNull()).limit(1).count():
        raise Corrupted("an edit has no number")
