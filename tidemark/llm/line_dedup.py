"""Line dedup: repeated runs of lines by a suffix array over line identifiers.

Every document is a sequence of identifiers of its non-blank lines. Suffixes
are ranked by prefix doubling: ranks by one line, then by pairs of ranks 1, 2,
4, ... lines apart. Suffixes of equal rank at depth k make up an interval of
the suffix array with a common prefix of at least k lines. An interval of one
suffix can't hold a repeat, nor can any interval below it, so only intervals of
two or more are ranked further; their order is that of the full array.

A run counts as repeated if it has at least ``min_words`` words and begins
earlier as well, in the order of ids, then of text hashes, then of places. Each
maximal repeated run is the union of the shortest stretches of ``min_words``
words that begin or end at one of its lines, so ranks are needed up to such
lengths only. Lines of all copies but the first are deleted.

Blank lines are kept and don't break a run. Null and empty texts have no lines.
Rows with the same id and text count as one and share its fate. An empty table
gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum as T
from .common import durable, forget

MIN_WORDS = 8


def stretches(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line, the lengths of the shortest stretches from it: that begin with it, or that end with a later line."""
    n = len(words)
    run = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(run, run[:-1] + least, "left")  # shortest from i is [i, end)
    start = np.searchsorted(run, run[1:] - least, "right") - 1  # shortest to e is [start, e]
    out: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        if end[i] <= n:
            out[i].add(int(end[i]) - i)
        if start[i] >= 0:
            out[start[i]].add(i + 1 - int(start[i]))
    return [sorted(x) for x in out]


def _lines(least: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in T.slices(b.column(0), 512 << 10):
                part = b.slice(i, j - i)
                rows, pos, lines, lens = [], [], [], []
                counts: list[int] = []
                for r, t in enumerate(part.column(0).to_pylist()):
                    own = [(k, s) for k, s in enumerate((t or "").split("\n")) if s.strip(" \t\r\v\f")]
                    if own:
                        w = np.array([len(s.encode().split()) for _, s in own])
                        rows += [r] * len(own)
                        pos += range(len(own))
                        lines += [s.strip(" \t\r\v\f") for _, s in own]
                        lens += stretches(w, least)
                if not lines:
                    continue
                raw, off = T.column_bytes(pa.array(lines, pa.large_string()))
                run = T.prefix_hash(raw)
                h = [T.span_hash(run, off[:-1], off[1:], s).view(np.int64) for s in (1, 2)]
                # the second hash uses other byte sums, so that both fail together only by chance
                rev = T.prefix_hash(raw[::-1])
                h[1] = T.span_hash(rev, len(raw) - off[1:], len(raw) - off[:-1], 2).view(np.int64)
                cols = [c.take(pa.array(rows)) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int32()), pa.array(h[0]), pa.array(h[1]), pa.array(lens, pa.list_(pa.int32()))], names=[*part.schema.names[1:], "pos", "h1", "h2", "lens"])
        T.trim()

    return f


def ranked(distinct: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of each row in the order of ``cols``. Rows are distinct, so no range can be overfull.

    The driver gets one count for each range.
    """
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = distinct.repartitionByRange(n, *cols).withColumn("__p", F.spark_partition_id())
    part = durable(part.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*cols))), "ranks")
    sizes = {r["__p"]: r["count"] for r in part.groupBy("__p").count().collect()}
    at, ahead = [], 0
    for p in sorted(sizes):
        at.append((p, ahead))
        ahead += sizes[p]
    offs = spark.createDataFrame(at or [(0, 0)], "__p int, __o long")
    return part.join(F.broadcast(offs), "__p").withColumn(name, F.col("__n") + F.col("__o")).drop("__p", "__n", "__o")


def _named(state: DataFrame, cols: list[str]) -> DataFrame:
    """Rank suffixes by ``cols``; those alone in their interval go.

    Both sides of the join are read from files and merged at every size: a
    line that stands very often is a skewed partition, which Spark splits.
    """
    many = state.groupBy(*cols).agg(F.count("*").alias("__c")).where("__c > 1").drop("__c")
    return state.join(ranked(many, cols, "rank").hint("merge"), cols)


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, th (hash of the text), gone: sorted places of deleted lines among the non-blank ones, for documents that have any."""
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")).where("t <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    spark = documents.sparkSession
    lines = durable(rows.mapInArrow(_lines(min_words), f"id {kind}, th long, pos int, h1 long, h2 long, lens array<int>"), "lines")
    me, key = ["id", "th", "pos"], ["len", "rank", "tail"]
    state = durable(_named(lines, ["h1", "h2"]).select(*me, "lens", "rank"), "level")
    forget(spark, lines)
    wins: DataFrame | None = None
    levels = []
    k = 1
    place = W.partitionBy("id", "th").orderBy("pos")
    while True:
        # stretches of k to 2k-1 lines: the ranks of their first and of their last k lines tell them apart
        w = state.select(*me, "rank", F.explode(F.filter("lens", lambda x: x < 2 * k)).alias("len"))
        if k == 1:
            w = w.withColumn("tail", F.col("rank"))
        else:
            tail = state.select("id", "th", F.col("pos").alias("__q"), F.col("rank").alias("tail")).distinct()
            w = w.withColumn("__q", F.col("pos") + F.col("len") - k)
            w = w.join(tail.hint("merge"), w.id.eqNullSafe(tail.id) & (w.th == tail.th) & (w["__q"] == tail["__q"])).drop(tail.id, tail.th, tail["__q"]).drop("__q")
        levels.append(durable(w.select(*me, *key), "stretches"))
        wins = levels[-1] if wins is None else wins.unionByName(levels[-1])
        longer = F.filter("lens", lambda x: x >= 2 * k)
        if not state.where(F.size(longer) > 0).limit(1).count():
            break
        after = F.max("rank").over(place.rangeBetween(k, k))
        grown = state.select(*me, longer.alias("lens"), "rank", after.alias("rank2")).where("rank2 is not null").withColumnRenamed("rank", "rank1")
        last, state = state, durable(_named(grown, ["rank1", "rank2"]).select(*me, "lens", "rank"), "level")
        forget(spark, last)
        k *= 2
    order = F.struct(F.col("id").isNotNull().alias("x"), F.col("id"), F.col("th"), F.col("pos"))
    first = durable(wins.groupBy(*key).agg(F.min(order).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c"), "firsts")
    late = wins.join(first.hint("merge"), key).where(F.col("f") < order)
    gone = late.select("id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("g"))
    gone = durable(gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("g")).alias("gone")), "gone")
    forget(spark, state, first, *levels)
    return gone


def _without(text: str, gone) -> tuple[str, int]:
    drop = set(gone) if gone is not None else set()
    out, k = [], -1
    for s in text.split("\n"):
        if s.strip(" \t\r\v\f"):
            k += 1
            if k in drop:
                continue
        out.append(s)
    return "\n".join(out), k + 1


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with later copies of repeated runs cut out of ``text``, and __lines, __gone: non-blank lines, deleted ones."""
    gone = repeated_lines(documents, id_col, text, min_words)
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__g"))
    d = documents.withColumn("__h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # a merge join at every size: what goes grows with the corpus
    d = d.join(gone.hint("merge"), F.col(id_col).eqNullSafe(gone["__id"]) & (F.col("__h") == gone["__th"]), "left")

    @F.pandas_udf("struct<t:string, n:int>")
    def cut(t: pd.Series, g: pd.Series) -> pd.DataFrame:
        got = [_without(a, b) if isinstance(a, str) else (a, 0) for a, b in zip(t, g)]
        return pd.DataFrame({"t": [x[0] for x in got], "n": [x[1] for x in got]})

    d = d.withColumn("__c", cut(F.col(text), F.col("__g")))
    keep = [F.col("__c.t").alias(c) if c == text else F.col(c) for c in documents.columns]
    n: Column = F.coalesce(F.size("__g"), F.lit(0))
    return d.select(*keep, F.col("__c.n").cast("long").alias("__lines"), F.when(F.col("__g").isNull(), 0).otherwise(n).cast("long").alias("__gone"))
