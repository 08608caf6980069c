"""Mixing sources to target weights by cube-method balanced sampling.

A document with expected number of copies q gets floor(q) copies for certain
and one more with probability q - floor(q). The cube method settles these
fractions: a group's vector of probabilities moves along a direction that
leaves its token total and its document total unchanged, until one more entry
reaches 0 or 1. As each move needs a null vector of only two constraints, three
open documents are enough for the next move, and a group ends with two open
documents at most. Groups are cut from one source by a hash of the id; their
open documents meet in groups of the next round, each round over a thousand
times smaller than the one before, until one group of each source is left. Its
last two documents are landed at random, keeping the expectation.

Null and empty texts have size 0: they are balanced by the document total
alone. A very long text is a document like others. A null source is a
source of its own, last in order. Repeated ids are rows of their own. Rows with
the same id, source and text are counted, then numbered from 0, so that each has
a decision of its own, however many there are. Ties can't arise: all choices come
from hashes of these values, so reruns agree. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions, word_pattern

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
GROUP = 2048


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(word_pattern())), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Tokens due to each source: by weight, ``limit`` times its size at most, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # str order is by code point
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = share * sum(size.values())
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in size if s not in fixed]
        left = total - sum(fixed.values())
        unit = left / sum(w[s] for s in free) if free else 0.0
        over = [s for s in free if unit * w[s] > limit * size[s]]
        if not over:
            return {s: fixed[s] if s in fixed else unit * w[s] for s in size}
        fixed |= {s: limit * size[s] for s in over}


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` inside the cube, with x.T @ p unchanged, until at most as many entries as constraints are open."""
    p = p.copy()
    k = x.shape[1]
    scale = np.abs(x).max(axis=0)
    x = x / np.where(scale > 0, scale, 1)
    wait = iter(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)))
    open_: list[int] = []
    while True:
        while len(open_) <= k and (i := next(wait, None)) is not None:
            open_.append(int(i))
        if len(open_) <= k:
            return p
        u = _null(x[open_])
        q = p[open_]
        with np.errstate(divide="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / np.where(u > 0, u, 1), np.where(u < 0, q / np.where(u < 0, -u, 1), np.inf)))
            down = np.min(np.where(u > 0, q / np.where(u > 0, u, 1), np.where(u < 0, (1 - q) / np.where(u < 0, -u, 1), np.inf)))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
        p[open_] = q
        open_ = [i for i, v in zip(open_, q) if 0 < v < 1]


def _null(a: np.ndarray) -> np.ndarray:
    """A vector u with u @ a = 0; for two constraints the cross product, where it isn't zero."""
    if a.shape == (3, 2):
        u = np.cross(a[:, 0], a[:, 1])
        if np.abs(u).max() > 1e-9:
            return u / np.abs(u).max()
    return np.linalg.svd(a.T)[2][-1]


def _fly(last: bool):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "h2", "k"], kind="stable")
        rng = np.random.default_rng(int(pdf["h"].iloc[0]) & (2**63 - 1))
        p = flight(pdf["p"].to_numpy(float), np.column_stack([pdf["size"].to_numpy(float), np.ones(len(pdf))]), rng)
        if last:
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
        return pdf.assign(p=p)

    return f


def mix(documents: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, group: int = GROUP) -> DataFrame:
    """doc_id, src, size, source_size, target, copies, h2 (hash of the text) for every row.

    The driver gets one row for each source (names and totals); a table of
    millions of sources would need the targets joined instead.
    """
    spark = documents.sparkSession
    base = documents.select(F.col(id_col).alias("doc"), F.col(source).cast("string").alias("src"), size_of(text).alias("size"), F.xxhash64(F.lit(17), F.col(id_col)).alias("h"), F.xxhash64(F.lit(23), F.coalesce(F.col(text), F.lit(""))).alias("h2"))
    base = durable(base.groupBy("doc", "src", "size", "h", "h2").agg(F.count("*").alias("rows")), "sizes")
    stats = base.groupBy("src").agg(F.sum(F.col("size") * F.col("rows")).alias("s"), F.sum("rows").alias("n")).collect()
    due = targets([(r.src, int(r.s)) for r in stats], weights, share, limit)
    ratio = spark.createDataFrame([(r.src, int(r.s), float(due[r.src]), float(due[r.src] / r.s) if r.s else 0.0, int(r.n)) for r in stats], "src string, source_size long, target double, q double, n long")
    # equal rows by number, a stretch of a group's size at a time, so that no task makes all rows of a large group
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(group).cast("long")))
    rows = base.withColumn("k0", first).repartition(shuffle_partitions(spark), "h", "h2", "k0")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", F.least(F.col("k0") + (group - 1), F.col("rows") - 1)))).drop("k0", "rows")
    rows = rows.join(F.broadcast(ratio) if len(stats) <= 100_000 else ratio, rows.src.eqNullSafe(ratio.src)).drop(ratio.src)
    rows = rows.withColumn("p", F.col("q") - F.floor("q"))
    open_ = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    most = max([r.n for r in stats], default=0)
    cols = ["doc", "src", "size", "h", "h2", "k", "n", "p"]
    state = rows.where(open_).select(*cols)
    schema, settled, level = state.schema, None, 0
    while True:
        groups = -(-most // group)
        last = groups <= 1
        # a source's groups shrink with its own number of documents, two of each group stay open
        n_here = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(group))).cast("long")
        cell = F.pmod(F.xxhash64(F.lit(31 + level), F.col("h"), F.col("h2"), F.col("k")), n_here)
        moved = durable(state.groupBy("src", cell.alias("cell")).applyInPandas(_fly(last), schema), "flight")
        done = moved if last else moved.where((F.col("p") <= 0) | (F.col("p") >= 1))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        state = moved.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("n", 2 * n_here)
        most, level = 2 * groups, level + 1
    extra = settled.where("p >= 0.5").select(F.col("doc").alias("__d"), F.col("src").alias("__s"), F.col("h2").alias("__h"), F.col("k").alias("__k"))
    same = rows.doc.eqNullSafe(F.col("__d")) & rows.src.eqNullSafe(F.col("__s")) & (rows.h2 == F.col("__h")) & (rows.k == F.col("__k"))
    out = rows.join(extra.hint("merge"), same, "left")
    copies = F.floor(F.col("q") + 1e-9).cast("long") + F.when(F.col("__k").isNotNull() & open_, 1).otherwise(0)
    return out.select(F.col("doc").alias("doc_id"), "src", "size", "source_size", "target", copies.cast("long").alias("copies"), "h2")


def taken(documents: DataFrame, **options) -> DataFrame:
    m = mix(documents, **options)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
