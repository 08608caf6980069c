"""Links between texts whose sets of word shingles have a likeness of 0.8 or more.

Candidates come from MinHash: of BANDS groups of ROWS minima each, two texts
share at least one whole group with chance 1 - (1 - s**ROWS)**BANDS at likeness
s, 0.9999 at 0.8 and more above. SimHash links within 3 bits are candidates as
well. Every candidate is then decided by its exact sets of shingles.

First, each text is held against the smallest text of each of its groups, which
joins near copies of one text by as many links as there are texts. The texts of
groups that these leave in several components are then joined by prefixes: in
an order of all shingles from rare to common, two sets with a likeness of at
least s share one of the first m - ceil(s * m) + 1 of each set of m shingles. So
texts of different components meet by these only, and only where the numbers of
shingles and the places of the shared one allow the likeness: first each text
and the text of a shingle that has the largest part of its own shingles from
there on, which stands nearest to what many have in common and joins most of
them; then all that are still apart. No pair that is alike is skipped, and a passage that many texts have makes no candidates unless
it fills them. A common shingle's rows are met by a sort-merge join, which the
session's adaptive execution splits where one partition is far larger than the rest.

Texts without words have equal, empty sets and are alike. Texts of fewer than
``width`` words have one shingle. Case of ASCII letters is ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fingerprints, simhash
from . import textnum as T
from .common import durable, forget
from .components import components

LEAST = 0.8
WIDTH = 5
BANDS, ROWS = 24, 5
SLICE_BYTES = 512 << 10
#: Ratio of the sizes at the ends of a cell.
STEP = 1.03
_SALT = T.mix64(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64) * np.uint64(T.BASE))


def band_keys(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key for each text and band, and the number of different shingles of each text."""
    raw, off = T.column_bytes(texts)
    raw = T.LOWER[raw]
    s, e, row = T.words(raw, off)
    n = len(off) - 1
    h, who = T.shingles(T.span_hash(T.prefix_hash(raw), s, e), row, n, width)
    o = np.lexsort((h, who))
    h, who = h[o], who[o]
    new = np.ones(len(h), bool)
    new[1:] = (who[1:] != who[:-1]) | (h[1:] != h[:-1])
    h, who = h[new], who[new]
    some, first = np.unique(who, return_index=True)
    keys = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for salt in _SALT[b * ROWS : (b + 1) * ROWS]:
            low = np.full(n, T.MASK, np.uint64)
            if len(some):
                low[some] = np.minimum.reduceat((h ^ salt) * (salt | np.uint64(1)), first)
            key = T.mix64(key + low)
        keys[:, b] = key
    return keys, np.bincount(who, minlength=n)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each text hash in a task. It runs inside the function that reads the rows, as a node of its own would need a second worker."""
    seen: set[int] = set()
    for b in batches:
        take = []
        for i, h in enumerate(b.column(1).to_pylist()):
            if h not in seen:
                seen.add(h), take.append(i)
        yield b.take(pa.array(take, pa.int64()))


def _bands(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _once(batches):
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                keys, size = band_keys(b.column(0).slice(i, j - i), width)
                th = np.repeat(b.column(1).slice(i, j - i).to_numpy(), BANDS)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "th": th, "size": np.repeat(size, BANDS).astype(np.int64)})
        T.trim()

    return f


def _prints(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from simhash.batch_fingerprints(width)(_once(batches))
        T.trim()

    return f


def _alike(width: int, least: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                x, y = (fingerprints.sketch(b.column(k).slice(i, j - i), 1.0, width) for k in (0, 1))
                ok = pa.array(fingerprints.likeness(x, y, j - i) >= least)
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i).filter(ok) for k in (2, 3)], names=["a", "b"])
        T.trim()

    return f


def _shingles(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                who, h = fingerprints.sketch(b.column(0).slice(i, j - i), 1.0, width)
                th = b.column(1).slice(i, j - i).to_numpy()
                for a in range(0, len(h), 1 << 18):
                    yield pa.RecordBatch.from_pydict({"h": h[a : a + (1 << 18)].view(np.int64), "th": th[who[a : a + (1 << 18)]]})
        T.trim()

    return f


def _texts(texts: DataFrame, need: DataFrame) -> DataFrame:
    """t, th of the texts whose hash is in ``need``, each once."""
    return texts.join(need, "th", "left_semi").select("t", "th").mapInArrow(_once, "t string, th long").dropDuplicates(["th"])


def prefixes(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """h, th, size, r: the rare shingles of every text by which an alike text must meet it; r is the number of shingles from h on. nodes: th, size; texts: t, th."""
    every = durable(_texts(texts, nodes.select("th")).mapInArrow(_shingles(width), "h long, th long"), "shingles")
    common = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # counted from the commonest shingle down, the rank is the number of shingles from this one on
    rank = F.row_number().over(Window.partitionBy("th").orderBy(F.desc("df"), F.desc("h")))
    pre = every.join(common.hint("merge"), "h").select("h", "th", rank.alias("r")).join(nodes.select("th", "size"), "th")
    pre = durable(pre.where(F.col("r") >= F.ceil(F.col("size") * least - 1e-9)).select("h", "th", "size", "r"), "prefix")
    forget(nodes.sparkSession, every)
    return pre


def _undecided(pre: DataFrame, nodes: DataFrame) -> DataFrame:
    """The prefixes with the roots of their texts, where a shingle stands in texts of several components. nodes: th, root."""
    var = pre.join(nodes.select("th", "root"), "th")
    split = var.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    return durable(var.join(split, "h"), "undecided")


def _fits(least: float):
    """Whether numbers of shingles m, n and places i, j of a shared one allow the likeness."""
    sizes = F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9
    return sizes & (F.least("i", "j") >= (F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-9)


def centre_pairs(pre: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of each text with the text of each of its shingles that has the largest part of its own shingles from there on."""
    var = _undecided(pre, nodes)
    best = F.max_by(F.struct("th", "size", "r", "root"), F.struct(F.col("r") / F.col("size"), F.col("th"))).alias("c")
    met = var.join(var.groupBy("h").agg(best), "h").where("root <> c.root")
    met = met.select(F.col("c.th").alias("a"), F.col("c.size").alias("m"), F.col("c.r").alias("i"), F.col("th").alias("b"), F.col("size").alias("n"), F.col("r").alias("j"))
    out = durable(_ordered(met.where(_fits(least)).select("a", "b")), "pairs")
    forget(pre.sparkSession, var)
    return out


def _cells(var: DataFrame, least: float) -> DataFrame:
    """The rows with ``own``, the cell of the text's size, and ``to``, once for each cell in which an alike text may be that meets it here.

    By :func:`_fits` a text of m shingles that shares its r-th meets only texts
    of least * m to r * (1 + least) / least - m shingles. Cells are steps of the
    logarithm of the size, so up to 1 / log(STEP) of them hold one size alone.
    """
    lo = F.ceil(F.col("size") * least - 1e-9)
    hi = F.floor(F.col("r") * ((1 + least) / least) - F.col("size") + 1e-6)

    def cell(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")

    near = var.where(lo <= hi).withColumn("own", cell(F.col("size")))
    return near.withColumn("to", F.explode(F.sequence(cell(lo), cell(hi))))


def met_by_prefix(pre: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (a, b) of texts of different components that may have the likeness. pre: of :func:`prefixes`; nodes: th, root.

    Rows meet by shingle and by both texts' cells, so texts whose sizes and
    places of the shingle rule the likeness out don't meet at all.
    """
    var = _undecided(pre, nodes)
    rows = durable(_cells(var, least), "cells")
    by = ["h", "x", "y", "other"]
    right = rows.select("h", F.col("to").alias("x"), F.col("own").alias("y"), F.col("root").alias("other"), F.col("th").alias("b"), F.col("size").alias("n"), F.col("r").alias("j"))
    left = rows.select("h", F.col("own").alias("x"), F.col("to").alias("y"), "root", F.col("th").alias("a"), F.col("size").alias("m"), F.col("r").alias("i"))
    left = left.join(right.select(by).distinct(), by[:3]).where("root < other").drop("root")
    out = durable(_ordered(left.join(right, by).where(_fits(least)).select("a", "b")), "met")
    forget(pre.sparkSession, var, rows)
    return out


def alike(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """Of the pairs (a long, b long: text hashes), those whose shingle sets have at least the likeness. texts: t, th."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    some = durable(_texts(texts, need), "some")
    x = some.select(F.col("t").alias("ta"), F.col("th").alias("a"))
    y = some.select(F.col("t").alias("tb"), F.col("th").alias("b"))
    met = pairs.join(x, "a").join(y, "b").select("ta", "tb", "a", "b")
    return met.mapInArrow(_alike(width, least), "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def roots(documents: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """th (xxhash64 of the text, null as empty), root for every text that has a link; root is the smallest th reachable."""
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    var = durable(rows.mapInArrow(_bands(width), "key long, th long, size long").distinct(), "bands")
    met = var.groupBy("key").agg(F.count("*").alias("n"), F.min("th").alias("c")).where("n > 1")
    var = durable(var.join(met, "key"), "shared")
    fps = durable(rows.mapInArrow(_prints(width), "th long, fp long").distinct(), "fps")
    least_of = durable(fps.groupBy("fp").agg(F.min("th").alias("c")), "nodes")
    near = simhash.links(least_of.select("fp"))
    x, y = least_of.select(F.col("fp").alias("a"), F.col("c").alias("x")), least_of.select(F.col("fp").alias("b"), F.col("c").alias("y"))
    pairs = var.select(F.col("c").alias("a"), F.col("th").alias("b"))
    pairs = pairs.unionByName(fps.join(least_of, "fp").select(F.col("c").alias("a"), F.col("th").alias("b")))
    pairs = pairs.unionByName(near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = durable(_ordered(pairs), "pairs")
    links = durable(alike(pairs, rows, width, least), "alike")
    # the texts of groups in more than one component meet by their rare shingles
    node = components(links).withColumnRenamed("node", "th")
    var = var.where("n > 2").select("key", "th", "size").join(node, "th", "left").select("key", "th", "size", F.coalesce("root", "th").alias("root"))
    split = var.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    nodes = durable(var.join(split, "key").select("th", "size", "root").distinct(), "split")
    pre = prefixes(nodes, rows, width, least)
    for meet in (centre_pairs, met_by_prefix):
        more = durable(meet(pre, nodes, least).join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = durable(links.unionByName(alike(more, rows, width, least)), "alike")
        node, pairs = components(links).withColumnRenamed("node", "th"), pairs.unionByName(more)
        nodes = nodes.select("th").join(node, "th", "left").select("th", F.coalesce("root", "th").alias("root"))
    return node
