"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 3 bits agree to 1 bit in one of their 32-bit
halves. Every half of even parity emits itself and its 32 neighbours, every
half of odd parity itself; halves that differ in one bit have different parity
and meet. A variant reached by two fingerprints is a pair, verified at once;
one reached by a few is paired within that bound. Fingerprints of fuller
variants emit the whole ball about themselves: all variants within 2 bits for
even parity, within 1 bit for odd (half the radius, up and down: fingerprints 1
or 3 bits apart differ in parity). What meets in a variant with a member at
most 1 bit away is linked for certain and becomes a star about that member, so
no pairs are listed; by geometry 2081 fingerprints at most share a variant.
Equal fingerprints are one node throughout, however many rows they stand for.

Null and empty texts have fingerprint zero and link like any other; fewer than
``width`` words make one shingle. A null id stands below all ids. Repeated rows
are copies. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import durable
from .components import components

SEED = 42
#: Variants with at most so many fingerprints are paired, fuller ones go by whole balls.
FEW = 16
CHUNK = 50_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """One text's fingerprint, plainly."""
    h = _hashes((text or "").encode().lower().split(), width)
    if not h:
        return 0
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _hashes(w: list[bytes], width: int) -> list[int]:
    x = xxhash.xxh64_intdigest
    if len(w) < width:
        return [x(b" ".join(w), SEED)] if w else []
    return [x(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(width))))]


def batch_fingerprints(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = b.column(0), len(b)
            out = np.zeros(n, np.uint64)
            rows: list[int] = []
            sizes: list[int] = []
            hs: list[np.ndarray] = []

            def flush() -> None:
                if rows:
                    bits = np.unpackbits(np.concatenate(hs).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    set_ = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > np.array(sizes)[:, None]
                    out[rows] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
                    rows.clear(), sizes.clear(), hs.clear()

            for i in range(n):
                t = texts[i].as_py()
                h = _hashes(t.encode().lower().split(), width) if t else []
                if h:
                    rows.append(i), sizes.append(len(h)), hs.append(np.array(h, np.uint64))
                if sum(sizes) > CHUNK:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out.view(np.int64))], names=[*b.schema.names[1:], "fp"])

    return f


def fingerprints(documents: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """Columns ``keep`` and fp, a 64-bit fingerprint as a signed long."""
    d = documents.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(batch_fingerprints(width), f"{schema}, fp long")


_ODD = np.array([bin(i).count("1") & 1 for i in range(1 << 16)], np.uint8)


def _parity(x: np.ndarray) -> np.ndarray:
    p = np.zeros(len(x), np.uint8)
    for s in (0, 16, 32, 48):
        p ^= _ODD[(x >> np.uint64(s)) & np.uint64(0xFFFF)]
    return p


def _half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(32, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for side, half in ((0, fp & np.uint64(0xFFFFFFFF)), (1, fp >> np.uint64(32))):
            even = _parity(half) == 0
            key = np.concatenate([(half[even][:, None] ^ flips).ravel(), half[~even]]) | np.uint64(side << 32)
            who = np.concatenate([np.repeat(fp[even], 33), fp[~even]])
            for k in range(0, len(key), CHUNK):
                yield pa.RecordBatch.from_pydict({"key": key[k : k + CHUNK].view(np.int64), "fp": who[k : k + CHUNK].view(np.int64)})


_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_I, _J = np.triu_indices(64, 1)
_BALL = np.concatenate([[0], _ONE, _ONE[_I] | _ONE[_J]]).astype(np.uint64)


#: Variants of a ball in one lot; a ball of radius 1 is one lot, one of radius 2 is 33.
LOT = 65


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with the numbers of its ball's lots, so that balls are dealt in equal parts."""
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        n = np.where(_parity(fp) == 0, -(-len(_BALL) // LOT), 1)
        lot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_pydict({"fp": np.repeat(fp, n).view(np.int64), "lot": lot.astype(np.int64)})


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, len(b), 1024):
            fp = b.column(0).to_numpy()[k : k + 1024].view(np.uint64)
            at = b.column(1).to_numpy()[k : k + 1024][:, None] * LOT + np.arange(LOT)
            who, at = np.repeat(fp, LOT)[(ok := at.ravel() < len(_BALL))], at.ravel()[ok]
            yield pa.RecordBatch.from_pydict({"v": (who ^ _BALL[at]).view(np.int64), "near": at < 65, "fp": who.view(np.int64)})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = b.column(0).values.to_numpy().view(np.uint64)
        off = b.column(0).offsets.to_numpy()
        a, c = [], []
        for i, j in zip(off[:-1], off[1:]):
            x, y = np.triu_indices(j - i, 1)
            a.append(flat[i:j][x]), c.append(flat[i:j][y])
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(c).view(np.int64)})


def links(fps: DataFrame, few: int = FEW) -> DataFrame:
    """a, b: links that join all distinct fingerprints (fp long, no repeats) within 3 bits, pairs or stars."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    var = fps.mapInArrow(_half_variants, "key long, fp long")
    met = durable(var.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "met")
    two = met.where("n = 2").select("a", "b").where(close)
    fuller = var.join(met.where("n > 2").select("key", "n"), "key")
    fuller = durable(fuller, "fuller")
    some = fuller.where(F.col("n") <= few).groupBy("key").agg(F.collect_list("fp").alias("x")).select("x").mapInArrow(_pairs, "a long, b long").where(close)
    crowd = fuller.where(F.col("n") > few).select("fp").distinct()
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ball = crowd.mapInArrow(_lots, "fp long, lot long").repartition(parts).mapInArrow(_balls, "v long, near boolean, fp long")
    from pyspark.sql import Window as W

    star = ball.withColumn("c", F.min(F.when(F.col("near"), F.col("fp"))).over(W.partitionBy("v"))).where("c is not null and c <> fp").select(F.col("c").alias("a"), F.col("fp").alias("b"))
    return two.unionByName(some).unionByName(star).distinct()


def near_duplicates(documents: DataFrame, keep: list[str], id_col: str, text: str = "text", width: int = 3) -> DataFrame:
    """Columns ``keep``, fp, root (the component's smallest fingerprint) and component_id (the smallest id reachable) for every row.

    Components whose smallest ids are equal or null differ in root alone.
    """
    docs = durable(fingerprints(documents, keep, text, width), "fps")
    nodes = durable(docs.groupBy("fp").agg(F.min_by(F.struct(id_col), F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias("m")).select("fp", F.col(f"m.{id_col}").alias("low")), "nodes")
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = durable(placed, "placed")
    comp = placed.groupBy("root").agg(F.min_by(F.struct("low"), F.struct(F.col("low").isNotNull(), "low")).alias("m"))
    named = placed.select("fp", "root").join(comp, "root").select(F.col("fp").alias("__fp"), "root", F.col("m.low").alias("component_id"))
    return docs.join(named, docs.fp == named["__fp"]).drop("__fp")
