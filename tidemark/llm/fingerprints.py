"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed share of the hash range. Two
sketches made with the same share can be merged by union, and the likeness or
containment of the texts is that of the sketches, however unequal the texts
are. A text with words but no hash below that share has its smallest hash
instead, marked by a ``+``: two such sketches are alike if these are equal, one
such and a plain one share nothing below the threshold, and a union drops the
mark as soon as it holds a plain hash. So the union is always the sketch of the
texts together.

Null and empty texts have no words, hence the empty sketch; two such texts
have likeness 1, one such text and another have likeness 0. Texts of fewer
than five words have one shingle of all their words; a very long text is read
whole and keeps its share of hashes. Equal texts have equal sketches, whatever
their ids. Documents follow each other by id, then text; null ids come first.
Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import shuffle_partitions

SHARE = 1 / 4
WIDTH = 5
BATCH_BYTES = 1 << 20


def sketch(texts: pa.Array, share: float = SHARE, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all retained hashes, sorted by both, without repeats."""
    raw, off = T.column_bytes(texts)
    raw = T.LOWER[raw]
    s, e, row = T.words(raw, off)
    h, who = T.shingles(T.span_hash(T.prefix_hash(raw), s, e), row, len(off) - 1, width)
    o = np.lexsort((h, who))
    h, who = h[o], who[o]
    new = np.ones(len(h), bool)
    new[1:] = who[1:] != who[:-1]
    keep = (h < np.uint64(threshold(share))) | new
    same = np.zeros(len(h), bool)
    same[1:] = ~new[1:] & (h[1:] == h[:-1])
    keep &= ~same
    return who[keep], h[keep]


def as_text(row: np.ndarray, h: np.ndarray, n: int, share: float = SHARE) -> list[str]:
    """Hex digits, 16 for each hash, in ascending order; a smallest hash beyond the threshold has a plus before it."""
    hexed = h.astype(">u8").tobytes().hex()
    at = np.searchsorted(row, np.arange(n + 1))
    over = h >= np.uint64(threshold(share))
    return [("+" if b > a and over[a] else "") + hexed[16 * a : 16 * b] for a, b in zip(at[:-1], at[1:])]


def threshold(share: float = SHARE) -> int:
    return min(T.MASK, int(share * 2**64))


def _plain(sketch_: str) -> set[str]:
    return set() if sketch_.startswith("+") else {sketch_[i : i + 16] for i in range(0, len(sketch_), 16)}


def merge(a: str, b: str) -> str:
    """The sketch of two texts together, from sketches of one share."""
    both = _plain(a) | _plain(b)
    if both:
        return "".join(sorted(both))
    return min((x for x in (a, b) if x), default="")


def jaccard(a: str, b: str) -> float:
    """Estimated likeness of two texts' sets of shingles."""
    x, y = _plain(a), _plain(b)
    return len(x & y) / len(x | y) if x or y else float(a == b)


def containment(a: str, b: str) -> float | None:
    """Estimated share of the first text's shingles that the second has; None where the first sketch has no hash below the threshold and the second has."""
    x, y = _plain(a), _plain(b)
    if x:
        return len(x & y) / len(x)
    return None if y and a else float(a == b or not a)


def merged(sketches: DataFrame, by: list[str], sketch_col: str = "fingerprint") -> DataFrame:
    """``by`` and the sketch of all texts of each group: hashes are distinct before they meet."""
    h = F.explode(F.when(F.col(sketch_col) == "", F.array(F.lit(""))).otherwise(F.filter(F.split(F.regexp_replace(sketch_col, "([0-9a-f]{16})", "$1 "), " "), lambda x: x != "")))
    one = sketches.select(*by, h.alias("__h")).distinct()
    plain = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("__h").startswith("+"), F.col("__h")))), "")
    spare = F.coalesce(F.min(F.when(F.col("__h").startswith("+"), F.col("__h"))), F.lit(""))
    return one.groupBy(*by).agg(plain.alias("__p"), spare.alias("__s")).select(*by, F.when(F.col("__p") != "", F.col("__p")).otherwise(F.col("__s")).alias(sketch_col))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Jaccard likeness of the sketches with the same row number."""
    row, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=n)
    either = np.bincount(row, minlength=n) - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """Add the sketch of a text column as a string column."""

    @F.pandas_udf("string")
    def f(col: pd.Series) -> pd.Series:
        arr = pa.array(col, pa.string(), from_pandas=True)
        return pd.Series([x for i, j in T.slices(arr, BATCH_BYTES) for x in as_text(*sketch(arr.slice(i, j - i), share, width), j - i, share)])

    return df.withColumn(out, f(F.col(text)))


def with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", rows_per_bucket: int = 2_000, most_buckets: int | None = None) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of the id, each range closed by a copy of the first row of the next.

    Returns (bucket, guard, id, text) and the number of buckets. The first row
    of all closes the last range. Only range bounds and one id for each range,
    four for each shuffle partition of the session or ``most_buckets`` at most,
    are sent to the driver. Rows stream through a range, so its length costs
    time, not memory. Repeated ids stay in one range and are ordered by text.
    """
    spark = df.sparkSession
    df = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = df.count()
    want = max(1, min(most_buckets or 4 * shuffle_partitions(spark), -(-n // rows_per_bucket)))
    cuts = df.select(F.percentile_approx("k", [i / want for i in range(1, want)], 100 * want).alias("q")).first().q if want > 1 and n else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "right").astype(np.int32))

    df = df.withColumn("b", bucket("k"))
    first = sorted((r.b, r.m) for r in df.groupBy("b").agg(F.min("k").alias("m")).collect())
    heads = spark.createDataFrame([(first[i][1], first[i - 1][0]) for i in range(len(first))] or [(0, 0)], "k long, to int").limit(len(first))
    guards = df.join(F.broadcast(heads), "k").groupBy("to", "k").agg(F.min(F.struct("t", "id")).alias("x")).select(F.col("to").alias("b"), F.lit(1).alias("g"), "k", F.col("x.id").alias("id"), F.col("x.t").alias("t"))
    out = df.select("b", F.lit(0).alias("g"), "k", "id", "t").unionByName(guards)
    return out, max(1, len(first))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict | None = None

    def emit(rows: list[dict]) -> pa.RecordBatch:
        """rows: each but the last is followed by its next row."""
        own = [r for r in rows[:-1]]
        edited = []
        for r, nxt in zip(rows[:-1], rows[1:]):
            half = len(r["t"]) // 2
            edited.append(r["t"][: len(r["t"]) - half] + nxt["t"][:half])
        n = len(rows)
        all_row, all_h = sketch(pa.array([r["t"] for r in rows], pa.large_string()))
        fp = as_text(all_row, all_h, n)
        ed = sketch(pa.array(edited, pa.large_string()))
        efp = as_text(*ed, n - 1)
        cut = np.searchsorted(all_row, n - 1)
        cur = all_row[:cut], all_h[:cut]
        lo = np.searchsorted(all_row, 1)
        nxt = all_row[lo:] - 1, all_h[lo:]
        ne, nn = likeness(cur, ed, n - 1), likeness(cur, nxt, n - 1)
        keep = [i for i, r in enumerate(own) if r["g"] == 0 and r["b"] == rows[i + 1]["b"]]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([own[i]["id"] for i in keep], pa.int64()),
                "n_chars": pa.array([len(own[i]["t"]) for i in keep], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                "fingerprint": pa.array([fp[i] for i in keep], pa.string()),
                "edited_fingerprint": pa.array([efp[i] for i in keep], pa.string()),
                "near_edited": pa.array([float(ne[i]) for i in keep], pa.float64()),
                "near_next": pa.array([float(nn[i]) for i in keep], pa.float64()),
            }
        )

    for batch in batches:
        for i, j in T.slices(batch.column(batch.schema.get_field_index("t")), BATCH_BYTES):
            rows = batch.slice(i, j - i).to_pylist()
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                yield emit(rows)


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text and compare with the next text.

    The edited text has the last half of its code points replaced by the first
    as many of the next document in ascending id, the first following the last.
    An empty table gives an empty result; a lone document is its own next.
    """
    rows, n = with_next(documents)
    dealt = rows.repartition(n, "b").sortWithinPartitions("b", "g", "k", "t")
    return dealt.select("b", "g", "id", "t").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
