"""Suffix-array dedup of exact byte strings by difference-cover blocks.

A byte is removed if it lies in a string of ``length`` bytes that starts
anywhere else as well. Strings that start at different places are suffixes cut
at ``length``; equal ones are neighbours in the suffix array.

Suffixes are dealt to buckets by the smallest hash among the grams of their
first ``length`` bytes: equal strings have equal grams, hence the same bucket
and the same distance from that gram. Suffixes of a text that follow each other
and share their gram go together, as a segment from the first one's start to
the last one's end. A bucket of one segment holds no repeat; a
first pass counts buckets, and a filter of fixed size keeps the rest out. Equal segments
repeat each other whole and need no sorting, so one of each is kept. Only the
distinct segments of buckets with two or more are sorted.

A block of buckets is sorted at a time. Sample places are those in a
difference cover modulo ``PERIOD``: every two places have a common shift, under
``PERIOD``, that brings both to sample places. Sample suffixes are ranked
first, by ``length`` bytes. Suffixes are then split by their first ``PERIOD``
bytes, and what ties by rounds of comparison with a pivot: bytes agree up to
the common shift, the ranks there decide. Ties of any length so cost one
comparison, and a block's memory is a multiple of its bytes. Neighbours in the
order are compared byte for byte.
A bucket over the bound of a block is dealt anew by the hash of the whole
string, for which counting is enough.

Null and empty texts lose nothing. Rows with the same id and text are copies of
each other. Texts shorter than ``length`` are kept. An empty table gives an
empty result; extra columns are ignored. Equal strings tie, and all of them go.
A very long text is read in pieces, with the same result.
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
from .common import durable

LENGTH = 200
GRAM = 48
# A perfect difference set, every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
SLICE_BYTES = 1 << 20
FILTER_BITS = 26
BLOCK_BYTES = 1 << 20
#: A bucket whose distinct segments have more bytes than memory for two blocks is counted by whole strings, with the same result.
FULL = 2 * BLOCK_BYTES
#: A longer text is cut into pieces that overlap by all but one byte of a string.
PIECE = 1 << 25


def shift_table() -> np.ndarray:
    """The least shift that brings residues a and b into the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for s in reversed(range(PERIOD)):
        for a in COVER:
            for b in COVER:
                out[(a - s) % PERIOD, (b - s) % PERIOD] = s
    assert (out >= 0).all()
    return out


SHIFT = shift_table()

# Byte values of a second, independent hash.
OTHER_VALUE = T.mix64(T.BYTE_VALUE)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from running minima of blocks of that length, both ways."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, keys_only: bool = False) -> tuple[np.ndarray, ...]:
    """(row, start in row, number of suffixes, bucket key, two hashes of the segment)."""
    n = len(raw)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    if n < length:
        return none
    run = T.prefix_hash(raw)
    h = run[gram:] - run[:-gram]
    h *= T.powers(n)[1][: len(h)]
    h = T.mix64(h)
    # the place in the low bits makes the leftmost of equal hashes win, wherever the text stands
    low = np.uint64((1 << 26) - 1)
    assert n < 1 << 26
    m = window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    m &= low
    anchor = m.view(np.int64)
    lens = np.diff(off)
    ok = np.repeat(off[1:] - length, lens)[: len(anchor)] >= np.arange(len(anchor))
    first = ok.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first[off[:-1][(off[:-1] < len(anchor)) & (lens > 0)]] |= ok[off[:-1][(off[:-1] < len(anchor)) & (lens > 0)]]
    s = np.flatnonzero(first)
    if not len(s):
        return none
    key = h[anchor[s]]
    if keys_only:
        return s, s, s, key, key, key
    seen = np.cumsum(ok)
    count = np.diff(np.append(seen[s] - 1, seen[-1]))
    row = np.searchsorted(off, s, "right") - 1
    e = s + count - 1 + length
    shape = (anchor[s] - s).astype(np.uint64)  # equal bytes with equal grams have it equal
    h1 = T.span_hash(run, s, e, 1)
    other = np.zeros(n + 1, np.uint64)
    np.cumsum(OTHER_VALUE[raw] * T.powers(n)[0][:n], out=other[1:])
    return row, s - off[row], count, key, h1, T.span_hash(other, s, e, 2) ^ T.mix64(shape)


def _segment_rows(length: int, sieve=None, keys_only: bool = False):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                part = b.slice(i, j - i)
                raw, off = T.column_bytes(part.column(0))
                if len(raw) > PIECE and j - i == 1:
                    cuts = [(a, raw[a : a + PIECE + length - 1]) for a in range(0, len(raw) - length + 1, PIECE)]
                    got = [segments(x, np.array([0, len(x)]), length, keys_only=keys_only) for _, x in cuts]
                    row, start, count, key, h1, h2 = (np.concatenate(x) for x in zip(*got))
                    start = start + np.repeat([a for a, _ in cuts], [len(g[0]) for g in got])
                else:
                    row, start, count, key, h1, h2 = segments(raw, off, length, keys_only=keys_only)
                if keys_only:
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64)})
                    continue
                if bits is not None and len(key):
                    slot = (T.mix64(key) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    ok = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                    row, start, count, key, h1, h2 = (x[ok] for x in (row, start, count, key, h1, h2))
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["id", "th", "start", "count", "key", "h1", "h2"])

    return f


def key_filter(keys: DataFrame) -> bytes:
    """A bit for every hash value of FILTER_BITS bits that some key has: 8 MB, whatever the number of keys.

    It only spares rows that can't matter; a full filter lets all pass, and results stay the same.
    """
    page = 15

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            slot = (T.mix64(b.column(1).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            for k in np.unique(slot >> page):
                own = pages.setdefault(int(k), np.zeros(1 << page, bool))
                own[slot[slot >> page == k] & ((1 << page) - 1)] = True
        for k, v in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.mapInArrow(_with_page(page), "page int, key long").repartition(n, "page").mapInArrow(f, "page int, bits binary")
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    size = (1 << page) >> 3
    for r in rows.toLocalIterator():
        out[r.page * size : (r.page + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _with_page(page: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = T.mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS + page)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), b.column(0)], names=["page", "key"])

    return f


def sorted_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the places ``at`` by group, then by the first ``length`` bytes from there: difference-cover sorting of one block."""
    whole = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(whole, 4)
    sample = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    rank_at = np.full(len(text), -1, np.int64)
    rank_at[sample] = _by_bytes(words, sample, np.zeros(len(sample), np.int64), length)
    # a class goes by the place of its first member in the order
    cls = np.unique(group, return_inverse=True)[1].ravel()
    size = np.bincount(cls)
    cls = _by_bytes(words, at, (np.cumsum(size) - size)[cls], PERIOD)
    settled = np.bincount(cls, minlength=len(at))[cls] == 1
    # rounds of three-way splitting: every unsettled class picks a pivot and parts into less, equal, greater
    while len(todo := np.flatnonzero(~settled)):
        o = todo[np.argsort(cls[todo], kind="stable")]
        new = np.ones(len(o), bool)
        new[1:] = cls[o[1:]] != cls[o[:-1]]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(o)))
        of = np.repeat(np.arange(len(starts)), size)
        pivot = o[starts + size // 2][of]
        s = SHIFT[at[o] % PERIOD, at[pivot] % PERIOD]
        side = np.sign(rank_at[at[o] + s] - rank_at[at[pivot] + s]).astype(np.int64)
        part = np.bincount(of * 3 + side + 1, minlength=3 * len(starts))
        ahead = (np.cumsum(part) - part).reshape(-1, 3)
        cls[o] += (ahead - ahead[:, :1]).ravel()[of * 3 + side + 1]
        settled[o[(side == 0) | (part[of * 3 + side + 1] == 1)]] = True
    return np.argsort(cls, kind="stable")


def _by_bytes(words: np.ndarray, at: np.ndarray, cls: np.ndarray, length: int) -> np.ndarray:
    """Split classes by ``length`` bytes, four at a time; whoever is alone in a class is done."""
    cls = cls.copy()
    size = np.bincount(cls, minlength=len(at))
    todo = np.flatnonzero(size[cls] > 1)
    for k in (*range(0, length - 4, 4), length - 4):
        if not len(todo):
            break
        w = np.ascontiguousarray(words[at[todo] + k]).view(">u4").ravel().astype(np.int64)
        key = (cls[todo] << 32) | w
        o = np.argsort(key)
        key, todo = key[o], todo[o]
        old, place = cls[todo], np.arange(len(todo))
        new = np.ones(len(todo), bool)
        new[1:] = key[1:] != key[:-1]
        top = np.ones(len(todo), bool)
        top[1:] = old[1:] != old[:-1]
        lead = np.flatnonzero(new)
        base = np.maximum.accumulate(np.where(top, place, 0))
        start = np.maximum.accumulate(np.where(new, place, 0))
        cls[todo] = old + start - base
        alone = np.diff(np.append(lead, len(todo))) == 1
        todo = todo[~np.repeat(alone, np.diff(np.append(lead, len(todo))))]
    return cls


def repeated_places(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the next ``length`` bytes of each place are found at another place of its group: equal ones are neighbours."""
    o = sorted_suffixes(text, at, group, length)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    left, right = at[o[:-1]], at[o[1:]]
    same = group[o[:-1]] == group[o[1:]]
    for k in (*range(0, length - 8, 8), length - 8):
        w = np.flatnonzero(same)
        same[w] = np.ascontiguousarray(words[left[w] + k]).view(np.int64).ravel() == np.ascontiguousarray(words[right[w] + k]).view(np.int64).ravel()
    flag = np.zeros(len(at), bool)
    flag[o[:-1]] |= same
    flag[o[1:]] |= same
    return flag


def repeats_in_block(seg: list[bytes], group: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its suffixes are found again in its group."""
    sizes = np.array([len(s) for s in seg], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = sizes - length + 1
    text = np.frombuffer(b"".join(seg), np.uint8)
    at = np.repeat(base - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    flag = repeated_places(text, at, np.repeat(group, count), length)
    return np.split(flag, np.cumsum(count)[:-1])


def _runs(flag: np.ndarray) -> list[int]:
    """Start, end, start, end, ... of the runs of true."""
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)]).ravel().tolist()


def _sorted_blocks(length: int):
    """Rows arrive with a bucket's segments together."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            group = np.array([r[0] for r in held], np.int64)
            flags = repeats_in_block([r[3] for r in held], group, length)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), pa.array([_runs(x) for x in flags], pa.list_(pa.int32()))], names=["key", "h1", "h2", "runs"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size > BLOCK_BYTES and r[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield out()

    return f


def _strings(length: int):
    """Each suffix of a segment by two hashes of its bytes, for buckets too full for a block."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, h1, h2, seg in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.frombuffer(seg, np.uint8)
                p = np.arange(len(raw) - length + 1)
                a = T.span_hash(T.prefix_hash(raw), p, p + length)
                c = T.span_hash(T.prefix_hash(raw[::-1]), len(raw) - p - length, len(raw) - p, 7)
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x)) for x in (key, h1, h2)] + [pa.array(p.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["key", "h1", "h2", "p", "a", "c"])

    return f


def repeated(documents: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, full: int = FULL) -> DataFrame:
    """id, th, marks: for documents with repeats, flat (start, end) pairs of bytes to remove."""
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    rows = rows.where(F.octet_length("t") >= length)
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, th long, start int, count int, key long, h1 long, h2 long"
    twice = rows.mapInArrow(_segment_rows(length, None, True), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sieve = rows.sparkSession.sparkContext.broadcast(key_filter(twice))
    seg = durable(rows.mapInArrow(_segment_rows(length, sieve), shape), "segments")
    # of each distinct segment how often it stands, of each bucket how many distinct ones it has
    kinds = seg.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "count")).alias("at"))
    kinds = durable(kinds, "kinds")
    size = F.sum(F.col("at.count") + (length - 1)).alias("bytes")
    buckets = kinds.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), size).where("`all` > 1").drop("all")
    live = durable(kinds.join(buckets, "key"), "live")
    # the bytes of one segment of each kind, from the text where it stands first
    need = live.where("kinds > 1").select("key", "h1", "h2", "bytes", F.col("at.id").alias("id"), F.col("at.th").alias("th"), F.col("at.start").alias("start"), F.col("at.count").alias("count"))
    asked = need.groupBy("id", "th").agg(F.collect_list(F.struct("key", "h1", "h2", "bytes", "start", "count")).alias("want"))
    src = rows.withColumnsRenamed({"id": "__i", "th": "__h"})
    src = src.join(asked, src["__i"].eqNullSafe(asked.id) & (src["__h"] == asked.th))
    cut = src.select(F.encode("t", "UTF-8").alias("t"), F.explode("want").alias("w"))
    cut = cut.select("w.key", "w.h1", "w.h2", "w.bytes", F.substring(F.col("t"), F.col("w.start") + 1, F.col("w.count") + (length - 1)).alias("seg"))
    cut = durable(cut, "bytes").dropDuplicates(["key", "h1", "h2"])
    cut = durable(cut, "bytes")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = cut.where(F.col("bytes") <= full).select("key", "h1", "h2", "seg").repartition(parts, "key").sortWithinPartitions("key")
    sorted_ = small.mapInArrow(_sorted_blocks(length), "key long, h1 long, h2 long, runs array<int>")
    strings = cut.where(F.col("bytes") > full).select("key", "h1", "h2", "seg").repartition(parts).mapInArrow(_strings(length), "key long, h1 long, h2 long, p int, a long, c long")
    strings = durable(strings, "strings")
    many = strings.groupBy("a", "c").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hit = strings.join(many, ["a", "c"]).groupBy("key", "h1", "h2").agg(F.flatten(F.collect_list(F.array(F.col("p"), F.col("p") + 1))).alias("runs"))
    runs = sorted_.unionByName(hit).where(F.size("runs") > 0)
    whole = live.where("n > 1").select("key", "h1", "h2", F.array(F.lit(0), F.col("at.count")).alias("runs"))
    single = live.where("n = 1").select("key", "h1", "h2").join(runs, ["key", "h1", "h2"])
    marks = durable(whole.unionByName(single), "marks")
    found = seg.join(marks, ["key", "h1", "h2"])
    span = F.transform("runs", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, length - 1).otherwise(0))
    return found.groupBy("id", "th").agg(F.flatten(F.collect_list(span)).alias("marks"))


def union_spans(marks: list[int] | np.ndarray) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-adjacent spans covering the same bytes."""
    m = np.asarray(marks, np.int64).reshape(-1, 2)
    m = m[np.argsort(m[:, 0], kind="stable")]
    top = np.maximum.accumulate(m[:, 1])
    new = np.ones(len(m), bool)
    new[1:] = m[1:, 0] > top[:-1]
    at = np.flatnonzero(new)
    return list(zip(m[at, 0].tolist(), top[np.append(at[1:], len(m)) - 1].tolist()))


def dedup(documents: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    marks = repeated(documents, id_col, text, length)
    marks = durable(marks, "spans").withColumnsRenamed({"id": "__i", "th": "__h"})
    d = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(id_col).alias("id"))
    d = d.withColumn("h", F.xxhash64("t")).join(marks, F.col("id").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h")), "left")

    @F.pandas_udf("struct<n_removed:long, n_spans:long, kept_sha256:string>")
    def cut(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(t, m):
            raw = a.encode()
            if b is None:
                out.append((0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            spans = union_spans(b)
            h, at = hashlib.sha256(), 0
            for x, y in spans:
                h.update(raw[at:x])
                at = y
            h.update(raw[at:])
            out.append((sum(y - x for x, y in spans), len(spans), h.hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    d = d.withColumn("c", cut("t", "marks"))
    return d.select(F.col("id").alias(id_col), F.octet_length("t").cast("long").alias("n_bytes"), "c.n_removed", "c.n_spans", "c.kept_sha256")
