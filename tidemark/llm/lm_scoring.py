"""Language-model scoring by online logistic mixing of hashed contexts.

A text is its lower-cased words and an end. The commonest words have symbols of
their own in a binary tree that halves their counts at every node; any other
word is an escape followed by its bytes and a space, symbols of a second tree.
So a text is a string of bits, and every bit is predicted by several contexts.

A bit of a word is predicted by the tree's own counts; by bit counts under the
last very common word, hashed with the node (four levels of the tree share a
bucket of 16 bytes, one of them a check); by the most frequent successor of the
word before and of the two words before, as long as it agrees with the bits so
far; and by what last followed the same two words earlier in the same text. A
bit of a spelled byte is predicted by that tree's own counts and by bit counts
under three contexts: three bytes, the word so far, two bytes with the last
very common word.

Predictions are combined in the logistic domain. A gate (which successors still
agree and how sure they are, depth, how often the bucket was seen) selects a
weight for each. Each text starts from weights as fitted and refines a factor
for every predictor online, after its first 64 words, then after every doubling.
Sums of log2 give the bits of the text, bits per byte, and the probability of
the whole text: the code covers every sequence of words, and ends it.

Counts come from all training rows: pairs of context and symbol are summed
before they are shuffled, then by ranges of the context. A context must occur
twice to enter a table, so that a text is no evidence for itself alone. Tables
have as many slots as contexts were found; where they would pass the memory
bound (``table_bytes`` each), the most frequent contexts fill it. Weights are
fitted on all training texts: these are dealt into folds, every fold's bits meet
tables of the counts of the other folds, and bits of one gate and equal
predictions (in small steps) are counted together. The tables that score hold
all rows.

The unigram base is added up exactly: counts of the words with symbols are at
hand as a text is scored, the others are joined.

Null and empty texts have the end alone. A very long text is scored as a whole,
at linear cost. Rows with the same id, or repeated, are scored each on its own;
a null id counts as an empty id for the split. An empty table gives an empty
result; without training rows all counts are zero. Extra columns are ignored.
Words of equal count are ordered by their hash, so reruns agree.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import crc_mod, durable, forget, shuffle_partitions

#: Words with a symbol, 20 bytes each in every worker; other words are spelled and their counts joined.
VOCABULARY = 1 << 20
#: Memory bound of each of the four tables.
TABLE_BYTES = 1 << 25
#: Very common words are those with this share of all tokens.
FREQUENT = 1 / 512
#: Folds of the training texts for the starting weights.
FOLDS = 2
RATE = 0.05
#: Words after which a text's factors are refined first.
BLOCK = 64
SLICE_BYTES = 1 << 20
#: Pairs that a task holds before it sums them.
HELD_KEYS = 1 << 21
WORD, ONE, TWO, SPELL = 0, 1, 2, 3  # kinds of pairs, and of tables
SYM_BITS = 22  # of a pair's 64 bits; the context has the others
U = np.uint64


@dataclass
class Tree:
    """Symbols in order of falling count, halved again and again. A node is the symbol where its right half begins."""

    child: np.ndarray  # at 2 * node + bit; -1: a symbol
    own: np.ndarray  # logit of a 1
    depth: np.ndarray  # bits of each symbol
    root: int


def tree(freq: np.ndarray) -> Tree:
    n = len(freq)
    cum = np.concatenate([[0.0], np.cumsum(freq, dtype=float)])
    child, own, depth = np.full(2 * max(n, 1), -1, np.int32), np.zeros(max(n, 1), np.float32), np.zeros(n, np.uint8)
    a, b, up, root, level = np.array([0]), np.array([n]), np.array([-1]), -1, 0
    while True:
        leaf = b - a == 1
        depth[a[leaf]] = level
        a, b, up = a[~leaf & (b > a)], b[~leaf & (b > a)], up[~leaf & (b > a)]
        if not len(a):
            return Tree(child, own, depth, root)
        goal = (cum[a] + cum[b]) / 2
        m = np.clip(np.searchsorted(cum, goal), a + 1, b - 1)
        less = np.maximum(m - 1, a + 1)
        m = np.where(np.abs(cum[less] - goal) <= np.abs(cum[m] - goal), less, m)
        own[m] = np.log((cum[b] - cum[m]) / (cum[m] - cum[a]))
        if level:
            child[up] = m
        else:
            root = int(m[0])
        a, b, up, level = np.concatenate([a, m]), np.concatenate([m, b]), np.concatenate([2 * m, 2 * m + 1]), level + 1


@dataclass
class Vocabulary:
    keys: np.ndarray  # hashes of the words, sorted
    symbol: np.ndarray
    count: np.ndarray  # of each symbol
    words: Tree
    bytes: Tree
    byte_symbol: np.ndarray
    end: int
    escape: int
    common: np.ndarray  # number of each symbol among the very common words, from 1; 0: none

    @cached_property
    def starts(self) -> tuple[U, np.ndarray]:
        """Where the keys of equal first bits begin, and how far a key is shifted for these bits; made in each worker."""
        bits = max(4, len(self.keys).bit_length() - 1)
        first = np.arange(1 << bits, dtype=U) << U(64 - bits)
        return U(64 - bits), np.append(np.searchsorted(self.keys, first), len(self.keys)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the keys, and whether it is there at all."""
        shift, starts = self.starts
        top = (h >> shift).astype(np.int64)
        at, stop = starts[top], starts[top + 1]
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == h
        open_ = np.flatnonzero(~hit & (at + 1 < stop))
        while len(open_):
            at[open_] += 1
            same = self.keys[at[open_]] == h[open_]
            hit[open_[same]] = True
            open_ = open_[~same & (at[open_] + 1 < stop[open_])]
        return at, hit


def make_vocabulary(h: np.ndarray, c: np.ndarray, ends: int, rest: int, once: int, total: int, byte_counts: np.ndarray) -> Vocabulary:
    """h, c: words by falling count. rest: tokens without a symbol; once: words seen once, as many as new ones are due."""
    freq = np.concatenate([[max(ends, 1), rest + once + 1], c]).astype(np.int64)
    o = np.argsort(-freq, kind="stable")
    place = np.empty(len(o), np.int32)
    place[o] = np.arange(len(o))
    count = freq[o]
    by = np.argsort(-byte_counts, kind="stable")
    byte_symbol = np.empty(256, np.int32)
    byte_symbol[by] = np.arange(256)
    often = count >= max(2, total * FREQUENT)
    often[place[:2]] = False
    s = np.argsort(h, kind="stable")
    return Vocabulary(h[s], place[2:][s], count, tree(count), tree(byte_counts[by] + 1), byte_symbol, int(place[0]), int(place[1]), np.where(often, np.cumsum(often), 0).astype(np.int32))


@dataclass
class Tokens:
    """A batch of texts as symbols; contexts are 42-bit hashes."""

    rows: int
    n_bytes: np.ndarray
    sym: np.ndarray
    row: np.ndarray
    ctx: list[np.ndarray]  # last common word, word before, two words before
    common: np.ndarray
    raw: np.ndarray
    run: np.ndarray
    start: np.ndarray  # of each word
    stop: np.ndarray
    hash: np.ndarray
    hit: np.ndarray  # the word has a symbol
    at: np.ndarray  # token number of each word


def read(v: Vocabulary, texts: pa.Array) -> Tokens:
    raw, off = T.column_bytes(texts)
    raw = T.LOWER[raw]
    s, e, row = T.words(raw, off)
    n, nw = len(off) - 1, len(s)
    run = T.prefix_hash(raw)
    h = T.span_hash(run, s, e)
    sym, hit = np.full(nw, v.escape, np.int32), np.zeros(nw, bool)
    if len(v.keys) and nw:
        i, hit = v.find(h)
        sym[hit] = v.symbol[i[hit]]
    per = np.bincount(row, minlength=n) + 1 if nw else np.ones(n, np.int64)
    at = np.arange(nw) + row
    ends = np.cumsum(per) - 1
    m = nw + n
    first = ends - per + 1
    t_sym, t_row, name = np.full(m, v.end, np.int32), np.repeat(np.arange(n, dtype=np.int32), per), np.zeros(m, U)
    t_sym[at], name[at] = sym, h
    one, two = np.ones(m, U), np.ones(m, U)
    one[1:] = name[:-1]
    one[first] = 1
    two[1:] = one[:-1]
    two[first] = 1
    mark = np.where(v.common[t_sym] > 0, np.arange(m), -1)
    mark[first] = np.maximum(mark[first], first)
    before = np.zeros(m, np.int64)
    before[1:] = np.maximum.accumulate(mark)[:-1] if m else mark[:-1]
    common = v.common[t_sym[before]] if m else v.common[:0]
    common[first] = 0
    lead = T.mix64(np.arange(int(v.common.max(initial=0)) + 1).astype(U) + U(101)) >> U(SYM_BITS)
    ctx = [lead[common], T.mix64(one + U(7)) >> U(SYM_BITS), T.mix64(one * U(0x9E3779B97F4A7C15) + (two ^ U(0x5851F42D4C957F2D))) >> U(SYM_BITS)]
    size = np.diff(off)
    return Tokens(n, size, t_sym, t_row, ctx, common, raw, run, s, e, h, hit, at)


def spelled(v: Vocabulary, t: Tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Byte symbols of some words, a space after each; their rows and three contexts."""
    s, e, tok = t.start[which], t.stop[which], t.at[which]
    k = e - s + 1
    head = np.cumsum(k) - k
    j = np.arange(int(k.sum())) - np.repeat(head, k)  # place in the word
    src = np.repeat(s, k) + j
    pad = np.concatenate([np.full(3, 32, np.uint8), t.raw, np.full(1, 32, np.uint8)])
    byte = np.where(np.repeat(k - 1, k) == j, 32, pad[src + 3])
    b = [np.where(j >= i, pad[src + 3 - i], 32).astype(U) for i in (1, 2, 3)]
    _, inv = T.powers(len(t.raw) + 1)
    w0 = np.repeat(s, k)
    so_far = (t.run[src] - t.run[w0]) * inv[w0]
    two = b[0] | b[1] << U(8)
    common = np.repeat(t.common[tok], k).astype(U)
    ctx = [T.mix64(x) >> U(SYM_BITS) for x in (two | b[2] << U(16) | U(1 << 40), so_far ^ U(0xA0761D6478BD642F), two | common << U(16) | np.minimum(j, 3).astype(U) << U(32) | U(1 << 41))]
    return v.byte_symbol[byte], np.repeat(t.row[tok], k), ctx


def bucket(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = (ctx + node.astype(U) * U(0x9E3779B97F4A7C15)) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def earlier(t: Tokens) -> np.ndarray:
    """What followed the same two words the last time in the same text; -1 if nothing."""
    key = t.ctx[2] << U(20) ^ T.mix64(t.row.astype(U))
    o = np.argsort(key, kind="stable")
    same = key[o[1:]] == key[o[:-1]]
    out = np.full(len(key), -1, np.int32)
    out[o[1:][same]] = t.sym[o[:-1][same]]
    return out


# ---- learning


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (hash, count) of each batch; bytes as words of their own under a marked hash."""
    for b in batches:
        got: list[np.ndarray] = []
        freq = np.zeros(257, np.int64)
        for i, j in T.slices(b.column(0), SLICE_BYTES):
            raw, off = T.column_bytes(b.column(0).slice(i, j - i))
            raw = T.LOWER[raw]
            s, e, _ = T.words(raw, off)
            got.append(T.span_hash(T.prefix_hash(raw), s, e))
            ink = np.bincount(raw, minlength=257)
            ink[:256][T.SPACE] = 0
            ink[32] = len(s)
            ink[256] = j - i
            freq += ink
        if got:
            u, c = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(u), np.int32), "h": u.view(np.int64), "c": c.astype(np.int64)})
            yield pa.RecordBatch.from_pydict({"kind": np.ones(257, np.int32), "h": np.arange(257), "c": freq})


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys by their differences and counts, as byte planes: most high bytes are zero."""
    d = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    c = np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(np.concatenate([d.ravel(), c.ravel()]).tobytes(), asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    x = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 12 * n), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(x[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=U)
    return keys, np.ascontiguousarray(x[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _sum_by_key(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        o = np.argsort(keys)
        keys, counts = keys[o], counts[o]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.diff(np.append(head, len(keys))) if counts is None else np.add.reduceat(counts, head)


def pairs(v: Vocabulary, t: Tokens) -> list[np.ndarray]:
    """Keys of (context, symbol) of each kind. A word seen once stands for a new one: it is an escape, and spelled, as well."""
    once = t.hit.copy()
    once[t.hit] = v.count[t.sym[t.at[t.hit]]] <= 1
    key = lambda c, s: c << U(SYM_BITS) | s.astype(U)
    word = key(t.ctx[0], t.sym)
    more = t.at[once]
    b_sym, _, b_ctx = spelled(v, t, once | ~t.hit)
    return [np.concatenate([word, key(t.ctx[0][more], np.full(len(more), v.escape))]), key(t.ctx[1], t.sym), key(t.ctx[2], t.sym), np.concatenate([key(c, b_sym) for c in b_ctx])]


GRAMS = "shard int, kind int, fold int, data binary"


def _pairs(shared, shards: int, folds: int):
    shift = U(64 - (shards - 1).bit_length()) if shards > 1 else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (kind, fold), parts in sorted(held.items()):
                keys, counts = _sum_by_key(np.concatenate(parts))
                parts.clear()
                top = (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)
                cut = np.flatnonzero(np.diff(top, prepend=-1))
                got = [(int(top[a]), kind, fold, _pack(keys[a:z], counts[a:z])) for a, z in zip(cut, np.append(cut[1:], len(keys)))]
                for x in range(0, len(got), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got[x : x + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["shard", "kind", "fold", "data"])
            held.clear()

        for b in batches:
            folded = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                text = b.column(0).slice(i, j - i)
                for fold in range(folds):
                    own = folded[i:j] == fold
                    if not own.any():
                        continue
                    for kind, keys in enumerate(pairs(v, read(v, text.filter(pa.array(own))))):
                        held.setdefault((kind, fold), []).append(keys)
                        size += len(keys)
                if size > HELD_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    return f


def levels(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Counts to one byte: how often a node was seen (0, 1-2, 3-12, more) in the high bits, the logit in 64 steps in the low."""
    n = c0 + c1
    level = np.clip(np.round(np.log((c1 + 0.4) / (c0 + 0.4)) * 4), -31, 31) + 32
    return np.where(n > 0, ((n > 0).astype(int) + (n > 2) + (n > 12)) * 64 + level, 32).astype(np.uint8)


def _visits(t: Tree, keys: np.ndarray, counts: np.ndarray, lot: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets met by the pairs (sorted), and of every place in them the counts of 0 and of 1; some pairs at a time."""
    got = [x for i in range(0, len(keys), lot) for x in _lot_of_visits(t, keys[i : i + lot], counts[i : i + lot])]
    return _merged(got)


def _merged(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of several counts by bucket; a single one of sorted buckets stays as it is."""
    if len(got) == 1 and (got[0][0][1:] > got[0][0][:-1]).all():
        return got[0]
    u = np.unique(np.concatenate([np.zeros(0, U), *(g[0] for g in got)]))
    c = np.zeros((2, len(u), 16), np.float32)
    for own, c0, c1 in got:
        at = np.searchsorted(u, own)
        if len(at) and np.bincount(at).max() > 1:  # two nodes of one hash
            np.add.at(c[0], at, c0)
            np.add.at(c[1], at, c1)
        else:
            c[0, at] += c0
            c[1, at] += c1
    return u, c[0], c[1]


def _lot_of_visits(t: Tree, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Four levels of the tree at a time. As pairs are sorted, those of one context and node stand together."""
    ctx, sym = keys >> U(SYM_BITS), (keys & U((1 << SYM_BITS) - 1)).astype(np.int32)
    node = np.full(len(sym) if t.root >= 0 else 0, t.root, np.int32)
    while len(node):
        base = bucket(ctx, node)
        head = np.concatenate([[True], base[1:] != base[:-1]])
        at, nib = (np.cumsum(head) - 1) << 5, np.ones(len(node), np.int8)
        which, cells, weights = None, [], []
        s, n = sym, counts
        for _ in range(4):
            bit = s >= node
            nib = 2 * nib + bit
            cells.append(at + nib)
            weights.append(n)
            node = t.child[2 * node + bit]
            live = np.flatnonzero(node >= 0)
            if len(live) < len(node):
                node, s, n, at, nib = node[live], s[live], n[live], at[live], nib[live]
                which = live if which is None else which[live]
            if not len(node):
                break
        u = base[head]
        c = np.bincount(np.concatenate(cells), np.concatenate(weights), 32 * len(u)).reshape(-1, 16, 2)
        yield u, c[:, :, 0].astype(np.float32), c[:, :, 1].astype(np.float32)
        ctx, sym, counts = ctx if which is None else ctx[which], s, n


def _successors(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, packed successor and total of contexts seen twice or more where one symbol follows in most cases.

    Packed: 21 bits of the symbol, then 1 (most cases), 2 (always, of two) or 3 (always, of more), then 8 check bits.
    """
    ctx = keys >> U(SYM_BITS)
    if not len(keys):
        return ctx, np.zeros(0, np.uint32), counts
    head = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    total, best = np.add.reduceat(counts, head), np.maximum.reduceat(counts, head)
    where = np.flatnonzero(counts == np.repeat(best, np.diff(np.append(head, len(ctx)))))
    group = np.searchsorted(head, where, "right") - 1
    where = where[np.concatenate([[True], group[1:] != group[:-1]])]
    keep = (total >= 2) & (2 * best > total)
    c = ctx[head]
    sure = np.where(best < total, 1, np.where(total == 2, 2, 3)).astype(U)
    packed = (keys[where] & U((1 << 21) - 1)) | sure << U(21) | (c & U(255)) << U(24)
    return c[keep], packed[keep].astype(np.uint32), total[keep]


ENTRIES = "kind int, without int, classes array<long>, data binary"


def _entries(shared, folds: int):
    """Of each range of contexts the finished entries of its tables: key, contents, class of the total (log2).

    Tables are without one fold, or with all (-1).
    """

    def out(kind: int, without: int, key: np.ndarray, body: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        cls = np.minimum(np.log2(np.maximum(total, 1)), 40).astype(np.uint8)
        data = len(key).to_bytes(8, "little") + key.astype("<u8").tobytes() + cls.tobytes() + body.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([without], pa.int32()), pa.array([np.bincount(cls, minlength=41).tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["kind", "without", "classes", "data"])

    def finish(v: Vocabulary, kind: int, got: dict[int, list]) -> Iterator[pa.RecordBatch]:
        own = {fold: _sum_by_key(*(np.concatenate(x) for x in zip(*parts))) for fold, parts in got.items()}
        got.clear()
        if kind in (ONE, TWO):
            keys, counts = _sum_by_key(*(np.concatenate(x) for x in zip(*own.values())))
            yield out(kind, -1, *_successors(keys, counts))
            for fold in range(folds):
                rest = counts.copy()
                if fold in own:
                    rest[np.searchsorted(keys, own[fold][0])] -= own[fold][1]
                yield out(kind, fold, *_successors(keys[rest > 0], rest[rest > 0]))
            return
        t = v.words if kind == WORD else v.bytes
        seen = {fold: _visits(t, *x) for fold, x in own.items()}
        own.clear()
        for fold in (-1, *range(folds)):
            u, c0, c1 = _merged([x for k, x in seen.items() if k != fold])
            total = c0[:, 1] + c1[:, 1]
            twice = total >= 2
            yield out(kind, fold, u[twice], levels(c0[twice], c1[twice]), total[twice])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, now, got = shared.value, None, {}
        for b in batches:
            for shard, kind, fold, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if (shard, kind) != now:
                    if now is not None:
                        yield from finish(v, now[1], got)
                    now, got = (shard, kind), {}
                got.setdefault(fold, []).append(_unpack(data.as_py()))
        if now is not None:
            yield from finish(v, now[1], got)
        T.trim()

    return f


def _parse(kind: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    body = np.frombuffer(data, np.uint32 if kind in (ONE, TWO) else np.uint8, offset=8 + 9 * n)
    return np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n), body if kind in (ONE, TWO) else body.reshape(-1, 16)


def _at_least(kind: int, least: int):
    """Entries of one kind whose class is in the table's bound."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                key, cls, body = _parse(kind, data.as_py())
                keep = cls >= least
                key, cls, body = key[keep], cls[keep], body[keep]
                yield pa.RecordBatch.from_pydict({"data": [len(key).to_bytes(8, "little") + key.tobytes() + cls.tobytes() + body.tobytes()]}, schema=pa.schema([("data", pa.binary())]))

    return f


@dataclass
class Model:
    v: Vocabulary
    tables: list[np.ndarray]  # buckets of words, successors of one word, of two, buckets of spelled bytes
    word_weights: np.ndarray  # (gates, 5)
    byte_weights: np.ndarray  # (gates, 4)

    @cached_property
    def word_terms(self) -> list[list[np.ndarray]]:
        """For depths 0, 1 to 3 and more: by successors that agree (5 bits) and the table's byte, the weights; the table's with its logit."""
        gate = (np.arange(1 << 13) >> 8 << 2) + (np.arange(1 << 13) >> 6 & 3)
        by = [[np.ascontiguousarray(self.word_weights[gate + 128 * k, i]) for i in range(5)] for k in range(3)]
        for terms in by:
            terms[1] *= np.tile(LOGIT, 32)
        return by

    @cached_property
    def byte_terms(self) -> list[np.ndarray]:
        """By gate the weight of the tree's own logit; by gate and a table's six low bits its weight and logit."""
        gate = np.arange(1 << 12) >> 6
        seen = [gate >> 2 * i & 3 for i in range(3)]
        tables = [self.byte_weights[gate, i + 1] * LOGIT[seen[i] << 6 | np.arange(1 << 12) & 63] for i in range(3)]
        return [np.ascontiguousarray(self.byte_weights[:, 0]), *tables]


LOGIT = ((np.arange(256) % 64 - 32) / 4).astype(np.float32)
LOGIT[:64] = 0
WORD_GATES, BYTE_GATES = 3 * 128, 64
WORD_START, BYTE_START = (0.5, 0.5, 1.0, 1.5, 1.0), (0.2, 0.4, 0.4, 0.4)


def empty_table(kind: int, n: int, bound: int) -> np.ndarray:
    """Slots for ``n`` entries: the power of two over one and a half times as many, within the bound. Buckets have an empty one behind them."""
    width = 4 if kind in (ONE, TWO) else 16
    bits = min(max(4, int(n + n // 2).bit_length()), (bound // width).bit_length() - 1)
    if kind in (ONE, TWO):
        return np.zeros(1 << bits, np.uint32)
    out = np.full(((1 << bits) + 1, 16), 32, np.uint8)
    out[:, 0] = 0
    return out


def _slot(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    if table.ndim == 1:
        return (key >> U(64 - SYM_BITS - (len(table).bit_length() - 1))).astype(np.int64)
    return (key >> U(64 - ((len(table) - 1).bit_length() - 1))).astype(np.int64)


def fill(table: np.ndarray, rank: np.ndarray, key: np.ndarray, cls: np.ndarray, body: np.ndarray) -> None:
    """Entries to their slots; of two for one slot the more frequent stays, then the one of the larger key bits. rank holds both."""
    own = cls.astype(np.uint32) << np.uint32(26) | (key & U((1 << 26) - 1)).astype(np.uint32)
    at = _slot(table, key)
    better = np.flatnonzero(own >= rank[at])
    better = better[np.argsort(own[better], kind="stable")]
    rank[at[better]] = own[better]
    table[at[better]] = body[better]
    if table.ndim == 2:
        table[at[better], 0] = (key[better] & U(255)).astype(np.uint8) | 1


def _tables(entries: DataFrame, sizes: dict[int, np.ndarray], table_bytes: int) -> list[np.ndarray]:
    """The four tables of some entries; sizes: of each kind the entries by class."""
    tables: list[np.ndarray] = []
    for k in range(4):
        table = empty_table(k, int(sizes[k].sum()), table_bytes)
        over = np.cumsum(sizes[k][::-1])[::-1] > 2 * len(table)  # classes from here on don't fit
        least = int(np.flatnonzero(over)[-1]) + 1 if over.any() else 0
        rank = np.zeros(len(table), np.uint32)
        for r in entries.where(F.col("kind") == k).select("data").mapInArrow(_at_least(k, least), "data binary").toLocalIterator():
            fill(table, rank, *_parse(k, bytes(r.data)))
        tables.append(table)
        del rank
        T.trim()
    return tables


def learn(train: DataFrame, v: Vocabulary, text: str, fold: Column, folds: int, table_bytes: int) -> Model:
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(v)
    parts = 2 * shuffle_partitions(spark)
    shards = 1 << max(0, (parts - 1).bit_length())
    grams = train.select(text, fold.alias("f")).mapInArrow(_pairs(shared, shards, folds), GRAMS).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    entries = durable(grams.mapInArrow(_entries(shared, folds), ENTRIES), "entries")
    shared.destroy()
    sizes = {f: {k: np.zeros(41, np.int64) for k in range(4)} for f in range(-1, folds)}
    for r in entries.select("kind", "without", F.posexplode("classes").alias("i", "n")).groupBy("kind", "without", "i").agg(F.sum("n").alias("n")).collect():
        sizes[r.without][r.kind][r.i] = r.n
    start = [np.tile(np.float32(x), (n, 1)) for x, n in ((WORD_START, WORD_GATES), (BYTE_START, BYTE_GATES))]
    seen: list[DataFrame] = []
    for f in range(folds):
        m = Model(v, _tables(entries.where(F.col("without") == f), sizes[f], table_bytes), *start)
        model = spark.sparkContext.broadcast(m)
        del m
        gc.collect()
        T.trim()
        seen.append(durable(train.where(fold == f).select(text).mapInArrow(_cells(model), CELLS).groupBy("kind", "cell").agg(F.sum("n").alias("n")), "cells"))
        model.destroy()
    cells = reduce(DataFrame.unionAll, seen).groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    word_weights, byte_weights = (fit_weights(kind, cells.where(F.col("kind") == kind).select("cell", "n").toArrow()) for kind in (WORD, SPELL))
    T.trim()
    m = Model(v, _tables(entries.where("without = -1"), sizes[-1], table_bytes), word_weights, byte_weights)
    forget(spark, entries, *seen)
    return m


CELLS = "kind int, cell long, n long"
#: Steps of a logit in a cell of words and of bytes: of the tree's own, of the tables'.
WORD_STEPS, BYTE_STEPS = (8, 4), (4, 2)
TABLE_LEVEL = np.where(np.arange(256) < 64, 0, np.arange(256) % 64 - 32)


def _own_steps(t: Tree, steps: int, most: int) -> np.ndarray:
    return np.clip(np.round(t.own * steps), -most, most).astype(np.int32)


def word_cells(m: Model, t: Tokens, sym: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of every bit of the words: gate (9 bits), steps of the tree's own logit (6) and of the table's (6) for the bit that came, successors that hit (3)."""
    tree, table, flat = m.v.words, m.tables[WORD], m.tables[WORD].reshape(-1)
    if tree.root < 0 or not len(sym):
        return np.zeros(0, np.uint32)
    depth = tree.depth[sym]
    o = np.argsort(255 - depth, kind="stable")
    pred, sure = successors(m, t)
    sym, ctx, pred, sure, depth = sym[o], t.ctx[0][o], [p[o] for p in pred], [s[o] for s in sure], depth[o]
    left = np.cumsum(np.bincount(depth, minlength=256)[::-1])[::-1]
    node, own, level = np.full(len(sym), tree.root, np.int32), own << 9, TABLE_LEVEL.astype(np.int32) << 3
    gate0 = (sure[0] + 4 * sure[1] + 16 * sure[2]).astype(np.int32) << 8
    live = [(a, p[a], c[a].astype(np.int32) << 8 + 2 * k) for k, (p, c) in enumerate(zip(pred, sure)) for a in [np.flatnonzero(c)]]
    base = nib = None
    out = []
    for d in range(int(depth.max())):
        z = int(left[d + 1])
        node = node[:z]
        if d % 4 == 0:
            base, nib = _look(table, ctx[:z], node), np.ones(z, np.int64)
        lv = flat[base[:z] + nib[:z]]
        bit = sym[:z] >= node
        cell = own[node]
        cell += level[lv]
        cell *= np.where(bit, np.int32(1), np.int32(-1))
        cell += (gate0[:z] + lv >> 6 << 15) + np.int32(128 * ((d > 0) + (d > 3)) << 15 | 32 << 9 | 32 << 3)
        for k, (a, p, c) in enumerate(live):
            if len(a) and a[-1] >= z:
                stop = int(np.searchsorted(a, z))
                a, p, c = a[:stop], p[:stop], c[:stop]
            if len(a):
                hit = (p >= node[a]) == bit[a]
                cell[a] += hit.astype(np.int32) << k
                if not hit.all():
                    gate0[a[~hit]] -= c[~hit]
                    a, p, c = a[hit], p[hit], c[hit]
            live[k] = a, p, c
        out.append(cell.view(np.uint32))
        node = tree.child[2 * node + bit]
        nib = 2 * nib[:z] + bit
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def byte_cells(m: Model, sym: np.ndarray, ctx: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Of every bit of spelled words: gate (6 bits), steps (5 each) of the tree's own logit and of the three tables' for the bit that came."""
    t, table, flat = m.v.bytes, m.tables[SPELL], m.tables[SPELL].reshape(-1)
    depth = t.depth[sym]
    o = np.argsort(255 - depth, kind="stable")
    sym, ctx, depth = sym[o], [c[o] for c in ctx], depth[o]
    left = np.cumsum(np.bincount(depth, minlength=256)[::-1])[::-1]
    node, own = np.full(len(sym), t.root, np.int32), own << 15
    level = [np.clip(np.round(TABLE_LEVEL / 2), -15, 15).astype(np.int32) << k for k in (10, 5, 0)]
    out = []
    for d in range(int(depth.max())):
        z = int(left[d + 1])
        node = node[:z]
        if d % 4 == 0:
            base, nib = [_look(table, c[:z], node) for c in ctx], np.ones(z, np.int64)
        bit = sym[:z] >= node
        lv = [flat[b[:z] + nib[:z]] for b in base]
        cell = own[node]
        for x, q in zip(level, lv):
            cell += x[q]
        cell *= np.where(bit, np.int32(1), np.int32(-1))
        gate = (lv[0] >> np.uint8(6)) + (lv[1] >> np.uint8(6) << np.uint8(2)) + (lv[2] >> np.uint8(6) << np.uint8(4))
        cell += (gate.astype(np.int32) << 20) + np.int32(16 << 15 | 16 << 10 | 16 << 5 | 16)
        out.append(cell.view(np.uint32))
        node = t.child[2 * node + bit]
        nib = 2 * nib[:z] + bit
    return np.concatenate(out)


def _cells(shared):
    """Bits of a task's texts by cell; words seen once, in these texts alone, count as new."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.v
        own = {WORD: _own_steps(v.words, WORD_STEPS[0], 31), SPELL: _own_steps(v.bytes, BYTE_STEPS[0], 15)}
        held: dict[int, list[np.ndarray]] = {WORD: [], SPELL: []}
        sums = {k: (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for k in held}

        def add(kind: int) -> None:
            got = _sum_by_key(np.concatenate([np.zeros(0, np.uint32), *held[kind]]))
            held[kind].clear()
            sums[kind] = _sum_by_key(*(np.concatenate(x) for x in zip(sums[kind], got)))

        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                t = read(v, b.column(0).slice(i, j - i))
                once = v.count[t.sym[t.at]] <= 1
                sym = t.sym.copy()
                sym[t.at[once]] = v.escape
                held[WORD].append(word_cells(m, t, sym, own[WORD]))
                if (once | ~t.hit).any():
                    b_sym, _, b_ctx = spelled(v, t, once | ~t.hit)
                    held[SPELL].append(byte_cells(m, b_sym, b_ctx, own[SPELL]))
                for kind, parts in held.items():
                    if sum(map(len, parts)) > HELD_KEYS:
                        add(kind)
        for kind in held:
            add(kind)
            cell, n = sums[kind]
            for i in range(0, len(cell), 1 << 16):
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(cell[i : i + (1 << 16)]), kind, np.int32), "cell": cell[i : i + (1 << 16)].astype(np.int64), "n": n[i : i + (1 << 16)]})
        T.trim()

    return f


def features(kind: int, cell: np.ndarray) -> np.ndarray:
    """What the weights of a cell's gate multiply, pointing to the bit that came."""
    if kind == SPELL:
        own, tables = BYTE_STEPS
        return np.stack([((cell >> 15 & 31) - 16) / own, *(((cell >> s & 31) - 16) / tables for s in (10, 5, 0))], 1)
    own, tables = WORD_STEPS
    on = [cell >> 17 & 3, cell >> 19 & 3, cell >> 21 & 1]
    return np.stack([((cell >> 9 & 63) - 32) / own, ((cell >> 3 & 63) - 32) / tables, *(np.where(s > 0, 2 * (cell >> k & 1) - 1, 0) for k, s in enumerate(on))], 1)


def fit_weights(kind: int, cells: pa.Table) -> np.ndarray:
    """Newton's method for the weights of all gates together, then of each with these as its prior."""
    gates, start, shift = (BYTE_GATES, BYTE_START, 20) if kind == SPELL else (WORD_GATES, WORD_START, 15)
    cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy().astype(float)
    o = np.argsort(cell)
    cell, n = cell[o], n[o]

    def newton(a: int, z: int, prior: np.ndarray, ridge: float, lot: int = 1 << 16) -> np.ndarray:
        w = prior.copy()
        for _ in range(12):
            h, g = ridge * np.eye(len(w)), -ridge * (w - prior)
            for i in range(a, z, lot):
                x, k = features(kind, cell[i : min(z, i + lot)]), n[i : min(z, i + lot)]
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h += (x * (k * p * (1 - p))[:, None]).T @ x
                g += x.T @ (k * (1 - p))
            w += np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        return w

    w = np.array(start)
    if not len(cell):
        return np.tile(w, (gates, 1)).astype(np.float32)
    w = newton(0, len(cell), w, 20.0)
    out = np.tile(w, (gates, 1))
    at = np.searchsorted(cell >> shift, np.arange(gates + 1))
    for k in range(gates):
        if at[k + 1] > at[k]:
            out[k] = newton(at[k], at[k + 1], w, 20.0)
    return out.astype(np.float32)


# ---- scoring


def successors(m: Model, t: Tokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every token the successors of one word, of two, and in the same text; how sure each is (0: none)."""
    pred, sure = [], []
    for k in (ONE, TWO):
        x = m.tables[k][_slot(m.tables[k], t.ctx[k])]
        pred.append((x & np.uint32((1 << 21) - 1)).astype(np.int32))
        sure.append(np.where(x >> np.uint32(24) == (t.ctx[k] & U(255)).astype(np.uint32), x >> np.uint32(21) & np.uint32(7), 0).astype(np.uint8))
    own = earlier(t)
    return [*pred, own], [*sure, (own >= 0).astype(np.uint8)]


def log2_probability(m: Model, texts: pa.Array, t: Tokens | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log2 of each text's probability, and its bytes with an end."""
    v = m.v
    t = read(v, texts) if t is None else t
    total = np.zeros(t.rows)
    if not t.rows:
        return total, t.n_bytes
    sym = t.sym
    pred, sure = successors(m, t)
    first = np.searchsorted(t.row, np.arange(t.rows))
    place = np.arange(len(sym)) - first[t.row]
    block = (np.frexp((place // BLOCK + 1).astype(np.float32))[1] - 1).astype(np.uint16)
    final = block[np.append(first[1:], len(sym)) - 1]
    last = int(final.max())
    # the last block of a text refines nothing and comes at the end, with those of all texts
    block[block == final[t.row]] = last
    depth = v.words.depth[sym]
    # blocks one after the other, in each the longest codes first: at every depth what is left is a stretch
    o = np.argsort(block << np.uint16(8) | 255 - depth, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=last + 1))
    scale = np.ones((5, t.rows), np.float32)
    for k, (a, z) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
        i = o[a:z]
        _block(m, sym[i], t.ctx[0][i], [p[i] for p in pred], [s[i] for s in sure], depth[i], t.row[i], scale, total, k < last)
    if not t.hit.all():
        b_sym, b_row, b_ctx = spelled(v, t, ~t.hit)
        _bytes(m, b_sym, b_row, b_ctx, total)
    return total, t.n_bytes + 1


def _look(table: np.ndarray, ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where each bucket begins in the flat table; the empty one where the check fails."""
    key = bucket(ctx, node)
    at = _slot(table, key)
    return np.where(table[at, 0] == (key & U(255)).astype(np.uint8) | 1, at, len(table) - 1) * 16


def _block(m: Model, sym: np.ndarray, ctx: np.ndarray, pred: list[np.ndarray], sure: list[np.ndarray], depth: np.ndarray, row: np.ndarray, scale: np.ndarray, total: np.ndarray, refine: bool) -> None:
    """Score one block of each of some rows, then refine these rows' factors if more of them follows."""
    t, table, flat = m.v.words, m.tables[WORD], m.tables[WORD].reshape(-1)
    n = len(sym)
    if t.root < 0 or not n:
        return
    left = np.cumsum(np.bincount(depth, minlength=256)[::-1])[::-1]  # symbols with so many bits or more
    node = np.full(n, t.root, np.int32)
    gate0 = (sure[0] + 4 * sure[1] + 16 * sure[2]).astype(np.int64) << 8
    nats, odds, grad = np.zeros(n, np.float32), np.ones(n, np.float32), np.zeros((5, n if refine else 0), np.float32)
    s = [scale[k][row] for k in range(5)]
    # of each kind of successor the symbols where it agrees so far, the successor, what it adds to the gate
    live = [(a, p[a], c[a].astype(np.int64) << 8 + 2 * k) for k, (p, c) in enumerate(zip(pred, sure)) for a in [np.flatnonzero(c)]]
    base = nib = None
    for d in range(int(depth.max())):
        z = int(left[d + 1])
        node = node[:z]
        if d % 4 == 0:
            base, nib = _look(table, ctx[:z], node), np.ones(z, np.int64)
        terms = m.word_terms[(d > 0) + (d > 3)]
        gate = gate0[:z] + flat[base[:z] + nib[:z]]
        bit = sym[:z] >= node
        # all terms point away from the bit that came
        away = np.where(bit, np.float32(-1), np.float32(1))
        s0, s1 = t.own[node], terms[1][gate]
        s0 *= terms[0][gate]
        if refine:
            s0 *= away
            s1 *= away
        x = s0 * s[0][:z]
        x += s1 * s[1][:z]
        if not refine:
            x *= away
        added = []
        for k, (a, p, c) in enumerate(live):
            if len(a) and a[-1] >= z:
                stop = int(np.searchsorted(a, z))
                a, p, c = a[:stop], p[:stop], c[:stop]
            if len(a):
                hit = (p >= node[a]) == bit[a]
                sk = terms[2 + k][gate[a]]
                np.negative(sk, out=sk, where=hit)
                x[a] += sk * s[2 + k][a]
                if refine:
                    added.append((k, a, sk))
                if not hit.all():
                    gate0[a[~hit]] -= c[~hit]
                    a, p, c = a[hit], p[hit], c[hit]
            live[k] = a, p, c
        np.minimum(x, 18, out=x)
        np.exp(x, out=x)
        x += 1
        # a product of four is at most e**72, within a float's range
        odds[:z] *= x
        if d % 4 == 3:
            nats[:z] += np.log(odds[:z])
            odds[:z] = 1
        if refine:
            err = np.reciprocal(x, out=x)
            err -= 1
            grad[0, :z] += err * s0
            grad[1, :z] += err * s1
            for k, a, sk in added:
                grad[2 + k, a] += err[a] * sk
        node = t.child[2 * node + bit]
        nib = 2 * nib[:z] + bit
    nats += np.log(odds)
    rows = scale.shape[1]
    total -= np.bincount(row, weights=nats, minlength=rows) / np.log(2)
    if refine:
        bits = np.maximum(np.bincount(row, weights=depth, minlength=rows), 1)
        for k in range(5):
            scale[k] += np.clip(RATE * np.bincount(row, weights=grad[k], minlength=rows) / np.sqrt(bits), -0.25, 0.25).astype(np.float32)


def _bytes(m: Model, sym: np.ndarray, row: np.ndarray, ctx: list[np.ndarray], total: np.ndarray) -> None:
    """Score the bytes of spelled words."""
    t, table, flat, terms = m.v.bytes, m.tables[SPELL], m.tables[SPELL].reshape(-1), m.byte_terms
    depth = t.depth[sym]
    o = np.argsort(255 - depth, kind="stable")
    sym, row, ctx, depth = sym[o], row[o], [c[o] for c in ctx], depth[o]
    left = np.cumsum(np.bincount(depth, minlength=256)[::-1])[::-1]
    nats, odds = np.zeros(len(sym), np.float32), np.ones(len(sym), np.float32)
    node = np.full(len(sym), t.root, np.int32)
    for d in range(int(depth.max())):
        z = int(left[d + 1])
        node = node[:z]
        if d % 4 == 0:
            base, nib = [_look(table, c[:z], node) for c in ctx], np.ones(z, np.int64)
        bit = sym[:z] >= node
        lv = [flat[b[:z] + nib[:z]] for b in base]
        gate = ((lv[0] >> np.uint8(6)) + (lv[1] >> np.uint8(6) << np.uint8(2)) + (lv[2] >> np.uint8(6) << np.uint8(4))).astype(np.int64)
        x = t.own[node]
        x *= terms[0][gate]
        gate <<= 6
        for f, q in zip(terms[1:], lv):
            x += f[gate + (q & np.uint8(63))]
        x *= np.where(bit, np.float32(-1), np.float32(1))
        np.minimum(x, 18, out=x)
        np.exp(x, out=x)
        x += 1
        odds[:z] *= x
        if d % 4 == 3:
            nats[:z] += np.log(odds[:z])
            odds[:z] = 1
        node = t.child[2 * node + bit]
        nib = 2 * nib[:z] + bit
    nats += np.log(odds)
    total -= np.bincount(row, weights=nats, minlength=len(total)) / np.log(2)


def bits_per_byte(m: Model, texts: list[str | None]) -> np.ndarray:
    total, size = log2_probability(m, pa.array(texts, pa.large_string()))
    return -total / size


SCORED = ["score", "bits_per_byte", "n_tokens", "n_hit", "log_hit", "open"]


def _score(shared):
    """Each row's score; its words, those with a symbol and the sum of their logs; and the words still open."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.v.count + 1.0)
        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                part = b.slice(i, j - i)
                t = read(m.v, part.column(0))
                total, size = log2_probability(m, part.column(0), t=t)
                row = t.row[t.at]
                known = np.bincount(row[t.hit], minlength=t.rows)
                log_hit = np.bincount(row[t.hit], weights=logs[t.sym[t.at[t.hit]]], minlength=t.rows).astype(float)
                off = np.concatenate([[0], np.cumsum(np.bincount(row[~t.hit], minlength=t.rows))]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(off), pa.array(t.hash[~t.hit].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(total * np.log10(2)), pa.array(-total / size), pa.array(np.bincount(t.row, minlength=t.rows).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(log_hit), words], names=[*part.schema.names[1:], *SCORED])
        T.trim()

    return f


def fit(train: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, table_bytes: int = TABLE_BYTES, folds: int = FOLDS) -> tuple[Model, DataFrame, int, int, int]:
    """Model, word counts (h, c) as a table, training tokens, distinct tokens, training texts."""
    hist = durable(train.select(text).mapInArrow(_histogram, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "words")
    got = {r.h: r.c for r in hist.where("kind = 1").collect()}
    ends = int(got.pop(256, 0))
    words = hist.where("kind = 0").select("h", "c")
    tot = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)).alias("once")).first()
    # the commonest words by steps of an eighth of a binary order of their counts, as many steps as stay within the bound
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r.s: r.n for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    least, room = None, vocabulary
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            break
        least, room = k, room - sizes[k]
    top = words.where(step >= least if least is not None else F.lit(False)).toArrow()
    h, c = top["h"].to_numpy().view(U), top["c"].to_numpy().astype(np.int64)
    o = np.lexsort((h, -c))
    h, c = h[o], c[o]
    v = make_vocabulary(h, c, ends, int(tot.n) - int(c.sum()), int(tot.once), int(tot.n) + ends, np.array([got.get(i, 0) for i in range(256)], np.int64))
    del top, h, c, o
    T.trim()
    fold = F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))), F.lit(folds)).cast("int")
    return learn(train, v, text, fold, folds, table_bytes), words, int(tot.n) + ends, int(tot.v) + (ends > 0), ends


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The table's ids with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``train`` is the condition of rows to learn from; options are those of :func:`fit`.
    """
    model, words, n_train, v, ends = fit(documents.where(train), id_col, text, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.coalesce(F.col(text), F.lit("")).alias("__t"), F.col(id_col).alias("id"))
    kind = docs.schema["id"].dataType.simpleString()
    scored = docs.mapInArrow(_score(shared), f"id {kind}, score double, bits_per_byte double, n_tokens long, n_hit long, log_hit double, open array<long>")
    # a row's number is fixed as it is written
    del model
    gc.collect()
    T.trim()
    scored = durable(scored.withColumn("rn", F.monotonically_increasing_id()), "scored")
    shared.destroy()  # the driver keeps a copy otherwise
    rare = scored.select("rn", F.explode("open").alias("h")).groupBy("rn", "h").agg(F.count("*").alias("k"))
    met = rare.join(words.hint("merge"), "h").groupBy("rn").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("l"))
    out = scored.drop("open").join(met.hint("merge"), "rn", "left")
    end_known, end_log = (1, float(np.log10(ends + 1))) if ends else (0, 0.0)
    floor = float(np.log10(n_train + v + 1))
    known = F.col("n_hit") + F.coalesce("k", F.lit(0)) + end_known
    base = F.col("log_hit") + F.coalesce("l", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(floor)
    return out.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return crc_mod(id_col, folds) == fold
