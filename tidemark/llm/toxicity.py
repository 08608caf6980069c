"""Toxicity: maximum-scoring segments of token log-odds.

Training learns, for every word and every beginning of a word, the log-odds of
toxic against other texts under a Dirichlet prior, by the texts that hold it. A
token's weight is that of the unit, the word or a stem that its forms share,
whose log-odds are furthest from 0 for certain (by two standard errors); a word
that repeats the one before it has none. A text is a sequence of these weights; one linear scan
finds every maximal-scoring segment. Segment scores S of clean text follow an
extreme-value law, so K * n * exp(-lambda * S) is the number of such segments
expected by chance in a text of n tokens; lambda is the root of
sum(p * exp(lambda * s)) = 1 over clean tokens, K is fitted by moments. A
segment is significant if fewer than one is expected; the calibrated scores of
all significant segments are summed, and a logistic curve over this sum and the
best segment's score gives the probability of the label. Weights that calibrate
a labelled text come from other texts (three folds by hash of the text).

Null and empty texts have no segment and get the score of S = 0. A very long
text is scanned whole, and its expected number of chance segments grows with
it. Labels that are null don't train; repeated labels of one id count as their
largest, and so do labels of equal texts, which train once. Texts that tie have
equal scores, whatever their ids. Repeated rows are scored each. With no
labelled rows, or of one class only, every score is the smoothed share of toxic
labels. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import crc_mod, durable

#: At most so many labelled texts train, those with the smallest hash of the id.
MAX_LABELLED = 40_000
#: Units with a weight have a z-score of so much in some fold.
MIN_Z = 3.0
#: Bytes of the beginnings that are units; 0 is the whole word.
UNITS = (0, 4, 5, 6, 7, 8, 9)
FOLDS = 3
#: Prior occurrences of every token, shared between the classes as their tokens are.
PRIOR = 2.0
#: Weight of every token that the table doesn't hold, so that chance segments stay short.
DRIFT = -0.15
CLIP = 9.0
SLICE_BYTES = 512 << 10
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&<>|_~`^=+/\\-"]] = True


@dataclass
class Model:
    tokens: np.ndarray
    weights: np.ndarray
    lam: float
    log_k: float
    coef: np.ndarray
    prior: float


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's units (a row for each kind, 0: none), lower case, without punctuation around it; its row; words of each row."""
    raw, off = T.column_bytes(texts)
    raw = T.LOWER[raw]
    s, e, row = T.words(raw, off)
    for _ in range(4):
        if len(s):
            s = s + (PUNCT[raw[s]] & (e - s > 1))
            e = e - (PUNCT[raw[e - 1]] & (e - s > 1))
    run = T.prefix_hash(raw)
    h = np.zeros((len(UNITS), len(s)), np.uint64)
    for i, k in enumerate(UNITS):
        ok = e - s >= max(k, 1)
        h[i, ok] = T.span_hash(run, s[ok], s[ok] + k if k else e[ok], k)
    return h, row, np.bincount(row, minlength=len(off) - 1) if len(row) else np.zeros(len(off) - 1, np.int64)


def _joined(at: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal-scoring segments from the positive tokens of one row: their places, and the running sum before and after each.

    A stack holds candidates with the running sum at their start and end; a
    new positive token joins back to the nearest candidate that starts lower,
    if that one also ends lower.
    """
    stack: list[list] = []
    for i, lo, hi in zip(at.tolist(), before.tolist(), after.tolist()):
        new = [i, i + 1, lo, hi]
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= new[3]:
                new.append(k)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
        else:
            new.append(-1)
        stack.append(new)
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def maximal_segments(w: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All disjoint maximal-scoring segments of one sequence with a score of ``least`` or more, in linear time."""
    _, first, end, score_ = segments(np.asarray(w, float), np.zeros(len(w), np.int64), 1)
    return [(int(a), int(b), float(v)) for a, b, v in zip(first, end, score_) if v >= least]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y, fold = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        for i, j in T.slices(b.column(0), SLICE_BYTES):
            h, row, _ = _tokens(b.column(0).slice(i, j - i))
            for k in np.unique(fold[i:j]):
                own = np.tile(fold[i:j][row] == k, len(UNITS)) & (h.ravel() != 0)
                who = np.tile(row, len(UNITS))[own]
                # a text counts once for each unit that it holds, however often
                u, inv = np.unique(h.ravel()[own], return_inverse=True)
                once = np.unique(inv * np.int64(j - i) + who)
                inv, who = once // (j - i), once % (j - i)
                c1 = np.bincount(inv, weights=y[i:j][who], minlength=len(u)).astype(np.int64)
                c = np.bincount(inv, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"h": u.view(np.int64), "f": np.full(len(u), k, np.int32), "c0": c - c1, "c1": c1})


def _weigh(h: np.ndarray, m: "Model", table: np.ndarray) -> np.ndarray:
    """Each token's weight: that of its unit with the largest absolute odds. table: weights and absolute odds of the units."""
    w, best = np.full(h.shape[1], DRIFT), np.zeros(h.shape[1])
    if len(m.tokens):
        for x in h:
            at = np.minimum(np.searchsorted(m.tokens, x), len(m.tokens) - 1)
            better = (m.tokens[at] == x) & (table[1][at] > best)
            w[better], best[better] = table[0][at[better]], table[1][at[better]]
        again = np.flatnonzero(h[0][1:] == h[0][:-1]) + 1
        w[again] = np.minimum(w[again], DRIFT)
    return w


def segments(w: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token, end token (both counted in the row) and score of every maximal segment, found from the tokens of positive weight."""
    run = np.cumsum(w)
    at = np.flatnonzero(w > 0)
    start = np.searchsorted(row, np.arange(n_rows))
    out: list[tuple[int, int, int, float]] = []
    heads = np.flatnonzero(np.concatenate([[True], row[at][1:] != row[at][:-1]])) if len(at) else at
    for a, z in zip(heads, np.append(heads[1:], len(at))):
        i = at[a:z]
        r = int(row[i[0]])
        out += [(r, x - int(start[r]), y - int(start[r]), v) for x, y, v in _joined(i, run[i] - w[i], run[i])]
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    r, x, y, v = zip(*out)
    return np.array(r), np.array(x), np.array(y), np.array(v)


def _scan(m: "Model", weights: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Best segment's score, sum of the calibrated scores of significant segments, tokens of each text; the segments."""
    h, row, n = _tokens(texts)
    found = segments(_weigh(h, m, weights), row, len(texts))
    best = np.zeros(len(texts))
    np.maximum.at(best, found[0], found[3])
    x = m.lam * found[3] - np.log(np.maximum(n[found[0]], 1)) - m.log_k
    return best, np.bincount(found[0], weights=np.maximum(x, 0), minlength=len(texts)).astype(float), n, (*found, x)


def _calibration(m: "Model", folds: list[np.ndarray]):
    """Best scores and tokens of labelled texts, each by the weights of the other folds; then the sums."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy()
            for k in range(FOLDS):
                part = b.filter(pa.array(fold == k))
                for i, j in T.slices(part.column(0), SLICE_BYTES):
                    own = part.slice(i, j - i)
                    s, _, n, found = _scan(m, folds[k], own.column(0))
                    order = np.argsort(found[0], kind="stable")
                    off = np.concatenate([[0], np.cumsum(np.bincount(found[0], minlength=j - i))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([own.column(1), pa.array(s), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(found[3][order]))], names=["y", "s", "n", "all"])

    return f


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), g)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _columns(best: np.ndarray, total: np.ndarray, n: np.ndarray, lam: float, log_k: float) -> np.ndarray:
    """The best segment's calibrated score, in two pieces, and the sum over significant segments."""
    x = lam * best - np.log(np.maximum(n, 1)) - log_k
    return np.column_stack([np.ones(len(best)), np.clip(x, -10, 10) / 10, np.clip(x - 10, 0, 40) / 10, np.log1p(total)])


def fit(documents: DataFrame, labels: DataFrame, train: "F.Column | None" = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows that meet ``train`` (a condition on the id column).

    ``max_labelled`` labels at most are broadcast; the driver gets the weights
    of tokens of these texts, 64 bytes each, and their segments' scores.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        lab = lab.where(train)
    lab = lab.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label)).cast("int").alias("__y"))
    lab = lab.withColumn("__r", F.xxhash64("__id")).orderBy("__r", "__id").limit(max_labelled).drop("__r")
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"))
    got = texts.join(F.broadcast(lab), "__id").groupBy(F.xxhash64("__t").alias("__h")).agg(F.first("__t").alias("__t"), F.max("__y").alias("__y"))
    got = durable(got.select("__t", "__y", F.pmod(F.col("__h"), F.lit(FOLDS)).cast("int").alias("__f")), "labelled")
    share = lab.agg(F.avg("__y").alias("m"), F.count("*").alias("n")).first()
    empty = Model(np.zeros(0, np.uint64), np.zeros((2, 0)), 1.0, 0.0, np.zeros(0), float(((share.m or 0) * share.n + 0.5) / (share.n + 1)))
    sums = got.select("__t", F.col("__y").cast("double"), "__f").mapInArrow(_counts, "h long, f int, c0 long, c1 long")
    per = [F.sum(F.when(F.col("f") != k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(FOLDS) for c in ("c0", "c1")]
    sums = durable(sums.groupBy("h").agg(F.sum("c0").alias("c0_a"), F.sum("c1").alias("c1_a"), *per), "counts")
    names = ["a", *map(str, range(FOLDS))]
    tot = sums.agg(*(F.coalesce(F.sum(f"{c}_{k}"), F.lit(0)).alias(f"{c}_{k}") for k in names for c in ("c0", "c1"))).first()
    if any(not tot[f"{c}_{k}"] for k in names for c in ("c0", "c1")):
        return empty
    for k in names:
        n0, n1 = float(tot[f"c0_{k}"]), float(tot[f"c1_{k}"])
        a0, a1 = PRIOR * n0 / (n0 + n1), PRIOR * n1 / (n0 + n1)
        c0, c1 = F.col(f"c0_{k}"), F.col(f"c1_{k}")
        odds = F.log((c1 + a1) / (F.lit(n1 + a1) - c1)) - F.log((c0 + a0) / (F.lit(n0 + a0) - c0))
        sums = sums.withColumn(f"d_{k}", odds).withColumn(f"z_{k}", F.abs(odds) / F.sqrt(1 / (c1 + a1) + 1 / (c0 + a0)))
    top = sums.where(F.greatest(*(f"z_{k}" for k in names)) >= MIN_Z).select("h", F.col("c0_a").alias("c0"), *(f"{x}_{k}" for k in names for x in "dz")).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(h)

    def weights(k: str) -> np.ndarray:
        d, z = top[f"d_{k}"].to_numpy(float)[o], np.maximum(top[f"z_{k}"].to_numpy(float)[o], 1e-9)
        d = np.where(z >= MIN_Z, d * (1 - 2 / np.maximum(z, MIN_Z)), 0.0)
        return np.stack([np.clip(d, -1.0, CLIP) + DRIFT, np.abs(d)])

    m = Model(h[o], weights("a"), 1.0, 0.0, np.zeros(0), empty.prior)
    # units of a word are counted with it: words and their drift alone make up the law of clean tokens
    m.lam = _lambda(top["c0"].to_numpy(float)[o] / float(tot["c0_a"]), m.weights[0])
    cal = got.mapInArrow(_calibration(m, [weights(str(k)) for k in range(FOLDS)]), "y int, s double, n long, all array<double>").toPandas()
    y, s, n = (cal[c].to_numpy(float) for c in ("y", "s", "n"))
    if not 0 < y.sum() < len(y):
        return empty
    clean = (y == 0) & (n > 0)
    m.log_k = float(np.mean(m.lam * s[clean] - np.log(np.maximum(n[clean], 1)))) - 0.5772156649 if clean.any() else 0.0
    total = np.array([np.maximum(m.lam * np.asarray(v, float) - np.log(max(k, 1)) - m.log_k, 0).sum() for v, k in zip(cal["all"], n)])
    m.coef = _logistic(_columns(s, total, n, m.lam, m.log_k), y)
    return m


def _lambda(p0: np.ndarray, w: np.ndarray) -> float:
    """Positive root of sum(p * exp(x * s)) = 1 over clean tokens."""
    rest = max(0.0, 1 - p0.sum())
    f = lambda x: (p0 * np.exp(np.minimum(x * w, 50))).sum() + rest * np.exp(x * DRIFT) - 1
    lo, hi = 1e-4, 1e-4
    while hi < 50 and f(hi) < 0:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return float(hi)


def probability(m: Model, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(m.coef):
        return np.full(len(best), m.prior)
    return 1 / (1 + np.exp(-np.clip(_columns(best, total, n, m.lam, m.log_k) @ m.coef, -30, 30)))


def score(documents: DataFrame, m: Model, text: str = "text", out: str = "score", passages: str | None = None) -> DataFrame:
    """Add the probability that a text is toxic, from the text alone.

    ``passages`` names a column for its significant segments: first token, end
    token and calibrated score (minus the log of the number expected by chance).
    """
    shared = documents.sparkSession.sparkContext.broadcast(m)

    def parts(col: pa.Array) -> Iterator[tuple]:
        for i, j in T.slices(col, SLICE_BYTES):
            best, total, n, found = _scan(shared.value, shared.value.weights, col.slice(i, j - i))
            yield i, probability(shared.value, best, total, n), found

    @F.arrow_udf("double")
    def f(col: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(p for _, p, _ in parts(col))]))

    @F.arrow_udf("struct<p: double, first: array<int>, end: array<int>, x: array<double>>")
    def g(col: pa.Array) -> pa.Array:
        p, spans = [np.zeros(0)], [np.zeros((0, 4))]
        for i, own, (row, first, end, _, x) in parts(col):
            p.append(own)
            spans.append(np.column_stack([row + i, first, end, x])[x > 0])
        at = np.concatenate(spans)  # in the order of rows
        off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at[:, 0].astype(np.int64), minlength=len(col)))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(at[:, k].astype(t))) for k, t in ((1, np.int32), (2, np.int32), (3, np.float64))]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(p)), *lists], names=["p", "first", "end", "x"])

    if passages is None:
        return documents.withColumn(out, f(F.col(text)))
    d = documents.withColumn("__g", g(F.col(text)))
    spans = F.expr("transform(arrays_zip(__g.first, __g.end, __g.x), v -> named_struct('first', v.first, 'end', v.end, 'score', v.x))")
    return d.withColumn(out, F.col("__g.p")).withColumn(passages, spans).drop("__g")


def toxicity(documents: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every document; rows whose crc32 remainder is ``held_out`` don't train."""
    m = fit(documents, labels, crc_mod("doc_id", folds) != held_out, **bounds)
    d = documents.select("doc_id", "text", (crc_mod("doc_id", folds) == held_out).alias("held_out"))
    return score(d, m, passages="passages").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
