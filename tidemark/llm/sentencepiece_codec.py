"""SentencePiece encoding and decoding with scores shared along common prefixes.

Texts are marked (a space becomes U+2581, one is put in front) and cut into
words: no piece reaches past the start of a run of marks or past a line break.
Words are cut again where no piece holds both neighbouring characters. What is
distinct among these in a batch is sorted, which makes neighbours share their
longest prefixes, as in a depth-first walk of their trie. The forward table of
a word holds, for each of its prefixes, the best last piece; a word takes over
its predecessor's table for the prefix they share and fills the rest.

A unigram vocabulary is decoded by Viterbi: the best last piece maximises the
sum of scores. A BPE vocabulary (which the public file is) ranks merges rather
than segmentations, so that a maximal sum isn't its encoding. There the best
last piece of a prefix is the one that the merges leave: the only piece whose
join with the piece before it the merges would not undo. Both fill the same
table in the same walk.

Characters outside the vocabulary become byte pieces, or the unknown piece if
there are none. Null and empty texts have no pieces and decode to the empty
text. Decoding returns the text exactly, except that U+2581 itself becomes a
space. Rows are independent: repeated rows give equal results, ids are passed
through, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Words, units and pairs kept from one batch to the next, per worker: at most twice as many of each, some 120 MB in all, until another operator runs.
CACHE = 200_000
SLICE_BYTES = 1 << 20


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], str, bool]:
    """Pieces (text, score, type), kind of vocabulary, whether a mark is put in front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    return [(p.piece, p.score, p.type) for p in m.pieces], {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type], m.normalizer_spec.add_dummy_prefix


class Recent(dict):
    """A dictionary of two generations: once full, the entries not used since the last turn go."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):
        got = self[key] = self.old[key]
        return got

    def lacks(self, keys) -> list:
        return [k for k in keys if k not in self and k not in self.old]

    def turn(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: str, front: bool = True):
        self.kind, self.front = kind, front
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.bytes = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.tails: dict[str, bool] = {}  # every end of a piece, and whether it is a piece itself
        for p in self.ids:
            for i in range(len(p)):
                self.tails.setdefault(p[i:], False)
            self.tails[p] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple[float, str, str] | None] = {}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known, self.done = Recent(), Recent()
        self.id_bytes: dict[str, bytes] = {}
        self.floor = min(self.score, default=0.0) - 10.0

    def merged(self, word: str) -> list[str]:
        """Apply merges by score, the leftmost first among equals, until none is left."""
        sym: list[str | None] = list(word)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(sym) and (p := self.ids.get(sym[i] + sym[j])) is not None:
                heap.append((-self.score[p], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = nxt[i] if sym[i] is not None else len(sym)
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0:
                    n = len(heap)
                    offer(k)
                    if len(heap) > n:
                        heappush(heap, heap.pop())
        return [s for s in sym if s is not None]

    def halves(self, piece: str) -> tuple[float, str, str] | None:
        """Rank of the piece's own merge and the two pieces it joins; rank -1 for a character, None if the merges don't make the piece."""
        got = self.made.get(piece, 0)
        if got == 0:
            if len(piece) < 2:
                got = (-1.0, piece, piece)
            elif piece not in self.ids or self.merged(piece) != [piece]:
                got = None
            else:
                # the last merge joins the only two parts that the merges themselves make and leave side by side
                rank, top = -self.score[self.ids[piece]], self.ids[piece]
                held, self.ids = self.ids, {k: v for k, v in self.parts(piece) if v != top}
                a = self.merged(piece)
                self.ids = held
                got = (rank, a[0], a[1]) if len(a) == 2 else None
            self.made[piece] = got
        return got

    def parts(self, piece: str) -> list[tuple[str, int]]:
        return [(t, self.ids[t]) for i in range(len(piece)) for j in range(i + 2, len(piece) + 1) if (t := piece[i:j]) in self.ids]

    def apart(self, a: str, b: str) -> bool | None:
        """Undo merges from the join outward, the latest first: did any pair that met there join before one of its sides grew on?"""
        x, y = self.halves(a), self.halves(b)
        limit, tie = np.inf, False
        while True:
            if x is None or y is None:
                return None
            i = self.ids.get(a + b)
            if i is not None and (-self.score[i] < limit or (tie and -self.score[i] == limit)):
                return False
            if x[0] < 0 and y[0] < 0:
                return True
            if x[0] > y[0]:
                limit, tie, a = x[0], False, x[2]
                x = self.halves(a)
            else:  # of equal merges the left one comes first
                limit, tie, b = y[0], True, y[1]
                y = self.halves(b)

    def stable(self, a: str, b: str) -> bool:
        """Whether the merges leave the piece ``a`` followed by ``b`` as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            got = self.apart(a, b) if a else None
            if got is None:
                got = self.merged(a + b) == ([a, b] if a else [b])
            self.pairs[a, b] = got
        return got

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return WORDS.findall((MARK if self.front else "") + text.replace(" ", MARK))

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of each of the sorted ``words``."""
        last: list[str] = [""]  # best last piece of each prefix of the word at hand
        total: list[float] = [0.0]
        before = ""
        ids, tails, pairs, bpe = self.ids, self.tails, self.pairs, self.kind == "bpe"
        for w in words:
            k, n = 0, min(len(w), len(before))
            while k < n and w[k] == before[k]:
                k += 1
            del last[k + 1 :], total[k + 1 :]
            for e in range(k + 1, len(w) + 1):
                fit = [w[e - 1]]  # pieces that end here, the shortest first; a character stands for itself
                a = e - 2
                if fit[0] in tails:
                    while a >= 0 and (is_piece := tails.get(w[a:e])) is not None:
                        if is_piece:
                            fit.append(w[a:e])
                        a -= 1
                if bpe:
                    best = None
                    for p in reversed(fit):
                        q = last[e - len(p)]
                        # a whole prefix that is a piece need not be what the merges make of it
                        if (q or len(p) > 1) and not (pairs[q, p] if (q, p) in pairs else self.stable(q, p)):
                            continue
                        best = p
                        break
                    last.append(self.merged(w[:e])[-1] if best is None else best)
                else:
                    top, best = -np.inf, fit[0]
                    for p in fit:
                        i = ids.get(p)
                        s = total[e - len(p)] + (self.floor if i is None else self.score[i])
                        if s > top:
                            top, best = s, p
                    last.append(best)
                    total.append(top)
            before = w
            out, e = [], len(w)
            while e:
                out.append(last[e])
                e -= len(last[e])
            yield w, out[::-1]

    def number(self, piece: str) -> bytes:
        """The ids of one piece as 32-bit integers; a character outside the vocabulary becomes its bytes' pieces."""
        i = self.ids.get(piece)
        if i is not None:
            own = [i]
        elif self.byte:
            own = [self.byte[x] for x in piece.encode()]
        else:
            own = [self.unknown]
        return np.array(own, np.int32).tobytes()

    def units(self, word: str) -> list[str]:
        """The word cut wherever no piece holds both neighbours: nothing ever joins across such a place."""
        out, a, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[a:i])
                a = i
        out.append(word[a:])
        return out

    def _learn(self, words: list[str]) -> None:
        known, ids = self.known, self.id_bytes
        known.turn()
        cut = [self.units(w) for w in words]
        for u, pieces in self.walk(sorted(known.lacks({u for us in cut for u in us}))):
            for p in pieces:
                if p not in ids:
                    if len(ids) > CACHE:
                        ids.clear()
                    ids[p] = self.number(p)
            known[u] = b"".join([ids[p] if p in ids else self.number(p) for p in pieces])
        for w, us in zip(words, cut):
            self.done[w] = known[us[0]] if len(us) == 1 else b"".join([known[u] for u in us])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids."""
        cut = [self.words(t or "") for t in texts]
        self.done.turn()
        self._learn(self.done.lacks({w for ws in cut for w in ws}))
        flat = [b"".join(map(self.done.__getitem__, ws)) for ws in cut]
        return np.frombuffer(b"".join(flat), np.int32), np.array([len(x) // 4 for x in flat], np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def forget(self) -> None:
        """Drop what texts have left behind; the vocabulary stays."""
        self.known, self.done = Recent(), Recent()
        self.pairs.clear(), self.id_bytes.clear()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if self.front and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec for each vocabulary and worker."""
    k = hash(data)
    if k not in _codecs:
        _codecs[k] = Codec(*read_model(data))
    return _codecs[k]


def model_bytes(path: str = MODEL) -> bytes:
    """The vocabulary, read on the driver: half a megabyte for 32,000 pieces."""
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, keep: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """Columns ``keep``, ids (array of int), n_ids and exact: whether decoding returns the text."""
    shared = documents.sparkSession.sparkContext.broadcast(model_bytes(model))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import textnum as T

        codec = _codec(shared.value)
        for b in batches:
            for i, j in T.slices(b.column(0), SLICE_BYTES):
                part = b.slice(i, j - i)
                texts = part.column(0).to_pylist()
                flat, n = codec.encode_batch(texts)
                off = np.concatenate([[0], np.cumsum(n)])
                exact = [codec.decode(flat[x:y].tolist()) == (t or "") for t, x, y in zip(texts, off[:-1], off[1:])]
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, pa.array(n), pa.array(exact)], names=[*part.schema.names[1:], "ids", "n_ids", "exact"])
        if codec.forget not in T.held:  # the next task of this kind goes on with these words
            T.held.append(codec.forget)
        T.trim()

    d = documents.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(f, f"{schema + ', ' if keep else ''}ids array<int>, n_ids long, exact boolean")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of a column of ids; null ids give null."""
    import pandas as pd

    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    @F.pandas_udf("string")
    def f(col: pd.Series) -> pd.Series:
        codec = _codec(shared.value)
        return pd.Series([None if x is None else codec.decode(list(x)) for x in col])

    return encoded.withColumn(out, f(F.col(ids)))
