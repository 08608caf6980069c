"""Each operator against a plain version on small tables with odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, fingerprints, html_extract, line_dedup, lm_scoring, mixing, sentencepiece_codec, simhash, suffix_dedup, textnum, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "one two", "x" * 3000, "日本 語🙂 x"]
    base = words(rng, 300)
    out += [base, base, base[:900] + "Q" + base[901:], words(rng, 50) + "\n" + base[200:700] + "\n" + words(rng, 50)]
    out += [words(rng, rng.randint(5, 200)) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_suffix_dedup(docs, texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    assert len(got) == len(texts)
    for full in (None, 0):
        if full is not None:
            marks = {r.id: r.marks for r in suffix_dedup.repeated(docs, full=full).collect()}
        for i, b in enumerate(raw):
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 199):
                if seen[b[p : p + 200]] > 1:
                    gone[p : p + 200] = True
            if full is None:
                kept = bytes(x for x, g in zip(b, gone) if not g)
                assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())
            else:
                own = np.zeros(len(b), bool)
                for x, y in suffix_dedup.union_spans(marks.get(i, [])) if i in marks else []:
                    own[x:y] = True
                assert (own == gone).all()


def test_suffix_dedup_reads_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 123, 6000).astype(np.uint8)
    raw[3000:3700] = raw[100:800]
    whole = suffix_dedup._segment_rows(200)
    batch = pa.RecordBatch.from_pydict({"t": [raw.tobytes().decode()], "id": [1], "th": [2]})

    def starts():
        return sorted((k, s + i) for b in whole(iter([batch])) for s, c, k in zip(b["start"].to_pylist(), b["count"].to_pylist(), b["key"].to_pylist()) for i in range(c))

    want = starts()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert starts() == want and len(want) == 5801


def test_simhash(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, ["doc_id"], "doc_id").collect()}
    assert all(got[i].fp & (2**64 - 1) == simhash.fingerprint(t) for i, t in enumerate(texts))


def test_links_join_all_within_three_bits(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(100)} | {centre}
    for _ in range(120):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    want = {x: x for x in fps}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                want[max(x, y)] = min(x, y)
    for few in (16, 2):
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, few).collect()]
        assert all(bin(a ^ b).count("1") <= 3 for a, b in got)
        own = {x: x for x in fps}

        def root(x):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in got:
            x, y = root(a), root(b)
            own[max(x, y)] = min(x, y)
        assert {x: root(x) for x in fps} == {x: find(x) for x in fps}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(docs, least):
    """Delete lines of runs of at least ``least`` words that occur earlier."""
    lines = {i: [s.strip(" \t\r\v\f") for s in (t or "").split("\n") if s.strip(" \t\r\v\f")] for i, t in docs}
    first, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for z in range(a + 1, len(lines[i]) + 1):
                run = tuple(lines[i][a:z])
                if sum(len(x.split()) for x in run) >= least:
                    if first.setdefault(run, (i, a)) != (i, a):
                        gone[i] |= set(range(a, z))
    return gone


def test_line_dedup(spark):
    rng = random.Random(9)
    pool = [words(rng, rng.randint(1, 9)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", words(rng, 4)]) for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(99, None), (98, ""), (97, pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("rank", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=8).collect()}
    want = plain_lines(rows, 8)
    for i, t in rows:
        assert got[i]["__gone"] == len(want[i])
        assert got[i].text == (None if t is None else line_dedup._without(t, sorted(want[i]))[0])
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        a, b, c = (plain_sketch(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
        assert abs(got[i].near_edited - fingerprints.jaccard(a, b)) < 1e-9 and abs(got[i].near_next - fingerprints.jaccard(a, c)) < 1e-9
    assert got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1
    assert fingerprints.edited_likeness(docs.where("false")).count() == 0
    assert fingerprints.edited_likeness(docs.where("doc_id = 7")).first().near_next == 1


def plain_sketch(t):
    """Hashes of five-word shingles below the threshold, else the smallest."""
    w = t.encode().lower().split()
    one = lambda x: int(textnum.span_hash(textnum.prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0])
    hs = set()
    for i in range(max(len(w) - 4, min(len(w), 1))):
        h = 0
        for j in range(5):
            h = mix64((h + (one(w[i + j]) if i + j < len(w) else j + 1)) & M64)
        hs.add(h)
    low = sorted(h for h in hs if h < 1 << 62)
    return "".join(f"{h:016x}" for h in low) or "".join(f"+{min(hs):016x}" for _ in hs if hs)[:17]


def test_sketches_merge_and_contain(spark):
    rng = random.Random(7)
    a, b = words(rng, 600), words(rng, 900)
    both = a + " " + b
    sa, sb, sc, sd = (plain_sketch(x) for x in (a, b, both, "one two three"))
    assert abs(fingerprints.containment(sa, sc) - 1) < 0.02 and fingerprints.containment(sa, sb) < 0.05
    assert set(fingerprints._plain(fingerprints.merge(sa, sb))) <= set(fingerprints._plain(sc))
    assert fingerprints.merge("", "") == "" and fingerprints.merge(sd, "") == sd and fingerprints.containment("", sa) == 1
    df = spark.createDataFrame([(1, sa), (1, sb), (1, sa), (2, ""), (2, sd), (3, "")], "g int, fingerprint string")
    got = {r.g: r.fingerprint for r in fingerprints.merged(df, ["g"]).collect()}
    assert got == {1: fingerprints.merge(sa, sb), 2: sd, 3: ""}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.floor(256 * v.astype(np.float32).astype(float)).astype(int)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=32, query_block=2).collect()]
    want = []
    for q in range(0, 200, 50):
        s = sorted((-int(x[q] @ x[c]), c) for c in range(200) if c != q)[:5]
        want += [(q, r + 1, c, -s_) for r, (s_, c) in enumerate(s)]
    assert sorted(got) == sorted(want)
    held, out = {}, []
    for a in range(0, 200, 40):  # the k best so far go along from block to block
        out += topk.threshold_search(np.arange(a, a + 40), x[a : a + 40].astype(float), np.array([0, 50]), x[[0, 50]].astype(float), 5, held=held)
    for q in (0, 50):
        best = sorted((-s, c) for i, c, s in out if i == q)[:5]
        assert [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)] == [w for w in want if w[0] == q]


def test_top_k_sends_queries_in_lots(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (150, 4))
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)] + [(i, [1.0, 2.0]) for i in (200, 205, 207)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 5 == 0, block=8, query_block=4, lot_bytes=300)
    # before, the queries were repeated for every slot of rows and broadcast by the size they had unrepeated
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(q, r + 1, c, -s) for q in range(0, 150, 5) for r, (s, c) in enumerate(sorted((-int(x[q] @ x[c]), c) for c in range(150) if c != q)[:5])}
    want |= {(200, 1, 205, 327680), (200, 2, 207, 327680), (205, 1, 200, 327680), (205, 2, 207, 327680)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = [sum(q.nbytes for _, q in lot) for lot in topk.lots(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 4, 300)]
    assert sum(sizes) == 8 * (150 * 4 + 3 * 2) and max(sizes) <= 300
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_mixing(docs, texts):
    due = mixing.targets([("a", 100), ("b", 1000), (None, 50)])
    assert abs(sum(due.values()) - 1725) < 1e-6 and all(due[s] <= 2 * n + 1e-9 for s, n in (("a", 100), ("b", 1000), (None, 50)))
    a = sorted(map(tuple, mixing.taken(docs).collect()), key=str)
    assert a == sorted(map(tuple, mixing.taken(docs.repartition(5)).collect()), key=str)
    assert all(r[4] <= 2 * r[1] for r in a)
    rng = np.random.default_rng(0)
    p, x = rng.random(500), rng.integers(1, 900, 500).astype(float)
    q = mixing.flight(p, np.column_stack([x, np.ones(500)]), rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ x - p @ x) < 1e-3


@pytest.mark.parametrize("times", [1, 2, 8])
def test_mixing_repeated_rows_meet_their_targets(spark, times):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame([r for r in rows for _ in range(times)], "doc_id long, text string, source string").withColumn("src", F.lit("x")).withColumn("k", F.lit(1))
    got = mixing.taken(df, group=64).collect()
    assert len(got) == 400 * times
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(df.repartition(7), group=64).collect()))
    size, took, due = Counter(), Counter(), {}
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        size[s] += r.size
        took[s] += r.taken
        due[s] = r.target
        assert r.taken <= 2 * r.size
    want = mixing.targets(list(size.items()))
    for s in size:
        assert abs(due[s] - want[s]) < 1e-6
        assert abs(took[s] - due[s]) <= max(0.01 * due[s], 60)
    assert mixing.taken(df.where("false")).count() == 0


def test_sentencepiece(docs, texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = {r.doc_id: r for r in sentencepiece_codec.encode(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t or "") and got[i].exact
    c = sentencepiece_codec.Codec([("<unk>", 0.0, 2), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("ba", -1.0, 1), ("aba", -9.0, 1)], "unigram", front=False)

    def best(w):
        if not w:
            return 0.0, []
        return max(((s + c.score[c.ids[w[:k]]], [w[:k], *r]) for k in range(1, len(w) + 1) if w[:k] in c.ids for s, r in [best(w[k:])]), key=lambda x: x[0])

    ws = sorted({"".join(x) for n in range(1, 6) for x in np.array(np.meshgrid(*[list("ab")] * n)).T.reshape(-1, n)})
    for w, pieces in c.walk(ws):
        assert abs(sum(c.score[c.ids[p]] for p in pieces) - best(w)[0]) < 1e-9


def test_lm_scoring(docs, texts):
    held = lm_scoring.held_out()
    out = lm_scoring.score(docs, ~held, vocabulary=64, table_bytes=1 << 14).select("doc_id", held.alias("h"), "*").collect()
    assert len(out) == len(texts)
    toks = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    train = Counter()
    for r in out:
        if not r.h:
            train.update(toks[r.doc_id])
            train[None] += 1
    n, v = sum(train.values()), len(train)
    m = lm_scoring.fit(docs.where(~held), vocabulary=64, table_bytes=1 << 14)[0]
    for r in out:
        own = [*toks[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(np.log10((train[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert abs(r.score - plain_score(m, toks[r.doc_id])) < 1e-4 * abs(r.score)
    empty = lm_scoring.score(docs.where("false"), ~held)
    assert empty.count() == 0
    none = lm_scoring.score(docs.where("doc_id < 6"), F.lit(False)).collect()
    assert len(none) == 6 and all(r.n_known == 0 and r.score < 0 for r in none)


M64 = (1 << 64) - 1


def mix64(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 32


def plain_score(m, toks):
    """log10 probability of a text, symbol by symbol and bit by bit."""
    v = m.v
    by_key = {int(k): int(s) for k, s in zip(v.keys, v.symbol)}

    def word_hash(w):
        raw = np.frombuffer(w, np.uint8)
        return int(textnum.span_hash(textnum.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])

    def look(table, ctx, node):
        x = (ctx + node * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & M64
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64
        x ^= x >> 29
        at = x >> 64 - ((len(table) - 1).bit_length() - 1)
        return table[at] if table[at, 0] == x & 255 | 1 else table[-1]

    logit = lambda q: 0.0 if q < 64 else (int(q) % 64 - 32) / 4
    hashes = [word_hash(w) for w in toks]
    syms = [by_key.get(h, v.escape) for h in hashes] + [v.end]
    nats, scale, block, grad, bits = 0.0, [1.0] * 5, 0, [0.0] * 5, 0
    one = two = 1
    common, seen = 0, {}
    spelled = []
    for i, s in enumerate(syms):
        k = int(np.log2(i // lm_scoring.BLOCK + 1))
        if k != block:
            scale = [a + max(-0.25, min(0.25, lm_scoring.RATE * g / max(bits, 1) ** 0.5)) for a, g in zip(scale, grad)]
            block, grad, bits = k, [0.0] * 5, 0
        ctx = [mix64(common + 101) >> 22, mix64(one + 7) >> 22, mix64((one * 0x9E3779B97F4A7C15 & M64) + (two ^ 0x5851F42D4C957F2D) & M64) >> 22]
        runs = []
        for t, c in ((m.tables[1], ctx[1]), (m.tables[2], ctx[2])):
            x = int(t[c >> 42 - (len(t).bit_length() - 1)])
            runs.append([x & (1 << 21) - 1, x >> 21 & 7 if x >> 24 == c & 255 else 0])
        runs.append([seen.get(ctx[2], -1), int(ctx[2] in seen)])
        seen[ctx[2]] = s
        node, d = v.words.root, 0
        while node >= 0:
            if d % 4 == 0:
                bucket, nib = look(m.tables[0], ctx[0], node), 1
            q, bit = int(bucket[nib]), int(s >= node)
            gate = (runs[0][1] + 4 * runs[1][1] + 16 * runs[2][1]) * 4 + (q >> 6) + 128 * ((d > 0) + (d > 3))
            f = [float(v.words.own[node]), logit(q)] + [(1 if p >= node else -1) if c else 0 for p, c in runs]
            terms = [a * float(w) * (1 if bit else -1) for a, w in zip(f, m.word_weights[gate])]
            x = sum(a * b for a, b in zip(terms, scale))
            nats += np.log1p(np.exp(-x))
            grad = [g + (1 - 1 / (1 + np.exp(-x))) * a for g, a in zip(grad, terms)]
            runs = [[p, c if (p >= node) == bool(bit) else 0] for p, c in runs]
            node, nib, d, bits = int(v.words.child[2 * node + bit]), 2 * nib + bit, d + 1, bits + 1
        if i < len(toks) and hashes[i] not in by_key:
            spelled.append((toks[i], common))
        two, one = one, hashes[i] if i < len(toks) else 0
        if v.common[s]:
            common = int(v.common[s])
    for w, com in spelled:
        for j in range(len(w) + 1):
            b = [w[j - k] if j >= k else 32 for k in (1, 2, 3)]
            pair = b[0] | b[1] << 8
            run = 0
            for k in range(j):
                run = run + int(textnum.BYTE_VALUE[w[k]]) * pow(textnum.BASE, k, 1 << 64) & M64
            ctx = [mix64(x) >> 22 for x in (pair | b[2] << 16 | 1 << 40, run ^ 0xA0761D6478BD642F, pair | com << 16 | min(j, 3) << 32 | 1 << 41)]
            s = int(v.byte_symbol[w[j] if j < len(w) else 32])
            node, d = v.bytes.root, 0
            while node >= 0:
                if d % 4 == 0:
                    buckets, nib = [look(m.tables[3], c, node) for c in ctx], 1
                q, bit = [int(x[nib]) for x in buckets], int(s >= node)
                gate = (q[0] >> 6) + 4 * (q[1] >> 6) + 16 * (q[2] >> 6)
                x = sum(a * float(u) for a, u in zip([float(v.bytes.own[node]), *map(logit, q)], m.byte_weights[gate])) * (1 if bit else -1)
                nats += np.log1p(np.exp(-x))
                node, nib, d = int(v.bytes.child[2 * node + bit]), 2 * nib + bit, d + 1
    return -nats / np.log(10)


def test_lm_beats_the_unigram_base_on_held_out_texts(spark):
    rng = random.Random(8)
    vocab = [words(rng, 1) + str(i) for i in range(400)]
    after = {w: rng.sample(vocab, 6) for w in vocab}
    rows = []
    for i in range(400):
        w = [rng.choice(vocab)]
        for _ in range(120):
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.9 else rng.choice(vocab))
        rows.append((i, " ".join(w) + f" new{rng.random()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.score(df, ~lm_scoring.held_out()).where(lm_scoring.held_out()).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_weights_come_from_all_training_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, 40) + f" new{i}" for i in range(30)] + [words(rng, 16000), None, ""]
    assert len(texts[30]) > 1 << 16
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cells, real = {}, lm_scoring.fit_weights
    monkeypatch.setattr(lm_scoring, "fit_weights", lambda kind, got: cells.update({kind: got}) or real(kind, got))
    m = lm_scoring.fit(df, vocabulary=64)[0]
    # every bit of every text has been counted; before, a tenth of the texts and 200 at most, none over 64 KB
    t = lm_scoring.read(m.v, pa.array([x or "" for x in texts], pa.large_string()))
    new = ~t.hit | (m.v.count[t.sym[t.at]] <= 1)
    sym = t.sym.copy()
    sym[t.at[new]] = m.v.escape
    assert sum(cells[lm_scoring.WORD]["n"].to_pylist()) == m.v.words.depth[sym].sum()
    assert sum(cells[lm_scoring.SPELL]["n"].to_pylist()) == m.v.bytes.depth[lm_scoring.spelled(m.v, t, new)[0]].sum()
    # a cell's features are those that score, but for steps
    for x in texts[:10]:
        t = lm_scoring.read(m.v, pa.array([x], pa.large_string()))
        own = {k: lm_scoring._own_steps(tree, *s) for k, tree, s in ((0, m.v.words, (8, 31)), (3, m.v.bytes, (4, 15)))}
        b_sym, _, b_ctx = lm_scoring.spelled(m.v, t, ~t.hit)
        w, b = lm_scoring.word_cells(m, t, t.sym, own[0]), lm_scoring.byte_cells(m, b_sym, b_ctx, own[3])
        nats = sum(np.log1p(np.exp(-(lm_scoring.features(k, c.astype(int)) * weights[c >> shift]).sum(1))).sum() for k, c, weights, shift in ((0, w, m.word_weights, 15), (3, b, m.byte_weights, 20)))
        assert abs(nats + plain_score(m, x.encode().lower().split()) * np.log(10)) < 0.03 * nats


def test_lm_refines_factors_only_where_words_follow(docs, texts, monkeypatch):
    m = lm_scoring.fit(docs, vocabulary=64, table_bytes=1 << 14)[0]
    size = [len((t or "").encode().split()) + 1 for t in texts]
    calls, real = [], lm_scoring._block
    monkeypatch.setattr(lm_scoring, "_block", lambda *x: calls.append((len(x[1]), x[-1])) or real(*x))
    lm_scoring.log2_probability(m, pa.array(texts, pa.large_string()))
    # a text's last block (of 64, 128, ... tokens) refines nothing; before, every block did
    ahead = [lm_scoring.BLOCK * (2 ** int(np.log2((n - 1) // lm_scoring.BLOCK + 1)) - 1) for n in size]
    assert max(ahead) > 0 and sum(n for n, refine in calls if refine is True) == sum(ahead)
    assert sum(n for n, refine in calls if refine is False) == sum(size) - sum(ahead)


def test_lm_visits_and_lookup_equal_plain_walks():
    rng = np.random.default_rng(5)
    t = lm_scoring.tree(np.sort(rng.integers(1, 1000, 300))[::-1])
    keys = np.unique(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(22) | rng.integers(0, 300, 3000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    plain = {}
    for key, n in zip(keys, counts):
        sym, node, d = int(key) & (1 << 22) - 1, t.root, 0
        while node >= 0:
            if d % 4 == 0:
                own, nib = int(lm_scoring.bucket(key[None] >> np.uint64(22), np.array([node]))[0]), 1
            bit = int(sym >= node)
            plain[own, nib, bit] = plain.get((own, nib, bit), 0) + n
            node, nib, d = int(t.child[2 * node + bit]), 2 * nib + bit, d + 1
    for lot in (1 << 18, 100):  # buckets in one lot, and over several
        u, c0, c1 = lm_scoring._visits(t, keys, counts, lot)
        assert (np.diff(u.astype(float)) > 0).all() and c0.sum() + c1.sum() == sum(plain.values())
        assert all((c0, c1)[bit][np.searchsorted(u, np.uint64(own)), nib] == n for (own, nib, bit), n in plain.items())
    for n in (1, 2, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) >> np.uint64(rng.integers(0, 3)))
        v = lm_scoring.make_vocabulary(h[::-1], np.arange(len(h), 0, -1), 1, 0, 0, len(h), np.zeros(256, np.int64))
        at, hit = v.find(np.concatenate([h, h + np.uint64(1), np.array([0, M64], np.uint64)]))
        assert hit[: len(h)].all() and (at[: len(h)] == np.arange(len(h))).all()
        assert (hit == np.isin(np.concatenate([h, h + np.uint64(1), np.array([0, M64], np.uint64)]), h)).all()


def test_lm_tree_and_tables():
    rng = np.random.default_rng(3)
    t = lm_scoring.tree(np.sort(rng.integers(1, 1000, 77))[::-1])
    assert abs(sum(2.0 ** -t.depth.astype(float)) - 1) < 1e-9 and sorted(x for x in t.child if x >= 0) + [t.root] != []
    assert lm_scoring.tree(np.array([5])).root == -1
    keys = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    k, c = lm_scoring._unpack(lm_scoring._pack(keys, np.arange(50)))
    assert (k == keys).all() and (c == np.arange(50)).all()
    key = lambda c, s: np.uint64(c << 22 | s)
    keys, counts = np.array([key(1, 5), key(1, 6), key(2, 4), key(3, 7), key(4, 1), key(4, 2)], np.uint64), np.array([3, 1, 1, 2, 1, 1])
    ctx, packed, total = lm_scoring._successors(keys, counts)
    assert ctx.tolist() == [1, 3] and total.tolist() == [4, 2] and [int(x) & (1 << 21) - 1 for x in packed] == [5, 7] and [int(x) >> 21 & 7 for x in packed] == [1, 2]


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = words(rng, 60).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zzrude")
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, int(bad)))
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, None), (7, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert got[1000].score == got[1001].score
    none = toxicity.toxicity(d, lab.where("false")).collect()
    assert len(none) == 602
    assert all(r.predicted == 0 or r.passages for r in held)


def test_toxicity_ties_of_equal_texts_and_empty_tables(spark):
    rows = [(i, "fine words here" if i % 2 else "zz bad words", "en", "a", 0) for i in range(60)]
    labels = [(i, int(i % 2 == 0)) for i in range(60)] + [(1, 1), (None, 1)]
    d, lab = spark.createDataFrame(rows, DOCS).withColumn("__t", F.lit(1)).withColumn("score", F.lit(2)), spark.createDataFrame(labels, "doc_id long, toxic int")
    a = sorted((r.doc_id, r.score) for r in toxicity.toxicity(d, lab).collect())
    assert a == sorted((r.doc_id, r.score) for r in toxicity.toxicity(d.repartition(5), lab.repartition(3)).collect())
    assert len({s for i, s in a if i % 2}) == 1
    assert toxicity.toxicity(d.where("false"), lab).count() == 0


def plain_segments(w):
    """Maximal segments by definition: the best segment, then those of what is left on both sides."""
    best = max(((sum(w[a:b]), -a, -b) for a in range(len(w)) for b in range(a + 1, len(w) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[1], -best[2]
    return [*plain_segments(w[:a]), (a, b, best[0]), *((x + b, y + b, v) for x, y, v in plain_segments(w[b:]))]


def test_maximal_segments():
    assert toxicity.maximal_segments(np.array([1, -2, 3, 1, -1, 4, -9, 2.0]), 2) == [(2, 6, 7.0), (7, 8, 2.0)]
    rng = np.random.default_rng(2)
    for _ in range(60):
        parts = [rng.normal(size=rng.integers(0, 12)).round(3) - 0.1 for _ in range(4)]
        row = np.repeat(np.arange(4), [len(p) for p in parts])
        got = toxicity.segments(np.concatenate(parts), row, 4)
        want = [(r, a, b, v) for r, p in enumerate(parts) for a, b, v in plain_segments(list(p))]
        assert [x[:3] for x in want] == list(zip(*(c.tolist() for c in got[:3]))) and np.allclose(got[3], [x[3] for x in want])


def test_html():
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>First  text<br>goes on.<p>Second one here.</article><div class='comments'><p>I disagree strongly.</p></div><footer>&copy; x</footer>"
    assert html_extract.extract(page) == "Head & line\n\nFirst text goes on.\n\nSecond one here."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    prose = "This is a long paragraph, with commas, and it goes on for a while so that it is clearly prose of the page, as all would say."
    menu = "<ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul>"
    bare = f"<body>{menu}<div><p>{prose}</p>and so it went on<p>{prose}</p><p>Short.</p></div><div id=comments><p>{prose}</p></div>{menu}</body>"
    assert html_extract.extract(bare) == f"{prose}\n\nand so it went on\n\n{prose}\n\nShort."
    found = html_extract.blocks(bare)
    assert html_extract.label(found) != [a > b for a, b in html_extract.costs(found)]  # the cut decides
    odd = f"<article><h1>Head</h1><p>{prose}</p><div class='notice'>We use cookies.</div><p>More, {prose}</p><aside>{prose}</aside><form>Your mail <input></form><div class=ad>Buy now, today.</div><section id='comments'><p>{prose}</p></section></article><p>{prose} Outside.</p>"
    assert html_extract.extract(odd) == f"Head\n\n{prose}\n\nMore, {prose}"
    assert html_extract.extract("<p>" * 3000 + prose) == prose and html_extract.extract("<div" * 50 + "<") is not None


def test_html_pages(spark):
    rng = random.Random(12)
    long = lambda: ", ".join(words(rng, 8) for _ in range(3)).capitalize() + "."
    rows, want = [], {}
    for i in range(60):
        ps = [long() for _ in range(rng.randint(1, 5))] + ["Hm."]
        tag = "article" if i % 2 else "div"  # every other page doesn't name its article
        rows.append((i, None, f"<nav><a href=x>{words(rng, 2)}</a></nav><div class=ad>{long()}</div><{tag}>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{tag}><footer>{words(rng, 3)}</footer>"))
        want[i] = "\n\n".join(ps)
    rows += [(None, "u", None), (100, "u", ""), (100, "u", ""), (101, "u", rows[1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 64 and all(r.text == want[r.page_id] for r in got if r.page_id is not None and r.page_id < 100)
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 100] == ["", ""]
    assert html_extract.extract_pages(df.where("false")).count() == 0


def test_min_cut():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(1, 7)
        good, bad = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(n)]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda m: sum(b if m >> i & 1 else g for i, (g, b) in enumerate(zip(good, bad))) + sum(c for a, b, c in edges if (m >> a ^ m >> b) & 1)  # noqa: E731, B023
        cut = html_extract.min_cut(good, bad, edges)
        assert abs(cost(sum(k << i for i, k in enumerate(cut))) - min(map(cost, range(2**n)))) < 1e-6
