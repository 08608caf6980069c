"""Stages of the corpus pipeline on small tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import near_links, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def near(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)


def test_null_and_repeated_ids_lose_no_clean_documents(spark):
    rng = random.Random(1)
    t = [" ".join(words(rng, 60)) for _ in range(8)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (4, t[2]), (5, t[3]), (5, t[4]), (6, t[5]), (7, t[5]), (8, t[6]), (8, t[6])]
    assert near(spark, rows) == sorted([(None, t[0]), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (6, t[5]), (8, t[6])], key=str)


def test_near_duplicates_of_likeness_0_8_go(spark):
    rng = random.Random(2)
    rows = [(None, None), (1, ""), (2, " \n")]
    for k in range(12):
        w = words(rng, 120)
        a, b = list(w), list(w)
        a[40], a[80] = "xxx", "yyy"  # 10 of 126 shingles in all differ on each side: likeness 106/126
        for i in (20, 45, 70, 95):
            b[i] = "zzz"  # 96/136
        rows += [(10 + 3 * k, " ".join(w)), (11 + 3 * k, " ".join(a)), (12 + 3 * k, " ".join(b))]
    far = [(simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[i + 1][1], 5)).bit_count() for i in range(3, len(rows), 3)]
    assert max(far) > 3
    assert [i for i, _ in near(spark, rows)] == sorted([None, *(10 + 3 * k for k in range(12)), *(12 + 3 * k for k in range(12))], key=str)


def test_groups_of_texts_joined_by_no_centre(spark):
    rng = random.Random(3)
    w = words(rng, 200)
    chain = []
    for k in range(12):  # each is near to the next only
        w = list(w)
        for i in range(3):
            w[(k * 3 + i) * 5 % 200] = f"q{k}x{i}"
        chain.append((k, " ".join(w)))
    assert near(spark, chain) == [chain[0]]


def shingles(text, width=5):
    w = text.lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def shared_passage(rng, n):
    """Texts that have most words in common, some of them enough to be alike, some in chains."""
    common, out = words(rng, 70), []
    for k in range(n):
        if k % 3 and out:
            w = list(rng.choice(out))
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = f"e{k}"
        else:
            w = common + words(rng, rng.randint(12, 60))
        out.append(w)
    return [" ".join(w) for w in out]


def test_groups_by_prefixes_agree_with_all_pairs(spark):
    texts = shared_passage(random.Random(4), 90)
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert 20 < len(first) < len(texts) - 20
    assert [i for i, _ in near(spark, list(enumerate(texts)))] == sorted(first.values(), key=lambda i: str((i, texts[i])))


def test_prefixes_meet_every_pair_that_is_alike(spark):
    texts = [*shared_passage(random.Random(5), 60), "", "one", "one two", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce("t", F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    sets = {r.th: shingles(r.t) for r in rows.collect()}
    nodes = spark.createDataFrame([(h, len(x), h) for h, x in sets.items()], "th long, size long, root long")
    pre = near_links.prefixes(nodes, rows)
    met = {(r.a, r.b) for r in near_links.met_by_prefix(pre, nodes).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and alike(sets[a], sets[b])}
    assert want and want <= met
    assert len(met) < len(sets) * (len(sets) - 1) // 4
    # texts of one component don't meet
    one = nodes.withColumn("root", F.lit(1).cast("long"))
    assert near_links.met_by_prefix(pre, one).count() == near_links.centre_pairs(pre, one).count() == 0
    assert {(r.a, r.b) for r in near_links.centre_pairs(pre, nodes).collect()} <= met
