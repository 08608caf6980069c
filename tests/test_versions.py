import random

from pyspark.sql import functions as F

from tidemark.operators import levels, manifest, merge, versions, wal


def log(spark, rows):
    return spark.createDataFrame(rows, "user_key string, seq long, vtype int, value string")


def test_latest_revive_and_delete(spark):
    df = log(spark, [("k", 1, 0, "v1"), ("k", 2, 1, ""), ("k", 3, 0, "v2"), ("a", 4, 0, "1"), ("b", 5, 0, "2"), ("b", 6, 1, ""), ("e", 7, 0, "")])
    assert sorted(map(tuple, versions.as_of(df).collect())) == [("a", "1"), ("e", ""), ("k", "v2")]
    assert sorted(map(tuple, versions.as_of(df, 2).collect())) == []
    probes = spark.createDataFrame([("k",), ("b",), ("zz",), ("e",)], "user_key string")
    got = {r.user_key: (r.status, r.value) for r in versions.status(df, probes).collect()}
    assert got == {"k": ("present", "v2"), "b": ("deleted", None), "zz": ("missing", None), "e": ("present", "")}


def test_against_a_dict(spark):
    rng, rows, state, marks = random.Random(42), [], {}, {}
    for seq in range(1, 1501):
        k = f"k{rng.randrange(60):04d}"
        if rng.random() < 1 / 3:
            rows.append((k, seq, 1, ""))
            state.pop(k, None)
        else:
            rows.append((k, seq, 0, f"v{seq}"))
            state[k] = f"v{seq}"
        if seq % 500 == 0:
            marks[seq] = dict(state)
    df = log(spark, rows).cache()
    for seq, want in marks.items():
        assert {r.user_key: r.value for r in versions.as_of(df, seq).collect()} == want
    # what a compaction keeps answers every read at or above the oldest snapshot
    kept = merge.retain(df, 500).cache()
    assert kept.count() < len(rows)
    for seq, want in marks.items():
        assert {r.user_key: r.value for r in versions.as_of(kept, seq).collect()} == want
    probes = df.select("user_key").distinct().withColumn("at", F.explode(F.array(*(F.lit(x).cast("long") for x in (500, 1000, 1500)))))
    for r in versions.lookup(df, probes).collect():
        assert r.value == marks[r["at"]].get(r.user_key)


def test_retention_keeps_what_snapshots_see(spark):
    df = log(spark, [("k", 5, 0, "a"), ("k", 8, 0, "b"), ("k", 9, 1, "")])
    assert sorted(r.seq for r in merge.retain(df, 6).collect()) == [5, 8, 9]
    df = log(spark, [("k", 10, 0, "a"), ("k", 5, 1, ""), ("k", 3, 0, "b")])
    assert [r.seq for r in merge.retain(df, 7).collect()] == [10]
    deeper = spark.createDataFrame([("a", "z")], "smallest string, largest string")
    df = log(spark, [("k", 4, 1, "")])
    assert merge.retain(df, 10, deeper).count() == 1 and merge.retain(df, 10).count() == 0


def test_scores_and_inputs(spark):
    f = lambda rows: spark.createDataFrame(rows, "level int, number long, file_size long, smallest string, largest string")
    r = levels.compaction_score(f([(0, i, 1, "a", "z") for i in range(5)])).first()
    assert (r.level, r.score) == (0, 1.25)
    r = levels.compaction_score(f([(1, 1, 15 << 20, "a", "z")])).first()
    assert (r.level, r.score) == (1, 1.5)
    assert levels.must_stall(f([(0, i, 1, "a", "z") for i in range(12)])).first().stall
    files = f([(1, 1, 1, "a", "c"), (1, 2, 1, "d", "f"), (1, 3, 1, "g", "i")])
    assert [r.number for r in levels.pick_inputs(files, 1, "c").collect()] == [2]
    assert [r.number for r in levels.pick_inputs(files, 1, "z").collect()] == [1]  # wraps around


def test_manifest_and_wal(spark):
    e = spark.createDataFrame(
        [(1, 10, [], [(0, 1), (0, 2)]), (2, None, [(0, 1)], [(1, 3)]), (3, None, [(0, 999)], [])],
        "edit_no long, log_number long, deleted_files array<struct<level:int,number:long>>, new_files array<struct<level:int,number:long>>",
    )
    assert sorted(map(tuple, manifest.live_files(e).collect())) == [(0, 2), (1, 3)]
    assert manifest.scalars(e).first().log_number == 10
    names = spark.createDataFrame([("000123.sst",), ("abc.sst",), ("000123.sst.bak",), ("CURRENT",), ("CURRENT.dbtmp",)], "name string")
    live = spark.createDataFrame([("sst", 5)], "kind string, number long")
    assert sorted(r.name for r in manifest.obsolete(names, live).collect()) == ["000123.sst", "CURRENT.dbtmp"]
    rng = random.Random(1)
    for _ in range(5):
        kinds = [rng.choice([1, 2, 3, 4]) for _ in range(40)]
        want, held = [], None
        for i, k in enumerate(kinds):
            if k == 1:
                want.append(str(i))
                held = None
            elif k == 2:
                held = str(i)
            elif held is not None:
                held += f",{i}"
                if k == 4:
                    want.append(held)
                    held = None
        p = spark.createDataFrame([(i, k, True, f",{i}" if k > 2 else str(i)) for i, k in enumerate(kinds)], "pos long, rtype int, crc_ok boolean, data string")
        assert [r.data for r in wal.assemble(p).orderBy("pos").collect()] == want
