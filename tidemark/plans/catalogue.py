"""Named queries over the test tables and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bloom, encoding, levels, manifest, merge, versions, wal
from ..schema import Options
from ..sources import workload as src
from ..sources.store import Engine
from ..streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT printf('u%04d', user_id) AS user_key, event_id + 1 AS seq,
    CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS TINYINT) AS vtype,
    CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events)"""
HALF = "(SELECT (max(event_id) + 1) // 2 FROM events)"
FILES = """files AS (SELECT level, level * 100000 + part AS number, CAST(sum(strlen(user_key) + strlen(value)) * 1000 AS BIGINT) AS file_size,
    min(user_key) AS smallest, max(user_key) AS largest
    FROM (SELECT CAST(seq % 4 AS INTEGER) AS level, CAST(substr(user_key, 2) AS BIGINT) // (CASE WHEN seq % 4 = 0 THEN 60 ELSE 25 END) AS part, user_key, value FROM log) GROUP BY level, part)"""
EDITS = """edits AS (SELECT (seq - 1) // 1000 AS edit_no, max(seq) AS last_sequence, max(user_key) AS top, (seq - 1) // 1000 % 4 = 3 AS every FROM log GROUP BY ALL)"""


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def kv_latest(spark, d):
    return versions.as_of(src.events_log(spark, d))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log WHERE seq <= {HALF}) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def kv_as_of(spark, d):
    return versions.as_of(src.events_log(spark, d, src.last_seq(spark, d) // 2))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0 AND user_key = 'u0042'")
def kv_get(spark, d):
    return versions.get(src.events_log(spark, d), "u0042")


@query(f"WITH {LOG} SELECT user_key, seq, vtype, value, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS depth FROM log")
def kv_version_history(spark, d):
    return versions.history(src.events_log(spark, d))


def _probes(log: DataFrame) -> DataFrame:
    keys = log.select("user_key").distinct()
    return keys.unionByName(keys.select(F.concat(F.lit("x"), "user_key").alias("user_key")))


PROBES = "probes AS (SELECT DISTINCT user_key FROM log UNION ALL SELECT DISTINCT 'x' || user_key FROM log)"


@query(
    f"""WITH {LOG}, {PROBES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log)
    SELECT p.user_key, CASE WHEN vtype IS NULL THEN 'missing' WHEN vtype = 1 THEN 'deleted' ELSE 'present' END AS status, CASE WHEN vtype = 0 THEN value END AS value
    FROM probes p LEFT JOIN r ON p.user_key = r.user_key AND n = 1"""
)
def kv_tristate_get(spark, d):
    log = src.events_log(spark, d)
    return versions.status(log, _probes(log))


@query(
    f"""WITH {LOG}, {PROBES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log)
    SELECT p.user_key, CASE WHEN vtype = 0 THEN value END AS value FROM probes p LEFT JOIN r ON p.user_key = r.user_key AND n = 1"""
)
def kv_multi_get(spark, d):
    log = src.events_log(spark, d)
    return versions.multi_get(log, _probes(log))


@query(
    f"""WITH {LOG}, m AS (SELECT max(event_id) + 1 AS n FROM events), p AS (SELECT user_key, n * k // 10 AS "at" FROM (SELECT DISTINCT user_key FROM log), m, (VALUES (1), (5), (9)) t(k)),
    j AS (SELECT p.user_key, p."at", l.seq, l.vtype, l.value FROM p ASOF LEFT JOIN log l ON p.user_key = l.user_key AND p."at" >= l.seq)
    SELECT user_key, "at", CASE WHEN vtype = 0 THEN seq END AS seq, CASE WHEN vtype = 0 THEN value END AS value FROM j"""
)
def kv_snapshot_lookup(spark, d):
    log, n = src.events_log(spark, d), src.last_seq(spark, d)
    at = F.explode(F.array(*(F.lit(n * k // 10).cast("long") for k in (1, 5, 9))))
    return versions.lookup(log, log.select("user_key").distinct().withColumn("at", at))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0 ORDER BY user_key LIMIT 100")
def kv_ordered_scan_page(spark, d):
    return versions.scan(src.events_log(spark, d), limit=100)


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def kv_full_scan(spark, d):
    return versions.scan(src.events_log(spark, d))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log WHERE user_key BETWEEN 'u0010' AND 'u0050') SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def kv_range_scan(spark, d):
    return versions.scan(src.events_log(spark, d), low="u0010", high="u0050")


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log WHERE starts_with(user_key, 'u00')) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def kv_prefix_scan(spark, d):
    return versions.scan(src.events_log(spark, d), prefix="u00")


@query(f"WITH {LOG}, t AS (SELECT DISTINCT user_key || 'a' AS target FROM log) SELECT target, (SELECT min(user_key) FROM log WHERE user_key >= target) AS user_key FROM t")
def kv_lower_bound(spark, d):
    keys = src.events_log(spark, d).select("user_key")
    return versions.lower_bound(keys, keys.select(F.concat("user_key", F.lit("a")).alias("target")))


@query(f"WITH {LOG} SELECT user_key, seq, vtype, (seq - 1) // 1000 AS run_no FROM log")
def kv_merge_runs(spark, d):
    runs = levels.assign_runs(src.events_log(spark, d)).select("user_key", "seq", "vtype", "run_no")
    return merge.merge(runs.where("run_no % 2 = 0"), runs.where("run_no % 2 = 1"))


FATE = f"""a AS (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM log),
    f AS (SELECT *, CASE WHEN coalesce(newer <= {HALF}, false) THEN 'superseded' WHEN vtype = 1 AND seq <= {HALF} THEN 'tombstone' ELSE 'kept' END AS fate FROM a)"""


@query(f"WITH {LOG}, {FATE} SELECT user_key, seq, vtype, value FROM f WHERE fate = 'kept'")
def kv_retention(spark, d):
    return merge.retain(src.events_log(spark, d), src.last_seq(spark, d) // 2)


@query(
    f"""WITH {LOG}, {FILES}, a AS (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM log)
    SELECT user_key, seq, vtype, value FROM a WHERE NOT (coalesce(newer <= {HALF}, false) OR (vtype = 1 AND seq <= {HALF}
      AND NOT EXISTS (SELECT 1 FROM files WHERE level >= 2 AND number % 3 = 0 AND a.user_key BETWEEN smallest AND largest)))"""
)
def kv_retention_base_level(spark, d):
    log = src.events_log(spark, d)
    return merge.retain(log, src.last_seq(spark, d) // 2, src.files(log).where("level >= 2 and number % 3 = 0"))


@query(f"WITH {LOG}, {FATE} SELECT user_key, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'superseded') AS superseded, count(*) FILTER (fate = 'tombstone') AS tombstones FROM f GROUP BY user_key")
def kv_gc_stats(spark, d):
    return merge.gc_stats(src.events_log(spark, d), src.last_seq(spark, d) // 2)


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER w AS n, lead(vtype) OVER w AS below FROM log WINDOW w AS (PARTITION BY user_key ORDER BY seq DESC)) SELECT user_key, seq FROM r WHERE n = 1 AND vtype = 0 AND below = 1")
def kv_delete_revive(spark, d):
    return merge.revived(src.events_log(spark, d))


@query("SELECT coalesce(min(event_id * 10), 9223372036854775807) AS oldest FROM events WHERE user_id >= 0")
def snap_oldest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id >= 0")
    return levels.oldest_snapshot(e.select(F.col("event_id").alias("handle_id"), (F.col("event_id") * 10).alias("seq")))


@query(f"WITH {LOG} SELECT count(*) AS entries, CAST(sum(strlen(user_key) + strlen(value)) AS BIGINT) AS bytes, max(seq) AS last_seq FROM log")
def mem_stats(spark, d):
    return levels.memtable_stats(src.events_log(spark, d))


@query(
    f"""WITH {LOG}, r AS (SELECT *, (seq - 1) // 1000 AS run_no FROM log), b AS (SELECT run_no, count(*) AS entries, min(user_key) AS smallest, max(user_key) AS largest FROM r GROUP BY run_no)
    SELECT b.run_no, entries, smallest, (SELECT max(seq) FROM r WHERE r.run_no = b.run_no AND user_key = smallest) AS smallest_seq, largest, (SELECT min(seq) FROM r WHERE r.run_no = b.run_no AND user_key = largest) AS largest_seq FROM b"""
)
def flush_runs(spark, d):
    return levels.run_bounds(levels.assign_runs(src.events_log(spark, d)))


@query(
    f"""WITH {LOG}, {FILES} SELECT CAST(l.i AS INTEGER) AS level, count(number) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, CAST(10485760 * pow(10, greatest(l.i - 1, 0)) AS BIGINT) AS byte_limit
    FROM range(7) l(i) LEFT JOIN files ON level = l.i GROUP BY l.i"""
)
def level_stats(spark, d):
    return levels.level_stats(spark, src.files(src.events_log(spark, d)))


@query(
    f"""WITH {LOG}, {FILES} SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE CAST(sum(file_size) AS DOUBLE) / (10485760 * pow(10, greatest(level - 1, 0))) END AS score FROM files GROUP BY level ORDER BY score DESC, level LIMIT 1"""
)
def compaction_score(spark, d):
    return levels.compaction_score(src.files(src.events_log(spark, d)))


@query(f"WITH {LOG}, {FILES} SELECT count(*) FILTER (level = 0) AS l0_files, count(*) FILTER (level = 0) >= 12 AS stall FROM files")
def write_stall(spark, d):
    return levels.must_stall(src.files(src.events_log(spark, d)))


@query(f"WITH {LOG}, {FILES} SELECT k.user_key, level, number FROM (SELECT DISTINCT user_key FROM log) k JOIN files ON k.user_key BETWEEN smallest AND largest")
def file_for_key(spark, d):
    log = src.events_log(spark, d)
    return levels.file_for_key(src.files(log), log.select("user_key").distinct())


@query(f"WITH {LOG}, {FILES} SELECT a.number, b.number AS other FROM files a JOIN files b ON a.level = 1 AND b.level = 2 AND a.largest >= b.smallest AND a.smallest <= b.largest")
def file_overlaps(spark, d):
    f = src.files(src.events_log(spark, d))
    return levels.overlaps(f.where("level = 1"), f.where("level = 2"))


@query(
    f"""WITH {LOG}, {FILES}, i AS (SELECT * FROM files WHERE level = 1 ORDER BY CASE WHEN largest > 'u0030' THEN 0 ELSE 1 END, smallest, number LIMIT 1),
    e1 AS (SELECT min(smallest) lo, max(largest) hi FROM i), n AS (SELECT files.* FROM files, e1 WHERE level = 2 AND largest >= lo AND smallest <= hi),
    e2 AS (SELECT min(smallest) lo, max(largest) hi FROM (SELECT * FROM i UNION ALL SELECT * FROM n)), g AS (SELECT files.* FROM files, e2 WHERE level = 3 AND largest >= lo AND smallest <= hi)
    SELECT 'input' AS role, level, number, file_size FROM i UNION ALL SELECT 'next', level, number, file_size FROM n UNION ALL SELECT 'grandparent', level, number, file_size FROM g"""
)
def pick_inputs(spark, d):
    return levels.pick_inputs(src.files(src.events_log(spark, d)), 1, "u0030")


@query(
    f"""WITH {LOG}, {FILES} SELECT a.number, CAST(coalesce(sum(b.file_size), 0) AS BIGINT) AS bytes FROM files a LEFT JOIN files b ON b.level = 3 AND a.largest >= b.smallest AND a.smallest <= b.largest WHERE a.level = 1 GROUP BY a.number"""
)
def grandparent_bytes(spark, d):
    return levels.grandparent_bytes(src.files(src.events_log(spark, d)), 1)


LIVE = """adds AS (SELECT edit_no, 0 AS level, edit_no AS number FROM edits UNION ALL SELECT edit_no, 1, edit_no + 10000 FROM edits WHERE every),
    dels AS (SELECT edit_no, 0 AS level, edit_no - i AS number FROM edits, range(1, 5) r(i) WHERE every),
    live AS (SELECT CAST(level AS INTEGER) AS level, number FROM adds a WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.level = a.level AND d.number = a.number AND d.edit_no > a.edit_no))"""


@query(f"WITH {LOG}, {EDITS}, {LIVE} SELECT level, number FROM live")
def manifest_live_files(spark, d):
    return manifest.live_files(src.edits(src.events_log(spark, d)))


@query(
    f"""WITH {LOG}, {EDITS} SELECT coalesce(arg_max(edit_no + 2, edit_no) FILTER (edit_no % 3 = 0), 0) AS log_number, arg_max(edit_no + 3, edit_no) AS next_file_number, arg_max(last_sequence, edit_no) AS last_sequence FROM edits"""
)
def manifest_scalars(spark, d):
    return manifest.scalars(src.edits(src.events_log(spark, d)))


@query(f"WITH {LOG}, {EDITS} SELECT CAST(edit_no % 3 AS INTEGER) AS level, arg_max(top, edit_no) AS user_key FROM edits WHERE every GROUP BY 1")
def compact_pointers(spark, d):
    return manifest.compact_pointers(src.edits(src.events_log(spark, d)))


NAMES = "CASE event_id % 5 WHEN 0 THEN printf('%06d.log', event_id) WHEN 1 THEN printf('%06d.sst', event_id) WHEN 2 THEN printf('MANIFEST-%06d', event_id) WHEN 3 THEN 'notes-' || event_id ELSE printf('%06d.sst.bak', event_id) END"


@query(
    f"""WITH {LOG}, {EDITS}, {LIVE}, l AS (SELECT {NAMES} AS name, event_id AS n, event_id % 5 AS k FROM events UNION ALL SELECT 'CURRENT.dbtmp', 0, 9 UNION ALL SELECT 'CURRENT', 0, 8)
    SELECT name FROM l WHERE (k = 1 AND n NOT IN (SELECT number FROM live)) OR (k = 0 AND n <> 5) OR (k = 2 AND n <> 7) OR k = 9"""
)
def obsolete_files(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id")
    name = F.when(n % 5 == 0, manifest.file_name("log", n)).when(n % 5 == 1, manifest.file_name("sst", n)).when(n % 5 == 2, manifest.file_name("manifest", n)).when(n % 5 == 3, F.concat(F.lit("notes-"), n.cast("string"))).otherwise(F.concat(manifest.file_name("sst", n), F.lit(".bak")))
    listing = e.select(name.alias("name")).unionByName(spark.createDataFrame([("CURRENT.dbtmp",), ("CURRENT",)], "name string"))
    live = manifest.live_files(src.edits(src.events_log(spark, d))).select(F.lit("sst").alias("kind"), "number").unionByName(spark.createDataFrame([("log", 5), ("manifest", 7)], "kind string, number long"))
    return manifest.obsolete(listing, live)


PIECES = """m AS (SELECT (max(event_id) + 1) * 97 // 100 AS bad FROM events),
    pieces AS (SELECT event_id AS pos, CAST(CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 7 = 1 THEN 3 WHEN event_id % 7 = 2 THEN 4 WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS TINYINT) AS rtype, event_type AS data FROM events),
    ok AS (SELECT * FROM pieces WHERE pos < (SELECT bad FROM m))"""


@query(f"WITH {PIECES} SELECT pos, rtype, data FROM ok")
def wal_valid_prefix(spark, d):
    return wal.valid_prefix(src.wal_pieces(spark, d)).select("pos", "rtype", "data")


@query(
    f"""WITH {PIECES}, g AS (SELECT *, max(CASE WHEN rtype <= 2 THEN pos END) OVER (ORDER BY pos) AS grp FROM ok),
    h AS (SELECT *, first(rtype) OVER (PARTITION BY grp ORDER BY pos) AS lead, count(*) FILTER (rtype = 4) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM g WHERE grp IS NOT NULL)
    SELECT grp AS pos, string_agg(data, '' ORDER BY h.pos) AS data FROM h WHERE rtype = 1 OR (lead = 2 AND done = 0 AND rtype > 1) GROUP BY grp HAVING bool_or(rtype IN (1, 4))"""
)
def wal_assemble(spark, d):
    return wal.assemble(wal.valid_prefix(src.wal_pieces(spark, d)))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND vtype = 0")
def wal_replay(spark, d):
    log, n = src.events_log(spark, d), src.last_seq(spark, d)
    return versions.as_of(wal.replay(log.where(F.col("seq") <= n * 9 // 10), log.where(F.col("seq") > n * 8 // 10)))


@query(
    """WITH r AS (SELECT o_orderkey AS record, (o_orderkey * 7919) % 200000 AS length FROM orders), n AS (SELECT *, greatest(CAST(ceil(length / 32761.0) AS BIGINT), 1) AS n FROM r)
    SELECT record, i AS piece, CAST(CASE WHEN n = 1 THEN 1 WHEN i = 1 THEN 2 WHEN i = n THEN 4 ELSE 3 END AS TINYINT) AS rtype, CAST(CASE WHEN i < n THEN 32761 ELSE length - (n - 1) * 32761 END AS BIGINT) AS length
    FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS i)"""
)
def wal_split(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return wal.split_record(o.select(F.col("o_orderkey").alias("record"), (F.col("o_orderkey") * 7919 % 200000).alias("length")))



@query(
    f"""WITH {LOG}, k AS (SELECT DISTINCT user_key FROM log), b AS (SELECT greatest(64, count(*) * 10) AS want FROM k WHERE substr(user_key, 5, 1) < '5'), s AS (SELECT CAST((want + 7) // 8 * 8 AS BIGINT) AS bits FROM b),
    h0 AS (SELECT user_key, list_reduce(list_prepend(CAST(length(user_key) AS HUGEINT), list_transform(range(1, length(user_key) + 1), lambda i: CAST(ascii(substr(user_key, i, 1)) AS HUGEINT))), lambda h, c: xor((h * 103264) & 4294967295, c)) AS h FROM k),
    h AS (SELECT user_key, CAST((h * 2654435761) & 4294967295 AS BIGINT) AS h FROM h0),
    p AS (SELECT user_key, ((h + i * greatest(1, h >> 17)) & 4294967295) % bits AS bit FROM h, s, range(7) r(i)),
    f AS (SELECT DISTINCT bit FROM p WHERE substr(user_key, 5, 1) < '5')
    SELECT user_key, bool_and(bit IN (SELECT bit FROM f)) AS maybe FROM p GROUP BY user_key"""
)
def bloom_probe(spark, d):
    keys = src.events_log(spark, d).select("user_key").distinct()
    half = keys.where(F.substring("user_key", 5, 1) < "5")
    bits, k = bloom.shape(half.count(), 10)
    return bloom.probe(bloom.build(half, bits, k), keys, bits, k)


@query("SELECT user_id AS file_number, max(event_id) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC LIMIT 100")
def lru_contents(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return levels.lru_contents(e.select(F.col("event_id").alias("access_no"), F.col("user_id").alias("file_number")), 100)


@query(
    f"""WITH {LOG}, r AS (SELECT (seq - 1) // 1000 AS run_no, user_key, seq FROM log), w AS (SELECT *, lag(user_key) OVER o AS b, row_number() OVER o - 1 AS i FROM r WINDOW o AS (PARTITION BY run_no ORDER BY user_key, seq DESC))
    SELECT run_no, user_key, seq, i % 16 = 0 AS restart, CASE WHEN i % 16 = 0 THEN 0 ELSE CAST(len(list_filter(range(1, 6), lambda n: substr(user_key, 1, n) = substr(b, 1, n))) AS BIGINT) END AS shared FROM w"""
)
def key_shared_prefix(spark, d):
    return encoding.key_prefixes(levels.assign_runs(src.events_log(spark, d)))


@query("SELECT event_id, CAST(CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 WHEN x < 268435456 THEN 4 WHEN x < 34359738368 THEN 5 ELSE 6 END AS BIGINT) AS bytes FROM (SELECT event_id, event_id * event_id AS x FROM events)")
def varint_len(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", encoding.varint_length(F.col("event_id") * F.col("event_id")).alias("bytes"))


#: A greedy scan in SQL: entry after entry, a new part once the one before is full and, for whole keys, the key changes.
GREEDY = """c AS (SELECT g, i, user_key, bytes AS size, CAST(0 AS BIGINT) AS part FROM e WHERE i = 1
    UNION ALL SELECT e.g, e.i, e.user_key, CASE WHEN c.size >= {limit} {whole} THEN 0 ELSE c.size END + e.bytes, c.part + CASE WHEN c.size >= {limit} {whole} THEN 1 ELSE 0 END
    FROM c JOIN e ON e.g = c.g AND e.i = c.i + 1)"""
ENTRY = "strlen(user_key) + strlen(value) + 12 AS bytes, row_number() OVER (PARTITION BY {g} ORDER BY user_key, seq DESC) AS i"


@query(
    f"""WITH RECURSIVE {LOG}, e AS MATERIALIZED (SELECT (seq - 1) // 1000 AS g, user_key, {ENTRY.format(g="(seq - 1) // 1000")} FROM log), {GREEDY.format(limit=4096, whole="")}
    SELECT g AS run_no, part, count(*) AS entries, max(user_key) AS separator FROM c GROUP BY g, part"""
)
def block_cut(spark, d):
    runs = levels.assign_runs(src.events_log(spark, d))
    e = runs.select("run_no", "user_key", "seq", (F.length("user_key") + F.length("value") + 12).alias("bytes"))
    return encoding.cut(e, "run_no", ["user_key", ("seq", False)]).groupBy("run_no", "part").agg(F.count("*").alias("entries"), F.max("user_key").alias("separator"))


def _jobs(spark, d):
    """The log's entries by compaction: ranges of ten users."""
    log = src.events_log(spark, d)
    return log.select(F.substring("user_key", 1, 4).alias("job"), "user_key", "seq", (F.length("user_key") + F.length("value") + 12).alias("bytes"))


@query(
    f"""WITH RECURSIVE {LOG}, e AS MATERIALIZED (SELECT substr(user_key, 1, 4) AS g, user_key, {ENTRY.format(g="substr(user_key, 1, 4)")} FROM log), {GREEDY.format(limit=8192, whole="AND e.user_key <> c.user_key")}
    SELECT g AS job, part, count(*) AS entries, min(user_key) AS smallest, max(user_key) AS largest FROM c GROUP BY g, part"""
)
def output_split(spark, d):
    out = encoding.cut_outputs(_jobs(spark, d), "job", 8 * 1024)
    return out.groupBy("job", "part").agg(F.count("*").alias("entries"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"))


@query(
    f"""WITH RECURSIVE {LOG}, k AS MATERIALIZED (SELECT substr(user_key, 1, 4) AS g, user_key, count(*) AS entries, sum(strlen(user_key) + strlen(value) + 12) AS bytes, 1000 * (CAST(substr(user_key, 2) AS BIGINT) % 3) AS fresh, row_number() OVER (PARTITION BY substr(user_key, 1, 4) ORDER BY user_key) AS i FROM log GROUP BY user_key),
    c AS (SELECT g, i, user_key, entries, bytes AS size, CAST(0 AS BIGINT) AS met, CAST(0 AS BIGINT) AS part FROM k WHERE i = 1
    UNION ALL SELECT k.g, k.i, k.user_key, k.entries, CASE WHEN c.size >= 16384 OR c.met + k.fresh > 2500 THEN 0 ELSE c.size END + k.bytes,
    CASE WHEN c.size >= 16384 OR c.met + k.fresh > 2500 THEN 0 ELSE c.met + k.fresh END, c.part + CASE WHEN c.size >= 16384 OR c.met + k.fresh > 2500 THEN 1 ELSE 0 END
    FROM c JOIN k ON k.g = c.g AND k.i = c.i + 1)
    SELECT g AS job, part, CAST(sum(entries) AS BIGINT) AS entries, min(user_key) AS smallest, max(user_key) AS largest FROM c GROUP BY g, part"""
)
def output_split_grandparents(spark, d):
    e = _jobs(spark, d)
    uid = F.substring("user_key", 2, 10).cast("long")
    grand = e.select("job", "user_key").distinct().select("job", uid.alias("number"), (1000 * (uid % 3)).alias("file_size"), F.col("user_key").alias("smallest"), F.col("user_key").alias("largest"))
    out = encoding.cut_outputs(e, "job", 16 * 1024, grand, 2500)
    return out.groupBy("job", "part").agg(F.count("*").alias("entries"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"))


@query(f"WITH {LOG}, t AS (SELECT DISTINCT user_key || 'a' AS target FROM log), k AS (SELECT target, (SELECT min(user_key) FROM log WHERE user_key >= target) AS user_key FROM t) SELECT target, k.user_key, min(value) AS value FROM k LEFT JOIN log USING (user_key) GROUP BY target, k.user_key")
def kv_lower_bound_value(spark, d):
    log = src.events_log(spark, d)
    return versions.lower_bound(log, log.select(F.concat("user_key", F.lit("a")).alias("target")), value="value")


@query(None)
def wal_split_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return wal.split_log(e.select(F.floor(F.col("event_id") / 1000).cast("long").alias("log"), F.col("event_id").alias("record"), (F.col("event_id") * 7919 % 70_000).alias("length")))


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.decode("user_key", "UTF-8").alias("user_key"), F.decode("value", "UTF-8").alias("value"))


@query(ORACLE_SQL["kv_full_scan"])
def store_scan(spark, d):
    """Two batches, a compaction, another one, all read after the store is opened anew."""
    path, log, n = src.workspace(spark), src.events_log(spark, d), src.last_seq(spark, d)
    e = Engine.open(spark, path, Options(disable_auto_compaction=True))
    e.apply(src.operations(log.where(F.col("seq") <= n // 2)))
    e.compact_once(force=True)
    e.apply(src.operations(log.where(F.col("seq") > n // 2)))
    e.compact_once(force=True)
    e.vacuum()
    return _text(Engine.open(spark, path).scan())


@query(ORACLE_SQL["kv_as_of"])
def store_snapshot(spark, d):
    """What a snapshot sees after later writes and a compaction."""
    log, n = src.events_log(spark, d), src.last_seq(spark, d)
    e = Engine.open(spark, src.workspace(spark), Options(disable_auto_compaction=True))
    e.apply(src.operations(log.where(F.col("seq") <= n // 2)))
    with e.snapshot() as seq:
        e.apply(src.operations(log.where(F.col("seq") > n // 2)))
        e.compact_once(force=True)
        return _text(e.scan(seq))


@query(ORACLE_SQL["kv_multi_get"])
def store_multi_get(spark, d):
    log = src.events_log(spark, d)
    e = Engine.open(spark, src.workspace(spark), Options(disable_auto_compaction=True))
    e.apply(src.operations(log))
    return _text(e.multi_get(_probes(log).select(F.encode("user_key", "UTF-8").alias("user_key"))))


@query(ORACLE_SQL["kv_full_scan"])
def store_ingest(spark, d):
    """A stream of files of operations, in batches, into a store."""
    path = src.workspace(spark)
    src.operations(src.events_log(spark, d)).repartitionByRange(4, "op_no").sortWithinPartitions("op_no").write.parquet(f"{path}-in")
    # all files make one batch, which is ordered by op_no
    e = Engine.open(spark, path, Options(disable_auto_compaction=True))
    ingest(spark, e, f"{path}-in", f"{path}-checkpoint").awaitTermination()
    return _text(e.scan())


@query("WITH log AS (SELECT printf('c%06d', o_custkey) AS user_key, o_orderkey + 1 AS seq, o_orderstatus = 'F' AS gone, o_orderpriority AS value FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS n FROM log) SELECT user_key, value FROM r WHERE n = 1 AND NOT gone")
def kv_latest_orders(spark, d):
    return versions.as_of(src.orders_log(spark, d))
