"""A versioned store on Parquet directories.

Data files are written first, then one edit file appears by rename: the commit
point. Readers take files from the edits, never from the directory, so what a
failed writer left is invisible; :meth:`Engine.vacuum` deletes it.

    data/NNNNNN/r=K/  one file: a range of keys of a run or of a compaction's output
    edits/NNNNNN.json one edit

Files hold about ``TARGET_FILE_BYTES``, each with its own bounds, so that a
compaction reads only the files of the next level that it meets.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import levels, merge, versions
from ..schema import COMPARATOR, DELETE, L0_STOP, L0_TRIGGER, MAX_SEQ, MUTATIONS, NUM_LEVELS, PUT, TARGET_FILE_BYTES, Corrupted, InvalidArgument, Options


class Engine:
    """Open with :meth:`open`. Metadata is a few rows for each file and lives on the driver; data never does."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._snapshots: dict[int, int] = {}
        self._handles = 0
        self.files: dict[tuple[int, int], dict] = {}
        self.last_seq, self.next_file, self.edit_no = 0, 1, 0
        self.pointers: dict[int, bytes] = {}
        self.batches: dict[str, int] = {}

    # ---- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, sub: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{sub}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> "Engine":
        """Create the store or recover it; a directory with other content is refused."""
        e = cls(spark, path, options or Options())
        fs, root = e._fs(e.path)
        if fs.exists(root) and fs.listStatus(root) and "edits" not in e._names(""):
            raise InvalidArgument(f"{path} is not empty and holds no store")
        names = [n for n in e._names("edits") if n.endswith(".json") and n[:-5].isdigit()]
        if names:  # one scan for all edits
            texts = spark.read.option("wholetext", True).text([f"{e.path}/edits/{n}" for n in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"), "value")
            found = {r.n: r.value for r in texts.collect()}
        for n in names:
            try:
                edit = json.loads(found.get(n, ""))
            except ValueError as x:
                raise Corrupted(f"edit {n}: {x}") from x
            e._apply(edit)
            e.edit_no = int(n[:-5])
        if not names:
            e._commit({"comparator": COMPARATOR})
        return e

    def _apply(self, edit: dict) -> None:
        for lv, n in edit.get("deleted", []):
            self.files.pop((lv, n), None)
        for f in edit.get("added", []):
            if not 0 <= f["level"] < NUM_LEVELS:
                raise Corrupted(f"level {f['level']} does not exist")
            self.files[f["level"], f["number"]] = f
        self.last_seq = max(self.last_seq, edit.get("last_seq", 0))
        self.next_file = max(self.next_file, edit.get("next_file", 0))
        for lv, k in edit.get("pointers", []):
            self.pointers[lv] = bytes.fromhex(k)
        self.batches |= edit.get("batches", {})

    def _commit(self, edit: dict) -> None:
        edit |= {"last_seq": max(self.last_seq, edit.get("last_seq", 0)), "next_file": self.next_file}
        no = self.edit_no + 1
        fs, tmp = self._fs(f"{self.path}/edits/{no:06d}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(edit).encode()))
        out.hsync()
        out.close()
        _, final = self._fs(f"{self.path}/edits/{no:06d}.json")
        if fs.exists(final) or not fs.rename(tmp, final):
            raise Corrupted(f"edit {no} was committed by another writer")
        self.edit_no = no
        self._apply(edit)

    def clean(self) -> list[str]:
        """Delete data that no edit holds; what it deleted. Not while another writer or a reader of older files is at work."""
        live = {f["dir"] for f in self.files.values()}
        gone = []
        for top in self._names("data"):
            own = [f"data/{top}/{n}" for n in self._names(f"data/{top}")]
            dead = own if not any(d in live for d in own) else [d for d in own if d.split("/")[-1].startswith("r=") and d not in live]
            for d in [f"data/{top}"] if len(dead) == len(own) else dead:
                fs, p = self._fs(f"{self.path}/{d}")
                fs.delete(p, True)
                gone.append(d)
        fs, _ = self._fs(self.path)
        for n in self._names("edits"):
            if n.endswith(".tmp"):
                fs.delete(self._fs(f"{self.path}/edits/{n}")[1], True)
        return gone

    # ---- writes

    def put(self, key: bytes, value: bytes) -> int:
        return self.apply(self.spark.createDataFrame([(0, PUT, key, value)], "op_no long, vtype int, user_key binary, value binary"))

    def delete(self, key: bytes) -> int:
        return self.apply(self.spark.createDataFrame([(0, DELETE, key, None)], "op_no long, vtype int, user_key binary, value binary"))

    def apply(self, ops: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append operations (op_no, vtype, user_key, value) as sorted runs, in the order of op_no; the last sequence number.

        op_no tells operations apart and mustn't repeat. They are written once,
        in ranges of op_no, and numbered from these files by the counts of the
        ranges, so that a lost executor can't change a number. ``batch`` names a
        source and its batch; a batch that the store has seen is left out.
        """
        if batch and self.batches.get(batch[0], -1) >= batch[1]:
            return self.last_seq
        n_parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        ranged = ops.select("op_no", "vtype", "user_key", "value").repartitionByRange(n_parts, "op_no").sortWithinPartitions("op_no")
        ranged.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(stage)
        try:
            staged = self.spark.read.parquet(stage)
            bad, odd = (F.sum(c.cast("long")) for c in (F.coalesce(F.length("user_key"), F.lit(0)) == 0, ~F.coalesce(F.col("vtype").isin(PUT, DELETE), F.lit(False))))
            size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
            stats = staged.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("op_no").alias("d"), bad.alias("bad"), odd.alias("odd"), F.sum(size).alias("b")).collect()
            if any(r.bad for r in stats):
                raise InvalidArgument("a key is empty")
            if any(r.odd for r in stats):
                raise InvalidArgument("a version is neither put nor delete")
            if any(r.d < r.n for r in stats):
                raise InvalidArgument("an op_no is null or stands twice")
            edit: dict = {"batches": {batch[0]: batch[1]}} if batch else {}
            if stats:
                at, ahead = [], self.last_seq
                for r in sorted(stats, key=lambda r: r.p):
                    at.append((r.p, ahead))
                    ahead += r.n
                rows = staged.join(F.broadcast(self.spark.createDataFrame(at, "p int, o long")), "p")
                value = F.when(F.col("vtype") == DELETE, F.lit(b"")).otherwise(F.coalesce("value", F.lit(b"")))
                log = rows.select("user_key", (F.col("o") + F.col("i") + 1).alias("seq"), F.col("vtype").cast("tinyint").alias("vtype"), value.alias("value"))
                edit |= {"added": self._write(log, 0, sum(r.b + 9 * r.n for r in stats)), "last_seq": ahead}
            if edit:
                self._commit(edit)
        finally:
            fs, p = self._fs(stage)
            fs.delete(p, True)
        if not self.options.disable_auto_compaction:
            while len(self._runs()) >= L0_STOP and self.compact_once():
                pass
        return self.last_seq

    def _runs(self) -> set[str]:
        """Runs at level 0; the ranges of one run count once."""
        return {f["dir"].split("/")[1] for (lv, _), f in self.files.items() if lv == 0}

    def _write(self, log: DataFrame, level: int, n_bytes: int) -> list[dict]:
        """Write sorted rows as files of about the target size, one range of keys each; their descriptions.

        All versions of a key are in one file, as ranges are cut by keys alone.
        """
        n = max(1, -(-n_bytes // TARGET_FILE_BYTES))
        base = self.next_file
        path = f"{self.path}/data/{base:06d}"
        ranged = log.repartitionByRange(n, "user_key").withColumn("r", F.spark_partition_id()).sortWithinPartitions("user_key", F.desc("seq"))
        ranged.write.partitionBy("r").option("parquet.bloom.filter.enabled#user_key", "true").parquet(path)
        size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9
        found = self.spark.read.parquet(path) if any(x.startswith("r=") for x in self._names(f"data/{base:06d}")) else None
        stats = [] if found is None else found.groupBy("r").agg(F.count("*").alias("n"), F.sum(size).alias("b"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi")).collect()
        self.next_file = base + n
        return [{"level": level, "number": base + r.r, "dir": f"data/{base:06d}/r={r.r}", "file_size": int(r.b), "entries": int(r.n), "smallest": bytes(r.lo).hex(), "largest": bytes(r.hi).hex()} for r in sorted(stats, key=lambda r: r.r)]

    # ---- reads

    def log(self) -> DataFrame:
        """All stored versions."""
        paths = [f"{self.path}/{f['dir']}" for _, f in sorted(self.files.items())]
        return self.spark.read.schema(MUTATIONS).parquet(*paths) if paths else self.spark.createDataFrame([], MUTATIONS)

    def get(self, key: bytes, seq: int = MAX_SEQ) -> bytes | None:
        """The visible value of a key, from the files whose range holds it."""
        k = key.hex()
        paths = [f"{self.path}/{f['dir']}" for f in self.files.values() if f["smallest"] <= k <= f["largest"]]
        if not paths:
            return None
        r = versions.get(self.spark.read.schema(MUTATIONS).parquet(*paths), key, seq).first()
        return None if r is None else bytes(r.value)

    def multi_get(self, keys: DataFrame, seq: int = MAX_SEQ) -> DataFrame:
        return versions.multi_get(self.log(), keys, seq)

    def scan(self, seq: int = MAX_SEQ, **bounds) -> DataFrame:
        return versions.scan(self.log(), seq, **bounds)

    @contextmanager
    def snapshot(self):
        """Pin the present sequence number against compaction; every handle counts on its own."""
        self._handles += 1
        me = self._handles
        self._snapshots[me] = self.last_seq
        try:
            yield self.last_seq
        finally:
            del self._snapshots[me]

    def oldest_snapshot(self) -> int:
        return min(self._snapshots.values(), default=MAX_SEQ)

    # ---- compaction

    def files_df(self) -> DataFrame:
        rows = [(f["level"], f["number"], f["file_size"], bytes.fromhex(f["smallest"]), bytes.fromhex(f["largest"])) for f in self.files.values()]
        return self.spark.createDataFrame(rows, "level int, number long, file_size long, smallest binary, largest binary")

    def stats(self) -> DataFrame:
        return levels.level_stats(self.spark, self.files_df())

    def compact_once(self, force: bool = False) -> bool:
        """Merge the neediest level into the next one; whether anything was done. Below a score of 1 only by ``force``."""
        files = self.files_df()
        scores = {r.level: r.score for r in levels.compaction_scores(files).collect()}
        if 0 in scores:  # a run's ranges are one file of level 0
            scores[0] = len(self._runs()) / L0_TRIGGER
        for level in sorted(scores, key=lambda lv: (-scores[lv], lv)):
            if not force and scores[level] < 1:
                return False
            picked = levels.pick_inputs(files, level, self.pointers.get(level)).where("role <> 'grandparent'").collect()
            if picked:
                break
        else:
            return False
        dead = [(r.level, r.number) for r in picked]
        oldest = min(self.oldest_snapshot(), self.last_seq)
        log = self.spark.read.schema(MUTATIONS).parquet(*(f"{self.path}/{self.files[d]['dir']}" for d in dead))
        deeper = files.where(F.col("level") >= level + 2)
        kept = merge.retain(log, oldest, deeper if deeper.limit(1).count() else None)
        added = self._write(kept, level + 1, sum(self.files[d]["file_size"] for d in dead))
        top = max((self.files[d]["largest"] for d in dead if d[0] == level), default="")
        self._commit({"deleted": dead, "added": added, "pointers": [[level, top]]})
        return True

    def vacuum(self) -> list[str]:
        """Delete data that compactions have replaced; not while readers of older files run."""
        return self.clean()

    def close(self) -> None:
        self._snapshots.clear()

