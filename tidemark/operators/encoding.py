"""Sizes that an encoder would need: shared prefixes, restart points, varints, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DATA_BLOCK_BYTES, GRANDPARENT_LIMIT, RESTART_INTERVAL, TARGET_FILE_BYTES


def shared_prefix(a: str, b: str) -> Column:
    """Number of leading characters that two texts share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1))))
    return F.when(F.col(a).isNull() | F.col(b).isNull() | (n == 0), 0).otherwise(F.coalesce(F.try_element_at(same, F.lit(1)) - 1, n)).cast("long")


def key_prefixes(runs: DataFrame, interval: int = RESTART_INTERVAL) -> DataFrame:
    """run_no, user_key, seq, restart, shared: what each entry of a sorted run shares with the one before; nothing at restarts."""
    w = W.partitionBy("run_no").orderBy("user_key", F.desc("seq"))
    r = runs.withColumn("__b", F.lag("user_key").over(w)).withColumn("restart", (F.row_number().over(w) - 1) % interval == 0)
    return r.select("run_no", "user_key", "seq", "restart", F.when(F.col("restart"), F.lit(0)).otherwise(shared_prefix("user_key", "__b")).cast("long").alias("shared"))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned integer in groups of seven bits."""
    out = F.lit(9)  # every long that isn't negative
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(2 ** (7 * n)), n).otherwise(out)
    return F.when(x < 0, 10).otherwise(out).cast("long")


def _greedy(limit: int, key: str | None):
    """Number stretches that end with the entry that reaches ``limit``; never inside one value of ``key``."""

    def f(pdf):
        out, n, size, last = [], 0, 0, None
        full = False
        for b, k in zip(pdf["bytes"], pdf[key] if key else range(len(pdf))):
            if full and k != last:
                n, size, full = n + 1, 0, False
            out.append(n)
            size += b
            last = k
            full = full or size >= limit
        return pdf.assign(part=out)

    return f


def cut(entries: DataFrame, group: str, order: list, limit: int = DATA_BLOCK_BYTES, whole: str | None = None) -> DataFrame:
    """Add ``part``: greedy stretches of ``limit`` bytes in each group (a run, or a file), which starts anew after every cut.

    Each cut depends on the one before, so it is a scan by nature; a group is
    one file of a store, of bounded size.
    """
    cols = ", ".join(f"`{n}` {t}" for n, t in entries.dtypes)
    f = _greedy(limit, whole)
    sort = [c if isinstance(c, tuple) else (c, True) for c in order]
    return entries.groupBy(group).applyInPandas(lambda p: f(p.sort_values([c for c, _ in sort], ascending=[a for _, a in sort], kind="stable")), f"{cols}, part long")


def cut_outputs(entries: DataFrame, group: str, limit: int = TARGET_FILE_BYTES, grand: DataFrame | None = None, grand_limit: int = GRANDPARENT_LIMIT) -> DataFrame:
    """Output files of a compaction: all versions of a key stay in one file.

    With ``grand`` (``group``, number, file_size, smallest, largest: files two
    levels below) a file also ends before it meets more than ``grand_limit``
    bytes of them; those that its first key lies in don't count.
    """
    if grand is None:
        return cut(entries, group, ["user_key", ("seq", False)], limit, "user_key")
    cols = ", ".join(f"`{n}` {t}" for n, t in entries.dtypes)

    def f(mine, files):
        mine = mine.sort_values(["user_key", "seq"], ascending=[True, False], kind="stable")
        files = files.sort_values(["smallest", "number"]).to_dict("records")
        out, n, size, met, at, last, head = [], 0, 0, 0, 0, None, True
        for b, k in zip(mine["bytes"], mine["user_key"]):
            if k != last:
                fresh = 0
                while at < len(files) and files[at]["smallest"] <= k:
                    fresh += files[at]["file_size"]
                    at += 1
                if not head and (size >= limit or met + fresh > grand_limit):
                    n, size, met, head = n + 1, 0, 0, True
                if not head:
                    met += fresh
            out.append(n)
            size, last, head = size + b, k, False
        return mine.assign(part=out)

    return entries.groupBy(group).cogroup(grand.groupBy(group)).applyInPandas(f, f"{cols}, part long")
