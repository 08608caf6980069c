"""Session helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate data.

    ``spark.checkpoint.dir`` wins. A folder of our own is made only in a local
    session where the setting is absent and no checkpoint folder has been set,
    as in tests; on a cluster that is an error, as a machine's own folder would
    scatter the files.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not now:
            sc.setCheckpointDir(named)
        return named
    if not now:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        now = sc.getCheckpointDir()
    return now


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; unlike an RDD
    checkpoint the files are compressed and columnar, so later steps read only
    the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`durable` once nothing reads them."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/tidemark-" in f:
                p = spark._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: of the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def word_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
