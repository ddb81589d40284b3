"""Helpers shared by the corpus operators: reading, staging and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Spark's setting that frees shuffle files when the job that wrote them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only for a local session that names none, as in tests; on a
    cluster executors would not see it, so there an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="pixelloom-")
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only tasks of the running job, and later
    jobs read columns of the written table instead of computing it again. The shuffle files
    of the job are freed at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to bound what is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: rows ``(node, root)``.

    ``root`` is the smallest node reachable. Alternates the large-star and small-star
    steps (each a minimum per node, combined map-side, joined back to the edges), so
    neither neighbour lists nor components are ever gathered in one task. Rounds are
    staged in the shared folder. Any orderable node type works; null ends are ignored.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        hung = both.join(low, "a")
        if large:
            return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e, before = stage(e, "cc"), None
    while True:
        last, e = e, stage(star(star(e, True).distinct(), False).where("a > b").distinct(), "cc")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
