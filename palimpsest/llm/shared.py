"""Tables in the shared folder, and small DataFrame helpers of the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under ``spark.checkpoint.dir``.  Where that is unset a local
    session gets a temporary folder; on a cluster that would be one machine's, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
    app = spark.sparkContext.applicationId
    if app not in _swept:
        _swept.add(app)
        atexit.register(sweep, spark)
    return f"{at.rstrip('/')}/palimpsest-{app}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, any
    executor can read it after another is lost, and its size is known to the planner
    (a side is broadcast only if that size is below the session's threshold).  The shuffle
    files of the write are given back as soon as it is done.

    drop() deletes the table; what a returned, still lazy result reads stays until sweep(),
    which runs at the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by keep() that nothing reads any more."""
    for df in tables:
        if getattr(df, "_kept_at", None):
            _delete(df.sparkSession, df._kept_at)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has kept.  Call it once results are written; it
    also runs when the process ends."""
    try:
        _delete(spark, shared_dir(spark))
    except Exception:  # the session is gone: the folder is named after the application for others to delete
        pass


def n_words(text) -> F.Column:
    """Words of a text column as a long; null is 0.  A split leaves an empty string
    before leading and after trailing white space; those are not words."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, BLANK))
    lead = F.when(t.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    trail = F.when(t.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(t.rlike("[^\\x20\\x09-\\x0D]"), parts - lead - trail).otherwise(0).cast("long")


def fold_of(doc_id, mod: int) -> F.Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id has the crc32 of the empty text, 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) pairs of one orderable type: (node, root), root the least
    node reachable; nodes that are their own root are left out.

    Alternates large-star and small-star rounds (Kiveris et al. 2014), each a pre-aggregated
    minimum and an equi-join, until nothing changes: O(log n) rounds in practice, each written
    to the shared folder.  The minimum of a node with very many neighbours is pre-aggregated; its
    rows on the other side of the join meet in one task, which streams them.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        new = keep(small, "cc")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign


def free_name(taken: list[str], stem: str) -> str:
    """A column name that differs from all of ``taken``, whatever their case."""
    names = {c.lower() for c in taken}
    while stem.lower() in names:
        stem += "_"
    return stem


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ``ids(doc_id)``; null ids stay.  All columns stay."""
    lost = free_name(docs.columns, "lost")
    # kept, so that its size is known: a short list does not make all texts travel
    gone = keep(ids.where("doc_id is not null").select(F.col("doc_id").alias(lost)).distinct(), "lost")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(lost), "left_anti")
