"""What the corpus operators share: table loading, the shared work folder, materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors can reach.

    The session names it in spark.checkpoint.dir. Where that is unset, a local master gets a fresh temporary
    folder and a cluster gets a folder below the warehouse, which is shared by definition.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="spark-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Hadoop resolves it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(p).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Rows and bytes in an Arrow batch, so that a batch of very long texts stays small. Spark reads these settings of the
    session when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def set_aside(df: DataFrame, *made: str) -> DataFrame:
    """df, with columns that have the name of one still to be made renamed to ``<name>_in`` (or ``<name>_in_in`` and so on)."""
    for name in made:
        for old in [c for c in df.columns if c.lower() == name.lower()]:
            new = old + "_in"
            while new.lower() in {c.lower() for c in df.columns} | {m.lower() for m in made}:
                new += "_in"
            df = df.withColumnRenamed(old, new)
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as the text 'null'."""
    as_text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.pmod(F.crc32(F.encode(as_text, "UTF-8")), F.lit(4)) == HELD_OUT_REMAINDER


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, faster, where a text is all ASCII."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, small))


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, label: str, max_rows: int = 500_000) -> DataFrame:
    """left join right, where right is written out and counted first: broadcast up to max_rows narrow rows, else a
    shuffled join that Spark may split on skew."""
    written = materialise(right, label)
    few = written.count() <= max_rows
    return left.join(F.broadcast(written) if few else written.hint("merge"), on, how)
