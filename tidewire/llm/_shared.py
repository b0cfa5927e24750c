"""Tables in the shared folder: lineage is cut by writing to the folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from the session. Unset, it is an error, but for a session of one machine (tests), which gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has: the caller's columns may be called anything."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same_columns(df: DataFrame) -> list:
    """All columns of ``df`` as Columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows that cross to Python at once, where the session leaves Spark's default: texts may be long, and a batch is held whole on either side.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with batches for Python of 2,000 rows at most if nothing else was set."""
    spark = df.sparkSession
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewire/{name}-{uuid.uuid4().hex[:12]}"


#: Spark deletes an execution's shuffle files when it ends, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: no lineage, and a lost executor costs nothing. The write's shuffle files go with it."""
    spark = df.sparkSession
    path, was = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if "/tidewire/" in p.toString():
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder; results that were not yet written are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewire")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % n
