"""Session helpers: table paths and lineage cuts in the folder that all executors share."""

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CUTTING = threading.RLock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def put(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back; its shuffle files go, since the table holds the result."""
    spark = df.sparkSession
    with CUTTING:  # cuts of one process take turns, since each changes the session's setting for a while
        before = spark.conf.get(CLEAN, None)
        spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives lost executors."""
    return put(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once all that reads it has been written."""
    spark = df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if path.startswith(shared_folder(spark)):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def in_parts(rows: DataFrame, key: str, path: str, parts: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(rows), worked off in `parts` parts by a hash of key, each appended once and then marked as done.

    A run that was killed and is started again over the same rows skips the parts that are done and writes the one it
    was at anew, so any number of runs gives the same table. make takes and gives DataFrames of any one part. Null keys
    are in one part; without rows the table is empty.
    """
    spark = rows.sparkSession
    for k in range(parts):
        if not exists(spark, f"{path}/done/part={k}"):
            own = make(rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k))
            own.write.mode("overwrite").parquet(f"{path}/rows/part={k}")
            spark.range(1).write.mode("overwrite").parquet(f"{path}/done/part={k}")
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/part=*").drop("part")
