"""Session-level helpers shared by all operators: lineage cuts, salting and sizing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows per Arrow batch handed to Python; texts can be long, so batches stay small.
ARROW_ROWS = 1000
#: Keys treated as heavy in a join, rows from which a key can be one, and parts of a heavy key.
HEAVY_KEYS = 1024
HEAVY_ROWS = 10_000
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts.

    ``spark.checkpoint.dir`` is used when the session names one, else the context's own checkpoint folder.  Where
    neither is set, a local master (tests, notebooks) gets a temporary folder; a cluster is an error, since
    a folder of the driver's machine would not be shared.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gneiss-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a scan of it.

    Cuts the lineage with a table every executor can read again after losses, and lets later
    readers prune columns.  The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gneiss-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to the end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 in the order of the columns, without one task for all of them: numbers within range
    partitions, shifted by the rows of the partitions before."""
    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ordered.withColumn("_rn", inner).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_rn") + F.col("_before")).cast("int")).drop("_part", "_rn", "_before")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM is gone where the session was stopped before the end
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def heavy_keys(big: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """The ``HEAVY_KEYS`` keys of ``big`` with the most rows, as far as these exceed ``heavy_rows``; None without any.

    Any other key has less than a share of 1 / HEAVY_KEYS of the rows, or few rows.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy_rows)
    heavy = counts.orderBy(F.desc("_n")).limit(HEAVY_KEYS).collect()
    if not heavy:
        return None
    return big.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in heavy], counts.select(*keys).schema).withColumn("_heavy", F.lit(True))


def join_salted(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = SALTS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, the heaviest keys of ``big`` cut into ``salts`` parts."""
    return join_heavy(big, small, keys, spread, heavy_keys(big, keys, heavy_rows), how, salts)


def join_heavy(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], heavy: DataFrame | None, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, the keys in ``heavy`` (of ``heavy_keys``) cut into ``salts`` parts.

    ``spread`` names columns of ``big`` whose hash chooses the part; rows of ``small`` with a heavy key are repeated per
    part.  ``how``: inner, left, left_semi or left_anti.  What is broadcast has ``HEAVY_KEYS`` rows at most.
    """
    if heavy is None:
        return big.join(small, keys, how)
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_heavy")
    right = small.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(parts)).drop("_heavy")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for whole texts, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns: a 16-byte stand-in for long string keys."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("k2")]
