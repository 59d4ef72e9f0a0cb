"""Typed reading and resumable writing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without that setting, and has a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stored-")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what several passes need is made once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` (stored, as it is counted) to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame, *keys: str, each: int = 1) -> DataFrame:
    """``df`` dealt out to all cores if it is read in fewer tasks than there are (``each`` a core); a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism * each
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file whose header and row lengths must be the schema's; blanks are null, and rows of blanks alone are left out."""
    rows = spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", nullValue="", multiLine=True, escape='"').csv(path)
    return rows.na.drop("all")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, its keys in order, anew."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under an explicit schema: a missing path is an empty table, unknown keys go, a broken line fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the Parquet table at ``path`` lacks, so that a run can be taken up again."""
    spark = rows.sparkSession
    if exists(spark, path):
        done = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(done, keys, "left_anti")
    rows.dropDuplicates(keys).write.mode("append").parquet(path)


def read_authored(spark: SparkSession, path: str, schema: StructType | str, key: str = "passage_id") -> DataFrame:
    """What authors wrote, a row for each ``key``: of several the last in the file. A file without rows fails."""
    rows = read_jsonl(spark, path, schema).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())) if exists(spark, path) else None
    if rows is None or rows.isEmpty():
        raise ValueError(f"nothing was authored in {path}")
    names = [c for c in rows.columns if c not in (key, "_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("r")).select(key, "r.*")
