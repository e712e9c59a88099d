"""Sessions, the folder that all executors share, and tables in versions."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_session(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session that answered a probe; settings are those of the cluster but for ``conf``."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    if spark.sql("SELECT 1 AS one").first().one != 1:
        raise RuntimeError("the session doesn't answer")
    return spark


def run_sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """Any query, with named parameters (``:name``)."""
    return spark.sql(text, args=args or None)


def shared_dir(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session; a temporary folder for a local master only; else none."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        return None
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = shared_dir(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder}/weftgraph/{uuid.uuid4().hex}/{name}"


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, time and length of the files of a table."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.Path(path)):
        return []
    return [(s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(jvm.Path(path))]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again; without such a folder the table as it is."""
    if shared_dir(df.sparkSession) is None:
        return df
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Stored rows with a number of their own, which is fixed by being written; without a shared folder, by being kept on the executors."""
    made = df.withColumn(column, F.monotonically_increasing_id())
    return made.localCheckpoint() if shared_dir(df.sparkSession) is None else stored(made, name)


#: Keys that several rows have: up to so many are broadcast, more are joined by a shuffle.
MOST_BROADCAST = 200_000


def lone_and_shared(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the rest (none if there is none). Keys alone are shuffled to tell; null is a key."""
    several = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key")), "shared_keys")
    n = several.count()
    if not n:
        return rows, None
    own = F.broadcast(several) if n <= MOST_BROADCAST else several
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(own, same, "left_anti"), rows.join(own, same, "left_semi")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint where there is a folder for it."""
    return df.checkpoint() if shared_dir(df.sparkSession) else df


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first: Spark writes the mark of success last."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))


def save_version(df: DataFrame, path: str) -> None:
    """Writes a new version beside the others; readers see it once it is complete."""
    done = _versions(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v{done[-1] + 1 if done else 1}")


def load_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version; an empty table if there is none or it can't be read."""
    done = _versions(spark, path)
    if done:
        try:
            table = spark.read.parquet(f"{path}/v{done[-1]}")
            wanted = spark.createDataFrame([], schema).schema
            if {f.name: f.dataType for f in wanted} == {f.name: f.dataType for f in table.schema}:
                return table.select(*wanted.names)
        except (PySparkException, Py4JJavaError):
            pass
    return spark.createDataFrame([], schema)
