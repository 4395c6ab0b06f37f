"""Session defaults and the shared folder for materialised intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "collatrix", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark share."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one for a local session, as other machines could not read it."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"collatrix-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get()


_WRITTEN: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Delete what ``materialize`` wrote in this process, once no result that reads it is needed; returns how many."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; ``drop_materialized`` deletes it."""
    _WRITTEN.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The plan above the result no longer recomputes ``df``, and a lost executor
    loses nothing: every executor can read the files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
