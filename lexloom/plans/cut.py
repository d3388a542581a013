"""Cut the lineage of iterative plans by tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session may have none and gets a temporary folder, removed when Python exits."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
