"""Tables written once and read back: cuts the lineage, survives lost executors, and is computed once however often it is read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="papertide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in a folder ``papertide-*`` that may be deleted with what is derived from it."""
    path = f"{shared_dir(df.sparkSession)}/papertide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables once all that is derived from them, and will be needed, is stored."""
    for t in tables:
        context = t.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
