"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: What separates words in most contracts: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Nothing reads the shuffles behind a written table again; Python workers get texts in batches of some megabytes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="papertide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papertide-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables of which everything has been derived, and stored, that will be needed."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(conf).delete(at, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` by functions that come by value.

    Every task has its own copy of a function's module, some tens of MB with its
    tables, which hang in cycles: what the task before left is collected first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        yield from f(batches)

    return df.mapInArrow(run, schema)


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of bounded size; call the result in a task to get it.

    It travels as bytes with its classes, which Spark's own pickling leaves out.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def row_digest(df: DataFrame) -> Column:
    """All of a row as 128 bits in hex; nulls, which the hash passes over, are marked.

    What has no hash, maps and variants, counts as its JSON.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        parts += [c if _hashable(f.dataType) else F.to_json(F.struct(c.alias("c"))), c.isNull()]
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0")
    return F.concat(half(1), half(2))


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would fold other alphabets too."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
