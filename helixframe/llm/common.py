"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables are broadcast up to so many rows and bytes, measured first; larger ones are shuffled.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one, as in tests, gets a temporary one; a cluster has to name it."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="helixframe-")
    if known.isEmpty():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a columnar table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The stored table ``df``, when what was needed only to make it leaves the disk: the files of tables of ``stored`` that no later step reads, and shuffle files.

    Spark removes a shuffle's files once the driver has collected the objects that name it; a driver with little to do does not do so for many steps.
    """
    for table in spent:
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; HELIXFRAME_TOKENIZERS overrides the folder."""
    folder = os.environ.get("HELIXFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _size(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda total, x: total + _size(x, kind.elementType)), F.lit(16).cast("long"))
    if isinstance(kind, T.StructType):
        return reduce(add, [_size(value[f.name], f.dataType) for f in kind.fields], F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def free_name(name: str, *taken: list[str]) -> str:
    """A column name that none of the given lists of columns holds, in any case of letters."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def bounded(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it has ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` at most, else as it is."""
    size = reduce(add, [_size(df[f.name], f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))
    rows, taken = df.select(size.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and taken <= BROADCAST_BYTES else df
