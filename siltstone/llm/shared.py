"""What the operators of this package share: lineage cuts, size-checked broadcasts, row identity."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .textbytes import slices, tidy

#: Rows of a small side are broadcast up to this many bytes (estimated); beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
ROW_OVERHEAD = 64  # what a row of a broadcast hash relation takes besides its fields
TEXT_BATCH = 1000
TEXT_BATCH_BYTES = 4 << 20

_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set and the master is local, as in tests, a temporary folder is taken; on a
    cluster that is an error, since a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def lean(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most so many rows and bytes (a longer text is a batch of its own): of the
    default 10,000 rows, long texts fill tens of MB in the JVM and the worker."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)):
        held = spark.conf.get(name).lower()
        if not (held.rstrip("b").isdigit() and 0 < int(held.rstrip("b")) <= most):
            spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are small; for checkpointed inputs, so counting is cheap."""
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES else df


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` in one column, row, so that columns that are added can't clash with theirs; select("row.*") undoes it."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def second_hash(text: Column) -> Column:
    """Independent of :func:`text_hash`: the same function under another seed."""
    return F.xxhash64(F.lit(0x5157), text)


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Runs of other characters than spaces, tabs and line breaks; null and empty texts have none."""
    out = np.zeros(len(texts), np.int64)
    for first, buf, offsets in slices(texts):
        inside = ~_GAP[buf]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # a text begins with a space
        out[first : first + len(offsets) - 1] = np.diff(np.searchsorted(starts, offsets))
    tidy()
    return pa.array(out)
