"""Session helpers of the training-data operators: carried columns, sieves, slices of Arrow batches, workers' memory."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import drop_path, forget, fresh_path, shared_dir, written

__all__ = ["carried", "cut", "drop_path", "forget", "fresh_path", "map_slices", "quoted", "shared_dir", "sieve", "small_batches", "trim", "unpacked", "written"]


def quoted(name: str) -> str:
    """A column name as it stands, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, leave: tuple[str, ...] = ()) -> F.Column:
    """The columns of docs but for some as one struct whose fields are numbered, so no name of theirs meets one of ours."""
    return F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in leave])


def unpacked(names: list[str], row: str = "row", **new: F.Column) -> list[F.Column]:
    """The columns that carried() took from a frame with these names, some with new values."""
    return [(new[c] if c in new else F.col(f"{row}.c{i}")).alias(c) for i, c in enumerate(names)]


def sieve(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with a boolean `_maybe` that is true wherever the column's value is in the same column of keys, and seldom
    elsewhere: a bitmap of at most 2**20 words, built by a grouped bit_or and broadcast. It spares rows a shuffle; an
    exact join has to follow."""
    n = keys.count()
    words = 1 << min(20, max(10, (n // 4).bit_length()))
    h = F.xxhash64(F.lit(7), F.col(column))
    word, bit = F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    bitmap = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    out = df.withColumns({"_w": word, "_bit": bit}).join(F.broadcast(bitmap.withColumnRenamed("_word", "_w")), "_w", "left")
    return out.withColumn("_maybe", F.expr("coalesce((shiftright(_bits, _bit) & 1) = 1, false)")).drop("_w", "_bit", "_bits")


def cut(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the column, one row at least."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    i, n = 0, len(ends)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def trim(drop_words: bool = True) -> None:
    """Give back what a reused Python worker holds from earlier tasks: the table of words, and freed memory."""
    if drop_words and (tokens := sys.modules.get("motiflake.llm.tokens")):
        tokens.vocabulary.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let the session's Arrow batches hold at most 4 MB: the JVM and the workers hold several of a task's at once."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if not 0 < size <= most:
        spark.conf.set(BATCH, str(most))


def map_slices(
    df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, most: int = 2 << 20, keep_words: bool = False
) -> DataFrame:
    """mapInArrow over slices of bounded text size, so memory doesn't follow the rows per Arrow batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim(not keep_words)
        for batch in batches:
            if batch.num_rows:
                for part in cut(batch, column, most):
                    yield from fn(part)
        trim(False)

    return df.mapInArrow(run, schema)
