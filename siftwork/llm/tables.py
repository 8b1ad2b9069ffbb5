"""Shared steps of the operators of this package: fold columns, shared-folder tables, batch sizes."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import scratch_dir


ROWS = 512
BITS = 27  # of the bitmap of wanted keys


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: computed once, and read again rather than recomputed when an executor is lost."""
    path = f"{scratch_dir(df.sparkSession, purpose)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def picked(df: DataFrame, wanted: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """All rows of ``df`` whose keys are among those of ``wanted``, and few others, as a broadcast bitmap of ``2**bits`` bits of the keys'
    hashes tells: a join after it moves what it needs, whatever the size of ``df``."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    rows = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(((1 << bits) // (8 << 12) + 2, 1 << 12), np.uint8)  # the function's bitmaps have 4,096 bytes each
    for r in rows.collect():  # 2**bits bits in all; one job, where an iterator would run one for each partition
        whole[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def maybe(number: pd.Series, place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((shared.value[number.to_numpy(), at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
    return df.where(maybe(F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)))


def parted(df: DataFrame, marked: DataFrame, *keys: str, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose keys are among those of ``marked``, with few others, and the rest. As ``picked``, without Python: the
    bitmap is a broadcast table of ``2**bits`` bits at most, so the rest never has to be shuffled to be told apart."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    rows = marked.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))  # no bitmap where no key is
    both = df.join(F.broadcast(rows), F.bitmap_bucket_number(bit) == F.col("_at"), "left")
    return both.where(told).select(*df.columns), both.where(~told).select(*df.columns)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows: a step's arrays are many times its texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives freed memory back to the system at a task's end: Python workers stay for the next stage, idle or not,
    and count against their executor for what they once held."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
    return whole


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[dict] | dict | None], schema: str, finish: Callable[[], dict | None] | None = None) -> DataFrame:
    """mapInArrow with columns given as a dictionary of arrays; ``finish`` may add rows at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: dict | None) -> Iterator[pa.RecordBatch]:
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in kinds], schema=kinds)
        for few in sliced(batches):
            got = step(few)
            for part in ([got] if got is None or isinstance(got, dict) else got):
                yield from out(part)
        if finish is not None:
            yield from out(finish())
    return df.mapInArrow(given_back(run), schema)


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed longs Spark holds."""
    return h.view(np.int64)
