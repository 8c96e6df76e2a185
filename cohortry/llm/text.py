"""Words, hashes and folds shared by the corpus operators."""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import checkpoint_dir

MIX = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Written once to the shared folder as Parquet (columns can be left out when reading) and read back."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def raw_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, whatever else the table carries: `doc_id` and the UTF-8 bytes of the text as `raw` (null: empty)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"),
    )


def words(raw: bytes) -> list[bytes]:
    """Runs of bytes outside space, tab, line feed, vertical tab, form feed and return, A-Z lowered."""
    return raw.lower().split()


def word_codes(tokens: list[bytes]) -> np.ndarray:
    """32-bit code of every word."""
    return np.fromiter(map(crc32, tokens), dtype=np.uint64, count=len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` codes; empty when there are fewer."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mixed(codes[:n] + MIX)
    for k in range(1, width):
        out = out * MIX + codes[k : k + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """Least or largest (`pick`) of every run of `size` values."""
    out, reach = values, 1
    while 2 * reach <= size:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    n = len(values) - size + 1
    return pick(out[:n], out[size - reach : size - reach + n])
