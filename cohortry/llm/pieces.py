"""SentencePiece encoding through a table of distinct marked words, and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.tokenizers import Numbered, PieceTokenizer, marked_words, model_bytes

BLOCK_BYTES = 16 << 20


def _dealt(words, parts: int) -> dict[int, list[str]]:
    """Distinct words by part of the table, each part in order: the same lists wherever the same words are dealt."""
    out: dict[int, list[str]] = {}
    for word in sorted(words):
        out.setdefault(crc32(word.encode()) % parts, []).append(word)
    return out


def _pack(values: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(values)).tobytes() + sizes.tobytes() + b"".join(values))


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Sizes in bytes of the packed values, and all of them joined."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


@F.pandas_udf(T.BinaryType())
def _shrunk(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([pack(t.encode()) for t in texts], dtype=object)


def _listed(parts: int):
    def run(frames):
        unpack = zstandard.ZstdDecompressor().decompress
        found: dict[int, set[str]] = {}
        for frame in frames:
            for block, text in zip(frame["block"].tolist(), frame["text"]):
                found.setdefault(block, set()).update(marked_words(unpack(text).decode()))
        for block, words in found.items():
            dealt = _dealt(words, parts)
            yield pd.DataFrame({"block": block, "part": list(dealt), "words": [_pack([w.encode() for w in of]) for of in dealt.values()]})

    return run


def _segmented(model: bytes):
    def run(frames):
        tokenizer = PieceTokenizer(model)
        table: dict[bytes, bytes] = {}
        for frame in frames:
            packed = []
            for row in frame["words"]:
                sizes, joined = _unpack(row)
                ends = np.cumsum(sizes).tolist()
                words = [joined[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in table]
                for word, ids in zip(new, tokenizer.segment([w.decode() for w in new])):
                    table[word] = np.array(ids, np.int32).tobytes()
                packed.append(_pack([table[w] for w in words]))
            yield pd.DataFrame({"block": frame["block"], "part": frame["part"], "ids": packed})

    return run


def _gather(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of `flat` that the codes name, one after the other."""
    n = sizes[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _decoder(model: bytes):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda ids: library.decode(ids.tolist()) if len(ids) else ""


def _placed(parts: int, model: bytes | None):
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + ([("decoded", pa.string())] if model else []))

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        decoded = _decoder(model) if model else None
        number = Numbered()
        unpack = zstandard.ZstdDecompressor().decompress
        codes = [np.fromiter(map(number.__getitem__, marked_words(unpack(t.as_py()).decode())), np.int32) for t in docs["text"]]
        packed = dict(zip(table["part"].to_pylist(), table["ids"].to_pylist()))
        order, sizes, flat = [], [], []
        for part, words in _dealt(number, parts).items():
            n, joined = _unpack(packed[part])
            if len(n) != len(words):
                raise RuntimeError("a block and its part of the table hold different words")
            order += [number[w] for w in words]
            sizes.append(n // 4)
            flat.append(np.frombuffer(joined, np.int32))
        size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        if order:
            listed = np.concatenate(sizes)
            size[order] = listed
            start[order] = np.cumsum(listed) - listed
        everything = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        batches, low = [], 0
        while low < len(codes):
            high, words = low, 0
            while high < len(codes) and (words < 500_000 or high == low):
                words += len(codes[high])
                high += 1
            ends = np.cumsum([0, *(int(size[c].sum()) for c in codes[low:high])])
            # a list array counts in 32 bits: one text is far below that
            ids = _gather(np.concatenate(codes[low:high]), start, size, everything)
            columns = [docs["doc_id"].slice(low, high - low).combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            if decoded:
                columns.append(pa.array([decoded(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string()))
            batches.append(pa.RecordBatch.from_arrays(columns, schema=kind))
            low = high
        return pa.Table.from_batches(batches, schema=kind)

    return run


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row (doc_id, ids) per row of `docs`: the ids that the library's `encode` gives for the whole text; with `decoded` also the
    text that its `decode` gives for them, in the same task.

    Where no piece crosses a whitespace marker a text is segmented marked word by marked word. Texts are dealt to blocks of about
    `block_bytes` by hash. A block lists its distinct marked words; lists meet by hash of the word in the parts of a table, where
    each distinct word is segmented once; ids return to the block and are joined to its words by position. A word comes to the
    table once per block, however frequent it is, and texts are shuffled once, compressed. Number of blocks and parts follow the bytes counted.

    Null and empty texts have no ids. Null and repeated ids are kept, a row each. Other columns are ignored. An empty table gives
    an empty result. A text has to fit into a row; a model that may join pieces across markers is refused.
    """
    proto = PieceTokenizer.checked(model_bytes(model))
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(parallel, math.ceil(total / block_bytes))
    parts = max(parallel, math.ceil(12 * math.sqrt(blocks)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    texts = given.select(block.alias("block"), "doc_id", _shrunk("text").alias("text")).repartition(blocks, "block")
    lists = texts.mapInPandas(_listed(parts), "block int, part int, words binary")
    table = lists.repartition(parts, "part").mapInPandas(_segmented(proto), "block int, part int, ids binary")
    return texts.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(
        _placed(parts, proto if decoded else None), "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text that the library's `decode` gives for a column of id arrays. Null arrays and null ids in them: as if absent."""
    proto = model_bytes(model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoded = _decoder(proto)
        for ids in batches:
            yield pd.Series([decoded(x) for x in ids], dtype=object)

    return encoded.withColumn(name, text(F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i.isNotNull())))
