"""Hash-chained log: append in order per chain, verify in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortry.operators.ordered import RANGE, accumulate, cut_ranges

ANCHOR = "signed_root"


def body(chain: str = "chain_id", ts: str = "ts", payload: str = "payload") -> Column:
    """Canonical JSON of the entry: keys in order, no spaces.  The payload is a struct with sorted fields or a scalar."""
    return F.to_json(F.struct(F.col(chain).alias("chain_id"), F.col(payload).alias("payload"), F.col(ts).alias("ts")),
                     {"ignoreNullFields": "false"})


def append(df: DataFrame, *, chain: str = "chain_id", seq: str = "seq", ts: str = "ts", payload: str = "payload",
           anchor: str = ANCHOR) -> DataFrame:
    """Adds body, prev_hash and hash.

    A chain is sequential by definition; tasks stream their sorted rows and hold one chain head, whatever the length.
    """
    rows = df.withColumn("body", body(chain, ts, payload)).withColumn("prev_hash", F.lit("")).withColumn("hash", F.lit(""))
    rows = rows.withColumn("_chain", F.col(chain).cast("string"))
    ordered = rows.repartition(F.col("_chain")).sortWithinPartitions("_chain", seq)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, head = None, anchor
        for pdf in batches:
            before, after = [], []
            for ident, text in zip(pdf["_chain"], pdf["body"]):
                if ident != current:
                    current, head = ident, anchor
                before.append(head)
                head = hashlib.sha256((head + text).encode("utf-8")).hexdigest()
                after.append(head)
            yield pdf.assign(prev_hash=before, hash=after)

    return ordered.mapInPandas(link, ordered.schema).drop("_chain")


def verify(log: DataFrame, *, chain: str = "chain_id", seq: str = "seq", anchor: str = ANCHOR,
           rows_per_range: int | None = None) -> DataFrame:
    """Per row whether the hash recomputes and the link to the predecessor holds.

    Every row is checked against its predecessor's stored hash, so long chains are checked in parallel.
    """
    ranged = cut_ranges(log, [chain], [seq], rows_per_range=rows_per_range)
    held = accumulate(ranged, {"_before": ("last", F.col("hash"))}, exclusive=True).rows.drop(RANGE)
    expected = F.coalesce("_before", F.lit(anchor))
    recomputed = F.sha2(F.concat(F.col("prev_hash"), F.col("body")), 256)
    return held.withColumn("intact", (F.col("prev_hash") == expected) & (F.col("hash") == recomputed)).drop("_before")


def chain_status(checked: DataFrame, *, chain: str = "chain_id", seq: str = "seq") -> DataFrame:
    """Entries, validity and first broken position per chain."""
    return checked.groupBy(chain).agg(F.count(F.lit(1)).alias("entries"), F.bool_and("intact").alias("valid"),
                                      F.min(F.when(~F.col("intact"), F.col(seq))).alias("first_break"))


OUTPUT = "chain_id string, seq bigint, body string, prev_hash string, hash string"


def append_stream(stream: DataFrame, *, chain: str = "chain_id", seq: str = "seq", ts: str = "ts", payload: str = "payload",
                  anchor: str = ANCHOR) -> DataFrame:
    """Streaming append: the head of each chain is keyed state.  A chain's rows of one batch are one task's work."""
    def link(ident, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else anchor
        seqs, bodies = [], []
        for pdf in batches:
            seqs += pdf["seq"].tolist()
            bodies += pdf["body"].tolist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        for low in range(0, len(order), 10_000):
            before, after, part = [], [], order[low:low + 10_000]
            for i in part:
                before.append(head)
                head = hashlib.sha256((head + bodies[i]).encode("utf-8")).hexdigest()
                after.append(head)
            yield pd.DataFrame({"chain_id": ident[0], "seq": [seqs[i] for i in part], "body": [bodies[i] for i in part], "prev_hash": before, "hash": after})
        state.update((head,))

    slim = stream.select(F.col(chain).cast("string").alias("chain_id"), F.col(seq).cast("bigint").alias("seq"), body(chain, ts, payload).alias("body"))
    return slim.groupBy("chain_id").applyInPandasWithState(link, OUTPUT, "head string", "append", GroupStateTimeout.NoTimeout)
