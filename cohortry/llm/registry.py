"""Registered corpus queries and their SQL answers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import chat
from cohortry.llm.alignment import link_scores
from cohortry.llm.brown import brown_scores
from cohortry.llm.decontaminate import leaks
from cohortry.llm.merkle import folded, leaf_hash, manifest, member_proofs
from cohortry.llm.mixing import mix
from cohortry.llm.pieces import encode
from cohortry.llm.quality import quality_scores
from cohortry.llm.simhash import simhash_groups
from cohortry.llm.suffixes import without_repeats
from cohortry.llm.text import read
from cohortry.llm.topk import top_k
from cohortry.llm.toxicity import toxicity_scores
from cohortry.llm.windows import passage_groups


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op3_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: fixed values: a conversation whose texts hold the template's own control strings
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digest(chat.format_conversations(given.unionByName(own)))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


#: rows sent to a Python worker at once: a batch of the default 10,000 whole texts is too large for small executors
BATCH_ROWS = 1_000


def op9_passage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return passage_groups(read(spark, sf_dir, "documents"))


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(read(spark, sf_dir, "documents"))


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(read(spark, sf_dir, "documents"), model, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    made = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], carry={"shown": F.when(told & F.col("n_chars").isNotNull(), changed)})
    text = lambda digest: F.lower(F.hex(digest))
    found = member_proofs(made).withColumn("end", folded(F.coalesce("shown", "leaf"), "idx", "n", "place", "groups", "proof"))
    return found.select(
        F.col("id").alias("doc_id"), text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform("proof", text), ""), 256).alias("proof_sha256"), text(F.col("end")).alias("folded_root"),
        (F.col("end") == F.col("root")).alias("verified"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return link_scores(read(spark, sf_dir, "documents"), *models)


QUERIES = {
    "op1_repeated_bytes": op1_repeated_bytes,
    "op2_top_vectors": op2_top_vectors,
    "op3_toxicity_scores": op3_toxicity_scores,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_source_mix": op5_source_mix,
    "op6_quality_scores": op6_quality_scores,
    "op7_chat_format": op7_chat_format,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_passage_groups": op9_passage_groups,
    "op10_brown_scores": op10_brown_scores,
    "op11_piece_ids": op11_piece_ids,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_links": op13_token_links,
}

ORACLES: dict[str, str] = {
    "op2_top_vectors": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        ) WHERE rank <= 20
    """,
    "op7_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), joined AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length('<|im_start|>') + length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2'))
                    + length(replace(replace(text, '~', '~0'), '<|', '~1')) + length('<|im_end|>') + 2) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
            formatted_chars::BIGINT AS formatted_chars
        FROM joined
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE codes AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
        ), rows AS (
            SELECT doc_id, coalesce('=' || lang, '') AS k, n_chars,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail,
                coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295::BIGINT) % 7 = 0, false) AS told
            FROM documents, codes
        ), leaf0 AS (
            SELECT doc_id, k, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
                sha256(head || coalesce(strlen((n_chars + told::INT)::VARCHAR) || ':' || (n_chars + told::INT)::VARCHAR, '-') || tail) AS shown
            FROM rows
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM leaf0
        ), tree AS (
            SELECT k, 0 AS level, idx, leaf AS h, n AS width FROM leaves
            UNION ALL
            SELECT k, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(width) + 1) // 2
            FROM tree WHERE width > 1 GROUP BY k, level, idx // 2
        ), subs AS (
            SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS g FROM tree WHERE width = 1
        ), top AS (
            SELECT 0 AS level, place AS idx, subroot AS h, g AS width FROM subs
            UNION ALL
            SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(width) + 1) // 2
            FROM top WHERE width > 1 GROUP BY level, idx // 2
        ), siblings AS (
            SELECT l.k, l.idx, t.level AS step, t.h FROM leaves l JOIN tree t ON t.k = l.k AND t.idx = xor(l.idx >> t.level, 1)
            UNION ALL
            SELECT l.k, l.idx, 100 + p.level, p.h FROM leaves l JOIN subs s ON s.k = l.k JOIN top p ON p.idx = xor(s.place >> p.level, 1)
        ), proofs AS (
            SELECT k, idx, string_agg(h, '' ORDER BY step) AS proof FROM siblings GROUP BY k, idx
        ), folding AS (
            SELECT k, idx, shown AS h, idx AS here, n AS width, 0 AS level FROM leaves
            UNION ALL
            SELECT f.k, f.idx, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.here & 1 = 1 THEN t.h || f.h ELSE f.h || t.h END),
                f.here // 2, (f.width + 1) // 2, f.level + 1
            FROM folding f LEFT JOIN tree t ON t.k = f.k AND t.level = f.level AND t.idx = xor(f.here, 1) WHERE f.width > 1
        ), lifting AS (
            SELECT f.k, f.idx, f.h, s.place AS here, s.g AS width, 0 AS level FROM folding f JOIN subs s ON s.k = f.k WHERE f.width = 1
            UNION ALL
            SELECT f.k, f.idx, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.here & 1 = 1 THEN t.h || f.h ELSE f.h || t.h END),
                f.here // 2, (f.width + 1) // 2, f.level + 1
            FROM lifting f LEFT JOIN top t ON t.level = f.level AND t.idx = xor(f.here, 1) WHERE f.width > 1
        )
        SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaves l JOIN subs s ON s.k = l.k JOIN lifting f ON f.k = l.k AND f.idx = l.idx AND f.width = 1
            CROSS JOIN (SELECT h FROM top WHERE width = 1) r LEFT JOIN proofs p ON p.k = l.k AND p.idx = l.idx
    """,
}
