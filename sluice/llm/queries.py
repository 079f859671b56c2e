"""The registered queries of these operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import bpe, exact, language, licenses, manifest, packing, pages, private, quality, repeats, sharding, similar, whitening
from sluice.llm.shared import documents, numbered
from sluice.session import configure

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# Documents per Arrow batch: texts are read whole, so a batch must stay small.
BATCH_ROWS = "512"
# Blocks of op1 are rows of some megabytes, so few of them may go to a worker at a time.
BLOCK_BYTES = "4m"
# The session setting that holds the secret key of surrogates, and the key for test data where it is unset.
KEY_SETTING, TEST_KEY = "spark.sluice.surrogateKey", "surrogate key"


def ready(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(ready(spark), sf_dir)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BLOCK_BYTES)
    return bpe.encoded(docs, BYTE_RANKS)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.linked(documents(ready(spark), sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = numbered(documents(ready(spark), sf_dir).select("doc_id", "text"), "radix-input")
    return exact.exact_groups(table).drop("_rid")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned_licenses(documents(ready(spark), sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(ready(spark), sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(ready(spark), sf_dir), WORD_TOKENIZER)


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(ready(spark), sf_dir).select("doc_id", "text")
    return private.replaced(rows, surrogate_key(spark), count_column="n_replaced")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(documents(ready(spark), sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(ready(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(ready(spark), sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats_removed(documents(ready(spark), sf_dir), keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.manifest(documents(ready(spark), sf_dir), {"text": text})


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_ngram_jaccard, op3_exact_dedup, op4_license_scan, op5_language_id, op6_packing, op7_private_data, op8_sharding,
    op9_html_extraction, op10_quality_rules, op11_embedding_whitening, op12_repeated_passages, op13_merkle_manifest)}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        ), ranked AS (
            SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY bare) AS group_size
            FROM plain
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked""",
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
        ), tokens AS (
          SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
          SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id FROM sets""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE plain AS (
          SELECT doc_id, coalesce('s' || source, 'n') AS tree, text,
                 concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                 -- crc32 bit by bit: each byte is taken in, then eight steps follow; the result is inverted, so 2 divides it where this ends in 1
                 list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda c: [ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
                   lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END) & 1 = 1 AS touched
          FROM documents
        ), hashed AS (
          SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 sha256(head || CASE WHEN text IS NULL THEN '-' WHEN touched THEN strlen(replace(text, E'\n', '')) || ':' || replace(text, E'\n', '')
                                     ELSE strlen(text) || ':' || text END) AS found FROM plain
        ), leaves AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed
        ), lower AS (
          SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
          UNION ALL
          SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM lower WHERE n > 1 GROUP BY tree, level, idx // 3, n
        ), roots AS (
          SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lower WHERE n = 1
        ), upper AS (
          SELECT 0 AS level, idx, digest, n FROM roots
          UNION ALL
          SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, idx // 3, n
        ), nodes AS (
          SELECT tree, level, idx, digest, n FROM lower UNION ALL SELECT '', level, idx, digest, n FROM upper
        ), siblings AS (
          SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
                 coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx
        ), fold AS (
          SELECT tree AS own, idx AS leaf_idx, tree, 0 AS level, idx, found AS now, '' AS proof FROM leaves
          UNION ALL
          SELECT * FROM (
            SELECT own, leaf_idx, f.tree, f.level + 1, f.idx // 3, sha256(before || now || after), proof || before || after
            FROM fold f JOIN siblings s ON f.tree = s.tree AND f.level = s.level AND f.idx = s.idx
            UNION ALL
            -- at the root of a source the way goes on in the tree over all
            SELECT own, leaf_idx, '', 0, r.idx, now, proof FROM fold f JOIN lower l ON f.tree = l.tree AND f.level = l.level AND l.n = 1 JOIN roots r ON r.tree = f.tree)
        )
        SELECT doc_id, leaf, r.digest AS subroot, u.digest AS root, sha256(f.proof) AS proof_sha256, f.now AS folded_root, f.now = u.digest AS verified
        FROM leaves l JOIN roots r USING (tree) JOIN upper u ON u.n = 1 JOIN fold f ON f.own = l.tree AND f.leaf_idx = l.idx AND f.tree = '' AND f.level = u.level""",
}
