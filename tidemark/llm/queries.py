"""Corpus queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    benchmark, bpe, conversations, exact, hyperminhash, jaccard, language, licenses, pages, pseudo_likelihood,
    sharding, spelling, substrings,
)
from tidemark.llm.common import table
from tidemark.llm.registry import query


@query("op8_jump_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharding of all documents over shards 0 to 23 by the law ``key``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents and back."""
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query(
    "op7_extendible_dedup",
    r"""
    WITH plain AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
        FROM documents
    ), ranked AS (
        SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY plain) AS group_size
        FROM plain
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM ranked
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents by the extendible-hash index."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_word_first_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query("op2_license_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query(
    "op1_super_kmer_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS content FROM starts)
              QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents, windows of 20 words."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op9_size_aware_jaccard",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents
    ), places AS (
        SELECT doc_id, ws, unnest(CASE WHEN len(ws) > 4 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w
    ), shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b USING (g) GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
    reached AS (SELECT x AS doc_id, x AS y FROM links UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.y),
    least AS (SELECT doc_id, min(y) AS y FROM reached GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(y, doc_id) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that link by the Jaccard similarity of their shingles."""
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


@query("op4_template_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have an item of the benchmark."""
    return benchmark.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


@query("op6_masked_pseudo_likelihood")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of all documents under a network trained on them."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = pseudo_likelihood.read_vocabulary(docs)
    return pseudo_likelihood.score_documents(docs, vocabulary, pseudo_likelihood.train(docs, vocabulary))


@query("op10_host_suffix_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return pages.extract_text(table(spark, sf_dir, "pages"))


@query("op13_suffix_dawg_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of all conversations after damage."""
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


@query("op12_reduced_alphabet_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the frequent words of all documents."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query(
    "op11_hyperminhash_copies",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents
    ), places AS (
        SELECT doc_id, ws, unnest(CASE WHEN len(ws) > 1 THEN range(1, len(ws)) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w
    ), shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b USING (g) GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
    reached AS (SELECT x AS doc_id, x AS y FROM links UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.y),
    least AS (SELECT doc_id, min(y) AS y FROM reached GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(y, doc_id) AS component_id, coalesce(y, doc_id) = doc_id AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, pairs of words."""
    return hyperminhash.near_copies(table(spark, sf_dir, "documents"))
