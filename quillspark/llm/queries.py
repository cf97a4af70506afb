"""The registered queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, oracles, packed_tokens, pii, secret_ledger, shared, warc

#: The public tokenizers' files, and the end id of the packed format.
BPE_PATH, WORD_PATH, END_ID = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"), 2


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(shared.table(spark, sf_dir, "documents"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(shared.table(spark, sf_dir, "documents"), shared.fresh_dir(spark, "ledger"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_report(shared.table(spark, sf_dir, "documents"), BPE_PATH, byte_bpe.PATTERN)


def op4_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(shared.table(spark, sf_dir, "documents"))


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(shared.table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op7_hamming_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(shared.table(spark, sf_dir, "documents"))


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh_dir(spark, "packed")
    shards = packed_tokens.write(shared.table(spark, sf_dir, "documents"), WORD_PATH, folder, END_ID)
    return packed_tokens.read_report(shards, folder)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(shared.table(spark, sf_dir, "pages"), shared.fresh_dir(spark, "warc"))


QUERIES = {
    f.__name__: f
    for f in (op1_weak_pii, op2_secret_ledger, op3_byte_bpe, op4_stream_exact_dedup, op5_site_lines, op6_decontaminate, op7_hamming_near_dups, op8_packed_tokens, op9_language_id, op10_warc)
}



def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the first query SQL can express: all but the spans that the method adds."""
    return op1_weak_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES["pii_base_spans"] = pii_base_spans

ORACLE = {
    "pii_base_spans": oracles.PII_BASE,
    "op2_secret_ledger": oracles.SECRETS,
    "op7_hamming_near_dups": oracles.NEAR,
    "op5_site_lines": line_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
    "op4_stream_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', '', 'g') AS t
            FROM documents),
        g AS (SELECT t, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -cp, b := doc_id)) AS keep_id FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS win
            FROM (SELECT item, w, least(10, len(w)) AS size, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM bw),
        dw AS (
            SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size)),
        h AS (SELECT doc_id, k, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
        i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id),
        p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS pos FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN i USING (doc_id) LEFT JOIN p USING (doc_id)""",
}
