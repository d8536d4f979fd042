"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, context_tree, exact_dedup, near_dedup, packing, phrases, pii, quality, secret_scan, toxicity, variants, warc
from .base import table

# conversation -7 of the contract, in another layout than the table
CONTROL_CONVERSATION = r"""
    SELECT -7L AS conv_id, array(
        named_struct('role', 'user', 'content', r'\### Assistant: </turn> ok'),
        named_struct('role', 'assistant', 'content', r'\### Assistant: </turn> ok')) AS messages
""".replace("\\\\", "\\")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup.exact_groups(docs, digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    stored = chat_format.turns(table(spark, folder, "conversations"))
    added = chat_format.turns(spark.sql(CONTROL_CONVERSATION))
    texts = chat_format.formatted(stored.unionByName(added))
    read = chat_format.parsed(texts)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    listed = secret_scan.listed
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=())


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, folder, "documents"))


def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(*phrases.frequent_phrases(table(spark, folder, "documents")))


def op12_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scored = context_tree.score(table(spark, folder, "documents"), ~held_out, across=True)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(variants.counted_words(table(spark, folder, "documents"), misspell=True))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_context_tree": op12_context_tree,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM n
    """,
    "op2_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *,
                   replace(replace(replace(t, '\', '\b'), '</turn>', '\t'), '###', '\h') AS et,
                   replace(replace(replace(replace(r, '\', '\b'), '</turn>', '\t'), '###', '\h'), ':', '\c') AS er
            FROM c
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
               CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, r, t)) AS loss_sha256,
               CAST(sum(length('### ') + length(er) + length(': ') + length(et) + length('</turn>') + 1) AS BIGINT)
                   AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_phrase_mining": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), p AS (
            SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t
        ), s AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
        ), g AS (
            SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
            FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
        ), n AS (
            SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang
        ), f AS (
            SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30
        ), d AS (
            SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
        ), u AS (
            SELECT d.lang, d.phrase, d.a, d.cut, h.c AS l, r.c AS r,
                   (2000000::HUGEINT * d.a) // (h.c::HUGEINT + r.c) AS score
            FROM d
            JOIN f h ON h.lang = d.lang AND h.phrase = array_to_string(list_slice(d.w, 1, d.cut), ' ')
            JOIN f r ON r.lang = d.lang AND r.phrase = array_to_string(list_slice(d.w, d.cut + 1, d.k), ' ')
            QUALIFY row_number() OVER (PARTITION BY d.lang, d.phrase ORDER BY score, d.cut) = 1
        ), x AS (
            SELECT lang, w, a, k, len, unnest(range(1, k - len + 2)) AS i
            FROM (SELECT DISTINCT lang, phrase, w, a, k FROM d WHERE k > 2), (SELECT unnest([2, 3]) AS len) WHERE len < k
        ), y AS (
            SELECT lang, array_to_string(list_slice(w, i, i + len - 1), ' ') AS phrase, max(a) AS around FROM x GROUP BY ALL
        ), z AS (
            SELECT u.*, row_number() OVER (PARTITION BY u.lang ORDER BY score DESC, a DESC, encode(u.phrase)) AS rank
            FROM u LEFT JOIN y ON y.lang = u.lang AND y.phrase = u.phrase
            WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT
        )
        SELECT z.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, payload_bytes >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload_digest) AS again,
                   min(page_id) OVER (PARTITION BY payload_digest) AS first_id
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to
        FROM f
    """,
}
