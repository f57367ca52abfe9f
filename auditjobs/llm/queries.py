"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bit_sliced, byte_bpe, conversation_repair, decontaminate, exact_dedup, hard_negatives, html_extract, lm_score, ngram_join, packing, quality_crf, repeat_removal, toxicity
from ._io import Scratch, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _fold(folds):
    """The remainder of the id's checksum, on which held-out rows are chosen."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _scored(scores, folds, held_out, threshold):
    return scores.select(
        "doc_id",
        F.coalesce(_fold(folds) == held_out, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_lm_score(spark, sf_dir):
    scores = lm_score.stupid_backoff(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op2_lm_score_of_pairs(spark, sf_dir):
    """The same with pairs as the longest n-grams, which its SQL can follow."""
    scores = lm_score.stupid_backoff(table(spark, sf_dir, "documents"), order=2)
    return scores.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _fold(3) != 1)
    return _scored(toxicity.score(docs, model), 3, 1, 0.7)


def op4_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    theta = quality_crf.train(docs, table(spark, sf_dir, "labels"), _fold(5) != 0)
    return _scored(quality_crf.score(docs, theta), 5, 0, 0.3)


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_repeat_removal(spark, sf_dir):
    return repeat_removal.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("rid", "kept_text")


def op8_exact_top_k(spark, sf_dir):
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


def op11_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(turns)
    audits = Scratch(spark).cut(conversation_repair.audit(rows), "audits")
    hashes = conversation_repair.digests(conversation_repair.repaired(rows, audits))
    same = lambda df: F.col("c.conv_id").eqNullSafe(F.col(f"{df}.conv_id"))
    joined = turns.select(F.col("conv_id").cast("long")).distinct().alias("c").join(audits.alias("a"), same("a"), "left").join(hashes.alias("h"), same("h"), "left")
    zero = lambda c: F.coalesce(f"a.{c}", F.lit(0)).cast("long").alias(c)
    return joined.select(
        "c.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("a.audit", F.lit("")).alias("audit"),
        F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_hard_negatives(spark, sf_dir):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_lm_score": op2_lm_score,
    "op2_lm_score_of_pairs": op2_lm_score_of_pairs,
    "op3_toxicity": op3_toxicity,
    "op4_quality_crf": op4_quality_crf,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_extraction": op6_html_extraction,
    "op7_repeat_removal": op7_repeat_removal,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL = {
    "op2_lm_score_of_pairs": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), o AS (
            SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
        ), n1 AS (SELECT word, count(*) AS c1 FROM o GROUP BY word),
        n2 AS (SELECT before, word, count(*) AS c2 FROM o WHERE before IS NOT NULL GROUP BY before, word),
        s AS (
            SELECT o.doc_id, CASE
                WHEN o.before IS NULL THEN ln(a.c1 / t.n)
                WHEN n2.c2 >= 2 THEN ln(n2.c2 / b.c1)
                ELSE ln(0.4) + ln(a.c1 / t.n) END AS x
            FROM o CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM o) t
            JOIN n1 a ON a.word = o.word LEFT JOIN n1 b ON b.word = o.before
            LEFT JOIN n2 ON n2.before = o.before AND n2.word = o.word
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(r.x, 0.0), 3) AS log_score
        FROM d LEFT JOIN (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id) r USING (doc_id)""",
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id
            WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
               p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op13_decontamination": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), i AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark
        ), g AS (
            SELECT DISTINCT item, w[p : p + 9] AS win, CAST(least(10, len(w)) AS BIGINT) AS n
            FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)
        ), o AS (
            SELECT r, p, k.n, w[p : p + k.n - 1] AS win
            FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) x CROSS JOIN (SELECT DISTINCT n FROM g) k
            WHERE p + k.n - 1 <= len(w)
        ), h AS (SELECT o.r, o.p, o.n, g.item FROM o JOIN g ON g.n = o.n AND g.win = o.win),
        hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
}
