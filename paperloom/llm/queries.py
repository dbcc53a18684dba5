"""The queries of this folder: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.collocations import collocations
from paperloom.llm.common import table
from paperloom.llm.decontamination import find_leaks
from paperloom.llm.fingerprints import document_fingerprints
from paperloom.llm.jaccard import near_duplicates
from paperloom.llm.language import identify, train, training_sample
from paperloom.llm.licenses import license_sql, scan_licenses
from paperloom.llm.negatives import hard_negatives, labelled
from paperloom.llm.packing import pack_documents
from paperloom.llm.quality import classify
from paperloom.llm.substrings import remove_repeats
from paperloom.llm.token_files import read_token_files, write_token_files
from paperloom.llm.topk import quantised, top_k
from paperloom.llm.warc import WARC_SQL, derivatives, responses
from paperloom.session import fresh_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_sample(docs)))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row carries the next label instead of its own."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled(vectors.withColumn("label", label))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT documents.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id
FROM documents JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY documents.doc_id
"""

SUBSTRING_SQL = """
WITH tokens AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
windows AS (
    SELECT r, first, array_to_string(w[first : first + 34], ' ') AS s
    FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS first FROM tokens WHERE len(w) >= 35)),
repeated AS (SELECT r, first FROM (SELECT r, first, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT DISTINCT r, unnest(generate_series(first, first + 34)) AS p FROM repeated),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM covered GROUP BY r),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY p) AS k
    FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM tokens) ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM tokens LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

TOP_K_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

COLLOCATION_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({ASCII_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (
    SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM words, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND a >= 100),
inner_ AS (
    SELECT lang, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS phrase, a FROM candidates WHERE k > 2),
around AS (SELECT lang, phrase, max(a) AS around FROM inner_ GROUP BY ALL),
cuts AS (
    SELECT lang, phrase, a, w, k, unnest(generate_series(1, k - 1)) AS cut
    FROM candidates LEFT JOIN around USING (lang, phrase) WHERE coalesce(100 * around < 100 * a, TRUE)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n,
           (1000 * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(w[1 : cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(w[cut + 1 : c.k], ' ')
    JOIN totals ON totals.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scores WHERE same) WHERE n <= 5),
fit AS (
    SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fit WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_exact_top_k": TOP_K_SQL,
    "op3_ngram_jaccard_join": JACCARD_SQL,
    "op4_license_scan": license_sql(),
    "op9_substring_dedup": SUBSTRING_SQL,
    "op10_warc_derivatives": WARC_SQL,
    "op11_phrase_collocations": COLLOCATION_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
}
