"""The named queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .confusables import consistent_texts, look_alike_classes, look_alike_pairs
from .checkpoints import cut
from .language_labels import fit_from_tables, label_languages, wrong_labels
from .main_content import body_lines, fit_lines, latest_rows
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .source_mixing import mix_sources
from .spam_pages import advertising_phrases, profiles, spam_pages
from .splitting import split_oversized
from .term_frequency import marked, text_term_counts, value_term_counts
from .text_statistics import against_distribution, not_prose, quantile_sketches
from .token_stream import decode_ids, encode_texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, folder, "documents"), words=3, threshold=0.6)
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


SQL["p1_found"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id_a, doc_id_b FROM p JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b
WHERE same >= 0.6 * (x.n + y.n - same) - 1e-9
"""


@query
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document that has shingles of five words: its group's size at similarity 0.8, and its number of links to other texts."""
    groups = near_duplicate_groups(table(spark, folder, "documents"))
    sizes = groups.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return groups.join(sizes, "group").select("doc_id", "group_id", "group_size", F.col("links").cast("long").alias("links"))


SQL["p1_groups"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS class FROM s GROUP BY doc_id),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM q JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE same >= 0.8 * (x.n + y.n - same) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
g AS (SELECT a AS doc_id, min(b) AS group_id FROM r GROUP BY a),
l AS (SELECT p.a AS doc_id, count(DISTINCT y.class) AS links FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE x.class <> y.class GROUP BY p.a)
SELECT g.doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, coalesce(links, 0) AS links FROM g LEFT JOIN l USING (doc_id)
"""


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = look_alike_pairs(table(spark, folder, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@query
def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document's text."""
    return consistent_texts(table(spark, folder, "documents"))


@query
def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_classes(table(spark, folder, "documents"))


def _term_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents, info = table(spark, folder, "documents"), table(spark, folder, "count_info")
    texts = marked(text_term_counts(documents), documents.where("text is not null and text <> ''").count())
    values = marked(value_term_counts(info, "doc_id", "count"), info.agg(F.count_distinct("doc_id")).first()[0])
    return texts.withColumn("field", F.lit("text")).unionByName(values.withColumn("field", F.lit("count")))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).where("mark is not null").select("field", "term", "mark")


@query
def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every term of either field."""
    return _term_counts(spark, folder).select("field", "term", "occurrences", "records", "mark")


@query
def p3_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every sequence of one, two and five words of a text, from one suffix array a block."""
    return text_term_counts(table(spark, folder, "documents"), lengths=(1, 2, 5))


_P3 = r"""
WITH t AS (SELECT doc_id AS r, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
c AS (SELECT doc_id AS r, unnest(count)::VARCHAR AS term FROM count_info),
n AS (SELECT 'text' AS field, term, count(*) AS occurrences, count(DISTINCT r) AS records, (SELECT count(*) FROM documents WHERE text <> '') AS total FROM t GROUP BY term
UNION ALL SELECT 'count', term, count(*), count(DISTINCT r), (SELECT count(DISTINCT doc_id) FROM count_info) FROM c WHERE term IS NOT NULL GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * total THEN 'common' END AS mark FROM n)
"""
SQL["p3_found"] = _P3 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL"
SQL["p3_counts"] = _P3 + "SELECT field, term, occurrences, records, mark FROM m"
SQL["p3_phrases"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM w, (SELECT unnest([1, 2, 5])::INT AS n) WHERE len(w) >= n)
SELECT n, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM s GROUP BY n, term
"""


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


@query
def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding the ids gives back each text (empty for null)."""
    documents = table(spark, folder, "documents")
    decoded = decode_ids(encode_texts(documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


SQL["p8_round_trip"] = "SELECT doc_id, true AS same FROM documents"


@query
def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@query
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "split_limits").first()  # one row
    return split_oversized(table(spark, folder, "documents"), limits.max_tokens, limits.overlap_tokens, tokenizer=f"/opt/tokenizers/{limits.tokenizer}.json")


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no = 1").select("doc_id")


@query
def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_from_tables(table(spark, folder, "lang_samples"), table(spark, folder, "common_words"))
    return label_languages(table(spark, folder, "documents"), model)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return wrong_labels(_languages(spark, folder)).select("doc_id", "line_no", "lang")


@query
def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every document, and of its lines in another language."""
    return _languages(spark, folder).select("doc_id", "line_no", "lang", F.round("confidence", 6).alias("confidence"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    info = table(spark, folder, "count_info")
    return body_lines(latest_rows(info, "doc_id", "loaded_at"), fit_lines(info))


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    common: dict[str, set[str]] = {}
    for r in table(spark, folder, "common_words").where("word is not null").collect():  # a fixed table
        common.setdefault(r.lang, set()).add(r.word.lower())
    return profiles(documents, fit_lines(table(spark, folder, "count_info")), advertising_phrases(documents), common)


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(_profiles(spark, folder)).select("doc_id")


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_profiles(spark, folder))
    return against_distribution(rows, quantile_sketches(rows, "language"), "language")


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_prose(_measured(spark, folder)).select("doc_id")


@query
def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document's body, with percentiles and z-scores within its language, and where its language's share of running text divides."""
    return _measured(spark, folder)
