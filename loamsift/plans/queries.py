"""The named queries of the core operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, heuristics, lines, patterns, quality, repetition, sampling
from ..session import shared_folder, table
from ..sources import records
from ..streaming import stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL

WS = T.WS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, {_quoted('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def s_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {_quoted(WS + '+')}), lambda w: w <> '')"


def s_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\n\\r\\t\\x0b\\f\\x00]+'), lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]'))"


def s_replace_punctuation(x: str) -> str:
    one = {a: b for a, b in T.PUNCTUATION.items() if len(b) == 1}
    out = f"translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for a, b in T.PUNCTUATION.items():
        if len(b) > 1:
            out = f"replace({out}, '{a}', '{b}')"
    return out


def s_normalize_data(x: str) -> str:
    return s_replace_punctuation(f"regexp_replace({x}, {_quoted(T.BLANKS)}, ' ', 'g')")


def s_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({s_strip(x)}), '\\p{{Nd}}', '0', 'g'), {_quoted('[' + T.DELETED + ']')}, '', 'g')"


_LINES = "l AS (SELECT doc_id, snapshot, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text <> '')"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def nonempty(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text is not null and text <> ''")


# ---- text functions


@query(f"SELECT doc_id, {s_normalize_data('text')} AS text FROM documents")
def normalize_data(spark, folder):
    return documents(spark, folder).select("doc_id", T.normalize_data(F.col("text")).alias("text"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, {s_key('line')} AS line_key FROM l")
def normalize_for_dedup(spark, folder):
    return lines.explode_lines(documents(spark, folder)).select("doc_id", "line_no", T.normalize_for_dedup(F.col("line")).alias("line_key"))


@query(
    f"SELECT doc_id, {s_replace_punctuation('text')} AS replaced, regexp_replace(text, {_quoted('[' + ''.join(T.PUNCTUATION) + ']')}, '', 'g') AS removed, regexp_replace(text, '[{T.CONTROLS}]', '', 'g') AS printable FROM documents"
)
def punctuation(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", T.replace_punctuation(t).alias("replaced"), T.remove_punctuation(t).alias("removed"), T.remove_controls(t).alias("printable"))


_GENERAL = f"regexp_replace(lower({s_strip('text')}), '\\p{{Nd}}', '0', 'g')"


@query(
    f"SELECT doc_id, regexp_replace({s_replace_punctuation(_GENERAL)}, '[{T.CONTROLS}]', '', 'g') AS replaced, regexp_replace({_GENERAL}, {_quoted('[' + T.DELETED + ']')}, '', 'g') AS removed FROM documents"
)
def normalize_general(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", T.normalize(t, accent=False).alias("replaced"), T.normalize(t, accent=False, punct=2).alias("removed"))


@query("SELECT doc_id, nfc_normalize(strip_accents(nfc_normalize(text))) AS text FROM documents")
def strip_accents(spark, folder):
    """Every document, Hangul and nulls included; composed again, for SQL has no decomposed form of Hangul to compare with."""
    return documents(spark, folder).select("doc_id", T.compose(T.strip_accents(F.col("text"))).alias("text"))


@query()
def strip_accents_all(spark, folder):
    """As the function leaves the texts, Hangul decomposed."""
    return documents(spark, folder).select("doc_id", T.strip_accents(F.col("text")).alias("text"))


def _spacing_sql(x: str, language: str) -> str:
    rules = list(T._SPACING)
    if language == "en":
        rules.append(("re", r'"([,\.]+)', r'$1\\"'))
    else:
        rules += [(',"', '",'), ("re", r'(\.+)"(' + WS + r"*[^<])", r'\\"$1$2')]
    rules.append(("re", r"(\p{Nd}) (\p{Nd})", "$1,$2" if language in ("de", "es", "fr") else "$1.$2"))
    for rule in rules:
        if len(rule) == 3:
            x = f"regexp_replace({x}, {_quoted(rule[1])}, {_quoted(rule[2].replace('$', chr(92)))}, 'g')"
        else:
            a, b = ("chr(13)" if r == "\r" else _quoted(r) for r in rule)
            x = f"replace({x}, {a}, {b})"
    return x


@query(f"SELECT doc_id, {_spacing_sql('text', 'en')} AS en, {_spacing_sql('text', 'de')} AS de, {_spacing_sql('text', 'pt')} AS pt FROM documents")
def spacing_for_tokenizer(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", *(T.spacing_for_tokenizer(t, x).alias(x) for x in ("en", "de", "pt")))


@query(
    f"WITH {_LINES}, h AS (SELECT doc_id, line_no, sha1({s_key('line')}) AS h FROM l) SELECT doc_id, line_no, (list_sum(list_transform(range(0, 8), lambda i: (('0x' || substr(h, 2 * i::INT + 1, 2))::INT)::DECIMAL(38,0) * (1::HUGEINT << (8 * i::INT))::DECIMAL(38,0))))::DECIMAL(20,0) AS k FROM h"
)
def line_hash(spark, folder):
    keyed = lines.explode_lines(documents(spark, folder))
    return keyed.select("doc_id", "line_no", T.line_hash(T.normalize_for_dedup(F.col("line"))).alias("k"))


@query(
    f"WITH {_LINES}, k AS (SELECT doc_id, line_no, {s_key('line')} AS k, count(*) OVER (PARTITION BY doc_id) AS lines FROM l), w AS (SELECT doc_id, line_no, lines, k || chr(10) || lead(k) OVER o || chr(10) || lead(k, 2) OVER o AS k FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)), h AS (SELECT doc_id, line_no, sha1(k) AS h FROM w WHERE line_no + 2 <= lines) SELECT doc_id, line_no, (list_sum(list_transform(range(0, 8), lambda i: (('0x' || substr(h, 2 * i::INT + 1, 2))::INT)::DECIMAL(38,0) * (1::HUGEINT << (8 * i::INT))::DECIMAL(38,0))))::DECIMAL(20,0) AS k FROM h"
)
def span_hash(spark, folder):
    """Hashes of every three lines that follow one another."""
    keys = nonempty(spark, folder).select("doc_id", F.posexplode(T.spans(F.transform(T.lines_of(F.col("text")), T.normalize_for_dedup), 3)).alias("n", "key"))
    return keys.select("doc_id", (F.col("n") + 1).alias("line_no"), T.line_hash(F.col("key")).alias("k"))


@query(
    f"SELECT doc_id, len({s_words('text')}) AS by_space, len(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t\\x0b\\f\\x00]+'), lambda w: w <> '' AND NOT regexp_matches(w, {_quoted('^' + WS + '*' + chr(92) + 'z')}))) AS by_delimiter, len({s_tokens('text')}) AS with_letters FROM documents WHERE text IS NOT NULL"
)
def word_counts(spark, folder):
    t = F.col("text")
    return documents(spark, folder).where("text is not null").select("doc_id", F.size(T.split_words(t)).alias("by_space"), F.size(T.split_words(t, "fasttext")).alias("by_delimiter"), T.token_word_count(t).alias("with_letters"))


@query()
def word_segments(spark, folder):
    """Words between Unicode word boundaries, which SQL does not know."""
    return documents(spark, folder).where("text is not null").select("doc_id", F.posexplode(T.split_words(F.col("text"), "uniseg", ignore_punctuation=True)).alias("word_no", "word"))


@query(
    f"WITH p AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda p: NOT regexp_matches(p, {_quoted('^' + WS + '*' + chr(92) + 'z')}))) AS paragraph, generate_subscripts(list_filter(string_split(text, chr(10) || chr(10)), lambda p: NOT regexp_matches(p, {_quoted('^' + WS + '*' + chr(92) + 'z')})), 1) AS paragraph_no FROM documents) SELECT doc_id, paragraph_no, paragraph FROM p"
)
def paragraphs(spark, folder):
    return documents(spark, folder).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("p", "paragraph")).select("doc_id", (F.col("p") + 1).alias("paragraph_no"), "paragraph")


@query("SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text FROM documents")
def flat_text(spark, folder):
    return documents(spark, folder).select("doc_id", T.flat(F.col("text")).alias("text"))


# ---- lines and their counts


@query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM l")
def line_explode(spark, folder):
    return lines.explode_lines(documents(spark, folder))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS text FROM documents WHERE len(string_split(text, chr(10))) > 1")
def drop_title(spark, folder):
    body = lines.without_title(T.lines_of(F.col("text")))
    return documents(spark, folder).select("doc_id", body.alias("x")).where(F.size("x") > 0).select("doc_id", F.array_join("x", "\n").alias("text"))


_DF = f"WITH {_LINES}, df AS (SELECT snapshot, {s_key('line')} AS line_key, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM l GROUP BY ALL) "


@query(_DF + "SELECT snapshot, line_key, df FROM df")
def line_document_frequency(spark, folder):
    return lines.document_frequency(documents(spark, folder), ["snapshot"])


@query(_DF + "SELECT snapshot, line_key, occurrences FROM df")
def line_occurrences(spark, folder):
    return lines.occurrences(documents(spark, folder), ["snapshot"])


@query(_DF + "SELECT snapshot, line_key, df FROM df WHERE df >= 5")
def df_at_least(spark, folder):
    return lines.at_least(lines.document_frequency(documents(spark, folder), ["snapshot"]), 5)


@query(_DF + "SELECT snapshot, line_key FROM df WHERE df > 1")
def df_seen_before(spark, folder):
    return lines.seen_more_than(lines.document_frequency(documents(spark, folder), ["snapshot"])).select("snapshot", "line_key")


@query(_DF + "SELECT line_key, least(sum(df), 65535)::INT AS df FROM df GROUP BY line_key")
def df_merged(spark, folder):
    return lines.merged(lines.document_frequency(documents(spark, folder), ["snapshot"]), [])


_LATEST = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, count IS NULL, hash(text)) AS rank_ FROM count_info) WHERE rank_ = 1)"


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """count_info with the latest row of each document; an aggregation, so that repeated rows go before the shuffle."""
    rows = table(spark, folder, "count_info")
    rest = [c for c in rows.columns if c != "doc_id"]
    best = F.max_by(F.struct(*rest), F.struct("loaded_at", F.col("count").isNotNull(), F.xxhash64("text")))
    return rows.groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """wet_paths without repeated rows and stray blanks."""
    return table(spark, folder, "wet_paths").select("snapshot", "file_idx", F.trim("wet_path").alias("wet_path")).distinct()


_PATHS = "p AS (SELECT DISTINCT snapshot, file_idx, trim(wet_path) AS wet_path FROM wet_paths)"


@query(
    f"WITH {_LATEST}, {_PATHS}, l AS (SELECT doc_id, p.snapshot, file_idx // 20 AS block, unnest(string_split(text, chr(10))) AS line FROM r JOIN p ON trim(r.wet_path) = p.wet_path WHERE text <> '') SELECT snapshot, block, {s_key('line')} AS line_key, count(DISTINCT doc_id) AS df FROM l GROUP BY ALL"
)
def df_scope_blocks(spark, folder):
    """Lines counted over blocks of consecutive files of a snapshot."""
    files = sampling.scope_blocks(_paths(spark, folder), 20).select("snapshot", "block", "wet_path")
    docs = latest(spark, folder).select("doc_id", F.trim("wet_path").alias("wet_path"), "text").join(files, "wet_path")
    return lines.document_frequency(docs, ["snapshot", "block"])


_COUNTED = (
    _DF.rstrip()
    + f", body AS (SELECT doc_id, snapshot, line_no, line, {s_key('line')} AS line_key FROM l WHERE line_no > 1), j AS (SELECT body.doc_id, body.snapshot, line_no, line, least(coalesce(df, 0), 65535) AS n FROM body LEFT JOIN df ON body.line_key = df.line_key AND body.snapshot = df.snapshot) "
)


@query(_COUNTED + "SELECT doc_id, snapshot, string_agg(line, chr(10) ORDER BY line_no) AS text, string_agg(n::VARCHAR, ',' ORDER BY line_no) AS counts FROM j GROUP BY ALL")
def count_info(spark, folder):
    docs = nonempty(spark, folder)
    out = lines.count_info(docs, lines.document_frequency(docs, ["snapshot"]), ["snapshot"])
    return out.select("doc_id", "snapshot", "text", F.array_join(F.col("count").cast("array<string>"), ",").alias("counts"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE NOT regexp_matches({s_strip('line')}, '[.?!\"'']\\z')) AS removed FROM l GROUP BY doc_id")
def nopunc_lines(spark, folder):
    return lines.explode_lines(documents(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(~lines.ends_in_punctuation(F.col("line"))).alias("removed"))


# ---- line patterns

_ROWS = f"{_LATEST}, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(count) AS n, generate_subscripts(count, 1) AS i FROM r WHERE text <> '' AND len(count) = len(string_split(text, chr(10))))"


def _pld_sql(grid: str, source: str = "l0") -> str:
    """CTEs that end in ``kept`` (e, doc_id, i, line): lines kept for each row e (e, red, green) of the grid."""
    by = "e, doc_id"
    return f"""grid AS ({grid}),
c AS (SELECT e, doc_id, i, line, CASE WHEN {s_strip('line')} IN ('', '{{', '}}') THEN 'y' WHEN coalesce(n, 0) > red THEN 'r' WHEN coalesce(n, 0) > green THEN 'y' ELSE 'g' END AS c FROM {source}, grid),
s AS (SELECT *, CASE WHEN (c = 'g') IS DISTINCT FROM lag(c = 'g') OVER (PARTITION BY {by} ORDER BY i) THEN 1 ELSE 0 END AS new FROM c),
u AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY i) AS run FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY {by}, run) AS size FROM u),
a AS (SELECT *, CASE WHEN c = 'g' AND size >= 2 THEN run END AS anchor FROM n),
b AS (SELECT *, max(anchor) OVER (PARTITION BY {by} ORDER BY i ROWS UNBOUNDED PRECEDING) AS before, min(anchor) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM a),
m AS (SELECT *, max(CASE WHEN c <> 'g' THEN size ELSE 0 END) OVER w AS longest, max(CASE WHEN c = 'r' THEN 1 ELSE 0 END) OVER w AS red_within FROM b WINDOW w AS (PARTITION BY {by}, before, after)),
kept AS (SELECT e, doc_id, i, line FROM m WHERE anchor IS NOT NULL OR (before IS NOT NULL AND after IS NOT NULL AND (red_within = 0 OR longest <= 3)))"""


def _ptf_sql(source: str, k: str) -> str:
    """CTEs that end in ``ended``: lines of the source (e, doc_id, i, line) that the second pattern keeps for the number k of its row."""
    return f"""g AS (SELECT *, regexp_matches({s_strip('line')}, '[.?!"'']\\z') AS g FROM {source}),
o AS (SELECT *, row_number() OVER (PARTITION BY e, doc_id ORDER BY i) AS j FROM g),
q AS (SELECT *, max(CASE WHEN g THEN j END) OVER (PARTITION BY e, doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS pg, min(CASE WHEN g THEN j END) OVER (PARTITION BY e, doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ng FROM o),
ended AS (SELECT e, doc_id, i, line FROM q WHERE g OR (pg IS NOT NULL AND ng IS NOT NULL AND ng - pg - 1 <= {k}))"""


def _joined_sql(source: str) -> str:
    return f"SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM {source} GROUP BY doc_id"


_RED, _GREEN = 1000, 3
_ONE = f"SELECT 1 AS e, {_RED} AS red, {_GREEN} AS green"


@query(f"WITH {_ROWS} SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l0 WHERE coalesce(n, 0) <= 1 GROUP BY doc_id")
def ld(spark, folder):
    return patterns.extracted(patterns.ld(patterns.counted(latest(spark, folder))), "doc_id")


@query(f"WITH {_ROWS}, c AS (SELECT 1 AS e, doc_id, i, line, CASE WHEN coalesce(n, 0) > {_RED} THEN 'r' WHEN coalesce(n, 0) > {_GREEN} THEN 'y' ELSE 'g' END AS c FROM l0), s AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM c), u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM u), m AS (SELECT * FROM z WHERE (c = 'r' AND size >= 3) OR (c = 'y' AND size >= 2)) {_joined_sql('m')}")
def marked_lines(spark, folder):
    """Lines in runs of three red ones or more, or of two yellow ones: patterns of the caller's own."""
    colour = lambda ls, ns: F.array_join(F.transform(ns, lambda n: F.when(F.coalesce(n, F.lit(0)) > _RED, "r").when(F.coalesce(n, F.lit(0)) > _GREEN, "y").otherwise("g")), "")
    return patterns.extracted(patterns.marked_lines(patterns.counted(latest(spark, folder)), colour, "r{3,}", "y{2,}"), "doc_id")


@query(f"WITH {_ROWS}, {_pld_sql(_ONE)} {_joined_sql('kept')}")
def pld(spark, folder):
    return patterns.extracted(patterns.pld(patterns.counted(latest(spark, folder)), _RED, _GREEN), "doc_id")


@query(f"WITH {_LINES}, d AS (SELECT 1 AS e, doc_id, line_no AS i, line FROM l), {_ptf_sql('d', '3')} {_joined_sql('ended')}")
def ptf(spark, folder):
    rows = nonempty(spark, folder).select("doc_id", T.lines_of(F.col("text")).alias("lines"))
    return patterns.extracted(patterns.ptf(rows), "doc_id")


@query(f"WITH {_ROWS}, {_pld_sql(_ONE)}, {_ptf_sql('kept', '3')} {_joined_sql('ended')}")
def pld_ptf(spark, folder):
    return patterns.extracted(patterns.ptf(patterns.pld(patterns.counted(latest(spark, folder)), _RED, _GREEN)), "doc_id")


# The parameters that are compared.
PLD_GRID = ([50, 100, 500, 1000, 2500, 5000], [1, 3, 5])
PTF_GRID = ([50], [3], [1, 3, 5, 7, 10, 15])
_PLD_GRID = f"SELECT 'pld-r' || red || '-g' || green AS e, red, green FROM (SELECT unnest({PLD_GRID[0]}) AS red), (SELECT unnest({PLD_GRID[1]}) AS green)"
_PTF_GRID = f"SELECT 'pld-r50-g3-ptf-' || k AS e, 50 AS red, 3 AS green FROM (SELECT unnest({PTF_GRID[2]}) AS k)"


_DEFAULT = "SELECT 1 AS e, 1000 AS red, 1 AS green"


@query(f"WITH {_ROWS}, {_pld_sql(_DEFAULT)}, {_ptf_sql('kept', '3')} {_joined_sql('ended')}")
def pld_ptf_default(spark, folder):
    """Both patterns as they are set for English: red above 1000 documents, yellow above 1, three lines between."""
    return patterns.extracted(patterns.ptf(patterns.pld(patterns.counted(latest(spark, folder)))), "doc_id")


@query(f"WITH {_ROWS}, {_pld_sql(_PLD_GRID)} SELECT e AS experiment, doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM kept GROUP BY e, doc_id")
def pld_grid(spark, folder):
    rows = patterns.grid(patterns.counted(latest(spark, folder)), *PLD_GRID)
    return patterns.extracted(patterns.pld(rows, F.col("red"), F.col("green")), "experiment", "doc_id")


@query(f"WITH {_ROWS}, {_pld_sql(_PTF_GRID)}, {_ptf_sql('kept', 'string_split(e, ' + chr(39) + '-' + chr(39) + ')[5]::INT')} SELECT e AS experiment, doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM ended GROUP BY e, doc_id")
def ptf_grid(spark, folder):
    rows = patterns.grid(patterns.counted(latest(spark, folder)), *PTF_GRID)
    return patterns.extracted(patterns.ptf(patterns.pld(rows, F.col("red"), F.col("green")), F.col("k")), "experiment", "doc_id")


@query(f"{_COUNTED.rstrip()}, l1 AS (SELECT doc_id, line_no AS i, line, n FROM j), {_pld_sql('SELECT 1 AS e, 20 AS red, 2 AS green', 'l1')}, {_ptf_sql('kept', '3')} {_joined_sql('ended')}")
def extraction(spark, folder):
    """From documents to bodies in one plan: counts over a snapshot, both patterns."""
    from .pipelines import extraction as whole

    return whole(nonempty(spark, folder), ["snapshot"], red=20, green=2).select("doc_id", "text")


@query(SQL["pld_ptf"])
def stream_pld_ptf(spark, folder):
    """pld_ptf as a stream that reads what is there and ends; of the rows of a document the latest is taken from a table built in batch."""
    rows = spark.readStream.schema(table(spark, folder, "count_info").schema).parquet(f"{folder}/count_info.parquet*")
    base = shared_folder(spark)
    out = stages.extracted_stream(rows, ["doc_id", "loaded_at", "count"], _RED, _GREEN)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    newest = latest(spark, folder).select("doc_id", "loaded_at", F.col("count").alias("newest"))
    return done.join(newest, ["doc_id", "loaded_at"]).where(F.col("count") == F.col("newest")).select("doc_id", "text").distinct()


def _stream(spark, folder):
    return spark.readStream.schema(table(spark, folder, "documents").schema).parquet(f"{folder}/documents.parquet*")


@query("WITH l AS (SELECT DISTINCT doc_id, date_trunc('day', crawled_at) AS day, " + s_key("line") + " AS line_key FROM (SELECT doc_id, crawled_at, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> '' AND crawled_at IS NOT NULL)) SELECT strftime(day, '%Y-%m-%d') AS day, line_key, count(*) AS df FROM l GROUP BY ALL")
def stream_line_frequency(spark, folder):
    """Line counts by day of crawl as a stream with state; each batch writes the counts so far."""
    base = shared_folder(spark)
    counts = stages.windowed_frequency(_stream(spark, folder).where("text <> ''").withColumn("crawled_at", F.col("crawled_at").cast("timestamp")), "crawled_at")
    write = lambda df, _: df.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "line_key", "df").write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day string, line_key string, df long").parquet(f"{base}/out")


@query()
def stream_cleaned(spark, folder):
    """Filters and modifiers of one text on a stream, texts normalized."""
    base = shared_folder(spark)
    out = stages.cleaned(_stream(spark, folder)).select("doc_id", "text")
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


# ---- document filters


@query(f"SELECT doc_id, len({s_tokens('text')}) AS words, len({s_tokens('text')}) BETWEEN 50 AND 100000 AS keep FROM documents WHERE text <> ''")
def page_length(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", T.token_word_count(t).alias("words"), heuristics.page_length(t).alias("keep"))


_MEAN = f"(length(regexp_replace(text, {_quoted(WS)}, '', 'g')) / nullif(len({s_words('text')}), 0))"


@query(f"SELECT doc_id, round({_MEAN}, 6) AS mean, coalesce({_MEAN} BETWEEN 3 AND 10, false) AS keep FROM documents WHERE text <> ''")
def word_length(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", F.round(heuristics.mean_word_length(t), 6).alias("mean"), heuristics.word_length(t).alias("keep"))


_SYMBOLS = "((" + " + ".join(f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in heuristics.SYMBOLS) + f") / nullif(len({s_words('text')}), 0))"


@query(f"SELECT doc_id, round({_SYMBOLS}, 6) AS ratio, coalesce({_SYMBOLS} <= 0.1, false) AS keep FROM documents WHERE text <> ''")
def symbol_ratio(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", F.round(heuristics.symbol_ratio_value(t), 6).alias("ratio"), heuristics.symbol_ratio(t).alias("keep"))


_SPLIT = "string_split(text, chr(10))"
_BULLETS = f"len(list_filter({_SPLIT}, lambda x: x[1] IN ('●', '•', '*', '-')))"
_DOTS = f"len(list_filter({_SPLIT}, lambda x: x LIKE '%...' OR x LIKE '%. . .' OR x LIKE '%…'))"


@query(f"SELECT doc_id, round({_BULLETS} / len({_SPLIT}), 6) AS share, {_BULLETS} <= 0.9 * len({_SPLIT}) AS keep FROM documents WHERE text <> ''")
def bullet_ratio(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", F.round(heuristics.bullet_share(t), 6).alias("share"), heuristics.bullet_ratio(t).alias("keep"))


@query(f"SELECT doc_id, round({_DOTS} / len({_SPLIT}), 6) AS share, {_DOTS} <= 0.3 * len({_SPLIT}) AS keep FROM documents WHERE text <> ''")
def ellipsis_ratio(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", F.round(heuristics.ellipsis_share(t), 6).alias("share"), heuristics.ellipsis_ratio(t).alias("keep"))


_ALPHA = f"(len(list_filter({s_words('text')}, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) / nullif(len({s_words('text')}), 0))"


@query(f"SELECT doc_id, round({_ALPHA}, 6) AS share, coalesce({_ALPHA} <= 0.2, false) AS keep FROM documents WHERE text <> ''")
def alphabetic_words(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", F.round(heuristics.non_alphabetic_share(t), 6).alias("share"), heuristics.alphabetic_words(t).alias("keep"))


_STOPS = f"list_filter({s_words('lower(text)')}, lambda x: x IN ({', '.join(map(_quoted, heuristics.STOP_WORDS))}))"


@query(f"SELECT doc_id, len({_STOPS}) AS words, len(list_distinct({_STOPS})) AS different, len({_STOPS}) >= 2 AS keep FROM documents WHERE text <> ''")
def stop_words(spark, folder):
    t = F.col("text")
    return nonempty(spark, folder).select("doc_id", heuristics.stop_word_count(t).alias("words"), heuristics.stop_word_count(t, unique=True).alias("different"), heuristics.stop_words(t).alias("keep"))


# ---- repetition


def _segments_sql(end: str) -> str:
    return f"""s AS (SELECT doc_id, unnest(list_filter(string_split(text, {end}), lambda p: NOT regexp_matches(p, {_quoted('^' + WS + '*' + chr(92) + 'z')}))) AS segment FROM documents WHERE text <> ''),
k AS (SELECT doc_id, segment, count(*) AS n FROM s GROUP BY ALL),
x AS (SELECT doc_id, sum(n)::BIGINT AS segments, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS count_share, sum(CASE WHEN n > 1 THEN n * length(segment) ELSE 0 END) / greatest(sum(n * length(segment)), 1) AS char_share FROM k GROUP BY doc_id)"""


_SHARES = "SELECT doc_id, segments, round(count_share, 6) AS count_share, round(char_share, 6) AS char_share FROM x"


def _segments(spark, folder, end):
    s = repetition.segment_repetition(nonempty(spark, folder), end)
    return s.select("doc_id", "segments", F.round("count_share", 6).alias("count_share"), F.round("char_share", 6).alias("char_share"))


@query(f"WITH {_segments_sql('chr(10)')} {_SHARES}")
def repeated_lines(spark, folder):
    return _segments(spark, folder, "\n")


@query(f"WITH {_segments_sql('chr(10) || chr(10)')} {_SHARES}")
def repeated_paragraphs(spark, folder):
    return _segments(spark, folder, "\n\n")


def _ngram_sql(sizes: list[int]) -> str:
    covered = "CASE n " + " ".join(f"WHEN {n} THEN max(times) OVER (PARTITION BY doc_id, n ORDER BY i ROWS {n - 1} PRECEDING)" for n in sizes) + " END"
    return f"""w AS (SELECT doc_id, list_filter({s_words('text')}, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]')) AS w FROM documents WHERE text <> ''),
v AS (SELECT doc_id, n, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w, (SELECT unnest({sizes}) AS n) WHERE len(w) >= n),
gr AS (SELECT doc_id, n, i, length(word) AS chars, CASE WHEN i + n - 1 <= len(w) THEN array_to_string(w[i:i + n - 1], chr(1)) END AS gram FROM v),
ti AS (SELECT *, CASE WHEN gram IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, n, gram) END AS times FROM gr),
co AS (SELECT *, {covered} AS cover FROM ti),
be AS (SELECT doc_id, n, max(times) AS best, sum(chars) AS chars, sum(CASE WHEN cover > 1 THEN chars ELSE 0 END) AS covered FROM co GROUP BY ALL),
lo AS (SELECT ti.doc_id, ti.n, max(length(replace(gram, chr(1), ''))) AS longest FROM ti JOIN be ON ti.doc_id = be.doc_id AND ti.n = be.n AND times = best GROUP BY ALL),
ng AS (SELECT doc_id, n, CASE WHEN best = 1 THEN 0 WHEN n <= 4 THEN best * longest / greatest(chars, 1) ELSE covered / greatest(chars, 1) END AS share FROM be JOIN lo USING (doc_id, n))"""


@query(f"WITH {_ngram_sql([2, 3, 4])} SELECT doc_id, n, round(share, 6) AS share FROM ng")
def ngram_top(spark, folder):
    return repetition.ngram_repetition(nonempty(spark, folder), [2, 3, 4]).select("doc_id", "n", F.round("share", 6).alias("share"))


@query(f"WITH {_ngram_sql([5, 6, 7, 8, 9, 10])} SELECT doc_id, n, round(share, 6) AS share FROM ng")
def ngram_cover(spark, folder):
    return repetition.ngram_repetition(nonempty(spark, folder), [5, 6, 7, 8, 9, 10]).select("doc_id", "n", F.round("share", 6).alias("share"))


def _renamed(sql: str, tag: str) -> str:
    for name in ("s", "k", "x"):
        sql = sql.replace(f"{name} AS (SELECT", f"{name}{tag} AS (SELECT").replace(f"FROM {name} ", f"FROM {name}{tag} ")
    return sql


_LIMITS = "CASE n " + " ".join(f"WHEN {n} THEN {x}" for n, x in repetition.NGRAM_LIMITS.items()) + " END"
_VERDICT = f"""{_renamed(_segments_sql('chr(10)'), '1')}, {_renamed(_segments_sql('chr(10) || chr(10)'), '2')}, {_ngram_sql(list(range(2, 11)))},
ok AS (SELECT doc_id, segments <= 1 OR (count_share <= 0.3 AND char_share <= 0.2) AS ok FROM x1 UNION ALL SELECT doc_id, segments <= 1 OR (count_share <= 0.3 AND char_share <= 0.2) FROM x2
UNION ALL SELECT doc_id, share <= {_LIMITS} FROM ng UNION ALL SELECT doc_id, coalesce(text, '') <> '' FROM documents),
verdict AS (SELECT doc_id, min(ok) AS passes FROM ok GROUP BY doc_id)"""


@query(f"WITH {_VERDICT} SELECT doc_id, passes FROM verdict")
def repetition_verdict_split(spark, folder):
    """Words at white space, which SQL can express."""
    return repetition.repetition_verdict(documents(spark, folder), word_model="split")


@query()
def repetition_verdict(spark, folder):
    """Words between Unicode word boundaries; tests hold it against counting in Python."""
    return repetition.repetition_verdict(documents(spark, folder))


# ---- modifiers


def _keep_sql(x: str, test: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda x: {test}), chr(10))"


def s_newlines(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def s_upper(x: str) -> str:
    return _keep_sql(x, "x = '' OR (length(x) - length(regexp_replace(x, '\\p{Lu}', '', 'g'))) / length(x) <= 0.5")


def s_numeric(x: str) -> str:
    return _keep_sql(x, f"x = '' OR length(regexp_replace(x, {_quoted('[' + chr(92) + 'p{Nd}' + heuristics.OTHER_DIGITS + ']')}, '', 'g')) / length(x) >= 0.000001")


def s_counter(x: str) -> str:
    return _keep_sql(x, f"NOT regexp_matches(lower(x), {_quoted('^[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]*' + chr(92) + 'p{Nd}(?:,|' + chr(92) + '.|' + chr(92) + 'p{Nd})*(?:k|m|b)?' + WS + '+(?:' + heuristics.COUNTED + ')[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]*' + chr(92) + 'z')})")


def s_short(x: str) -> str:
    return _keep_sql(x, f"x = '' OR len({s_words('x')}) >= 2")


def s_substring(x: str, substring: str, location: str) -> str:
    import re

    found = f"(?:{re.escape(substring)})".replace("\\ ", " ").replace("\\-", "-")
    pattern = {"prefix": f"^{found}{WS}?", "suffix": f"{WS}?{found}\\z", "any": f"{WS}?{found}"}[location]
    new = f"CASE WHEN len({s_words('x')}) <= 10 THEN regexp_replace(x, {_quoted(pattern)}, '', 'gi') ELSE x END"
    stay = f"x = '' OR len({s_words('x')}) > 10 OR NOT regexp_matches(regexp_replace(x, {_quoted(pattern)}, '', 'gi'), {_quoted('^' + WS + '*' + chr(92) + 'z')})"
    return f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda x: {stay}), lambda x: {new}), chr(10))"


def _modifier(name: str, sql: str, f: Callable) -> None:
    def run(spark, folder):
        return documents(spark, folder).select("doc_id", f(F.col("text")).alias("text"))

    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id, {sql} AS text FROM documents"


_modifier("mod_newlines", s_newlines("text"), heuristics.collapse_newlines)
_modifier("mod_uppercase", s_upper("text"), heuristics.drop_uppercase_lines)
_modifier("mod_numeric", s_numeric("text"), heuristics.drop_numeric_lines)
_modifier("mod_counter", s_counter("text"), heuristics.drop_counter_lines)
_modifier("mod_short_lines", s_short("text"), heuristics.drop_short_lines)
for _place, (_s, _at) in enumerate(heuristics.REMOVED, 1):
    _modifier(f"mod_substring_{_at}", s_substring("text", _s, _at), lambda t, s=_s, at=_at: heuristics.remove_substring(t, s, at))

_STEPS = [("m1", s_newlines("text")), ("m2", s_upper("m1")), ("m3", s_numeric("m2")), ("m4", s_counter("m3")), ("m5", s_short("m4"))] + [(f"m{6 + i}", s_substring(f"m{5 + i}", s, at)) for i, (s, at) in enumerate(heuristics.REMOVED)]
_MODIFIED = ", ".join(f"{name} AS (SELECT *, {sql} AS {name} FROM {before})".replace(f"{name} AS (", f"t_{name} AS (", 1) for (name, sql), before in zip(_STEPS, ["passed", *(f"t_{n}" for n, _ in _STEPS)]))


@query(
    f"""WITH {_VERDICT}, passed AS (SELECT d.doc_id, text FROM documents d JOIN verdict v ON d.doc_id = v.doc_id AND passes WHERE text <> '' AND {_BULLETS} <= 0.9 * len({_SPLIT}) AND {_DOTS} <= 0.3 * len({_SPLIT})
AND len({s_tokens('text')}) BETWEEN 50 AND 100000 AND {_MEAN} BETWEEN 3 AND 10 AND {_SYMBOLS} <= 0.1 AND {_ALPHA} <= 0.2 AND len({_STOPS}) >= 2),
{_MODIFIED} SELECT doc_id, m8 AS text FROM t_m8 WHERE (len({s_tokens('text')}) - len({s_tokens('m8')})) / len({s_tokens('text')}) <= 0.05 AND {s_strip('m8')} <> ''"""
)
def heuristics_split(spark, folder):
    return heuristics.heuristics(documents(spark, folder), word_model="split").select("doc_id", "text")


@query()
def heuristics_full(spark, folder):
    """All filters and modifiers, words of the repetition test between Unicode word boundaries."""
    return heuristics.heuristics(documents(spark, folder)).select("doc_id", "text")


_CHEAP = f"{_BULLETS} <= 0.9 * len({_SPLIT}) AND {_DOTS} <= 0.3 * len({_SPLIT}) AND len({s_tokens('text')}) BETWEEN 50 AND 100000 AND {_MEAN} BETWEEN 3 AND 10 AND {_SYMBOLS} <= 0.1 AND {_ALPHA} <= 0.2 AND len({_STOPS}) >= 2"
SQL["stream_cleaned"] = f"WITH passed AS (SELECT doc_id, text FROM documents WHERE text <> '' AND {_CHEAP}), {_MODIFIED} SELECT doc_id, {s_normalize_data('m8')} AS text FROM t_m8 WHERE (len({s_tokens('text')}) - len({s_tokens('m8')})) / len({s_tokens('text')}) <= 0.05"


# ---- removal of what was seen before


def _seen_sql(n: int, least: int = 1) -> str:
    return f"""pa AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL),
pw AS (SELECT doc_id, p, {s_words('part')} AS w FROM pa),
pg AS (SELECT doc_id, p, unnest(list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], chr(1)))) AS gram FROM pw WHERE len(w) >= {least}),
fi AS (SELECT *, min((doc_id, p)) OVER (PARTITION BY gram) AS first FROM pg),
se AS MATERIALIZED (SELECT doc_id, p, count(*) AS ngrams, count(*) FILTER (WHERE first < (doc_id, p)) AS seen FROM fi GROUP BY ALL)"""


@query(f"WITH {_seen_sql(5)} SELECT doc_id, p, ngrams, seen FROM se")
def seen_ngrams(spark, folder):
    return dedup.seen_shares(documents(spark, folder), 5)


@query(
    f"""WITH {_seen_sql(13)}, gone AS (SELECT doc_id, sum(seen) / sum(ngrams) AS share FROM se GROUP BY doc_id),
stay AS (SELECT pa.doc_id, pa.p, part FROM pa LEFT JOIN se ON pa.doc_id = se.doc_id AND pa.p = se.p LEFT JOIN gone ON pa.doc_id = gone.doc_id WHERE NOT coalesce(seen / ngrams > 0.8, false) AND NOT coalesce(share > 0.8, false))
SELECT d.doc_id, string_agg(part, chr(10) ORDER BY p) AS text FROM documents d LEFT JOIN stay USING (doc_id) LEFT JOIN gone USING (doc_id) WHERE NOT coalesce(share > 0.8, false) GROUP BY d.doc_id"""
)
def drop_seen(spark, folder):
    return dedup.drop_seen(documents(spark, folder)).select("doc_id", "text")


@query(
    f"""WITH {_seen_sql(8, 4)}, gone AS (SELECT doc_id, sum(seen) / sum(ngrams) AS share FROM se GROUP BY doc_id) SELECT d.doc_id FROM documents d LEFT JOIN gone USING (doc_id) WHERE NOT coalesce(share > 0.5, false)"""
)
def drop_seen_documents(spark, folder):
    """Only whole documents are removed, by n-grams of four to eight words."""
    return dedup.drop_seen(documents(spark, folder), 8, 0.5, remove="document", least=4).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def drop_exact(spark, folder):
    """The first document of each text."""
    return dedup.drop_seen(documents(spark, folder), remove="exact").select("doc_id")


# ---- languages, scores, statistics


@query("SELECT doc_id, round((length(text) - length(regexp_replace(text, '[가-힣]', '', 'g'))) / length(text), 6) AS share FROM documents WHERE text <> '' AND (length(text) - length(regexp_replace(text, '[가-힣]', '', 'g'))) / length(text) >= 0.1")
def korean_filter(spark, folder):
    return quality.korean(documents(spark, folder)).select("doc_id", F.round(quality.hangul_share(F.col("text")), 6).alias("share"))


_LEXICON = f"""w AS (SELECT doc_id, unnest({s_words("lower(translate(text, chr(10) || chr(13), '  '))")}) AS word FROM documents), t AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN (SELECT DISTINCT lang, word FROM common_words) c USING (word) GROUP BY ALL),
x AS (SELECT doc_id, arg_max(lang, (n, -ascii(lang), -ascii(substr(lang, 2)))) AS lang, max(n) / sum(n) AS score FROM t GROUP BY doc_id)"""


@query(f"WITH {_LEXICON} SELECT doc_id, lang, round(score, 6) AS score FROM x")
def lexicon_language(spark, folder):
    labels = quality.lexicon_language(documents(spark, folder), table(spark, folder, "common_words"))
    return labels.select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(f"WITH {_LEXICON} SELECT doc_id FROM x WHERE lang = 'en' AND score >= 0.65")
def english_filter(spark, folder):
    docs = documents(spark, folder)
    return quality.in_language(docs, quality.lexicon_language(docs, table(spark, folder, "common_words"))).select("doc_id")


_SCORE = f"(len({_STOPS}) / greatest(len({s_words('text')}), 1))"


def _score(text):
    """A stand-in for a model: the share of stop words."""
    return heuristics.stop_word_count(text) / F.greatest(F.size(T.words(text)), F.lit(1))


@query(f"SELECT doc_id, round({_SCORE}, 6) AS fasttext_score FROM documents WHERE text <> '' AND {_SCORE} >= 0.018112")
def quality_threshold(spark, folder):
    return quality.with_quality(documents(spark, folder), _score).select("doc_id", F.round("fasttext_score", 6).alias("fasttext_score"))


@query(
    f"WITH s AS (SELECT host, CASE WHEN text <> '' THEN {_SCORE} END AS score FROM documents) SELECT host, count(*) AS total, count(*) FILTER (WHERE score >= 0.018112) AS kept, count(*) FILTER (WHERE NOT coalesce(score >= 0.018112, false)) AS filtered, round(avg(score) FILTER (WHERE score >= 0.018112), 6) AS avg_score_kept, round(avg(score) FILTER (WHERE score < 0.018112), 6) AS avg_score_filtered FROM s GROUP BY ROLLUP (host)"
)
def file_statistics(spark, folder):
    rows = documents(spark, folder).withColumn("score", F.when(F.col("text") != "", _score(F.col("text"))))
    out = quality.file_statistics(rows, "host", F.col("score") >= 0.018112, F.col("score"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_score_kept", "avg_score_filtered")})


@query()
def curation(spark, folder):
    """Heuristics, removal of what was seen before and the quality threshold in one plan; its SQL is too slow on whole tables, and its steps have SQL of their own."""
    from .pipelines import curation as whole

    out = whole(documents(spark, folder), _score)
    return out.select("doc_id", "text", F.round("fasttext_score", 6).alias("fasttext_score"))


_RECORDS = "r AS (SELECT DISTINCT ON (wet_path, idx) * FROM wet_records ORDER BY wet_path, idx, text NULLS LAST)"
_HANGUL = "(length(text) - length(regexp_replace(text, '[가-힣]', '', 'g'))) / nullif(length(text), 0) >= 0.1"


def _records(spark, folder):
    """wet_records, one row for each place."""
    order = Window.partitionBy("wet_path", "idx").orderBy(F.col("text").asc_nulls_last())
    return table(spark, folder, "wet_records").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@query(f"WITH {_RECORDS} SELECT wet_path, count(*) AS total, count(*) FILTER (WHERE {_HANGUL}) AS count, coalesce(sum(length(text)), 0)::BIGINT AS total_chars, coalesce(sum(length(text)) FILTER (WHERE {_HANGUL}), 0)::BIGINT AS saved_chars FROM r WHERE rec_type = 'conversion' GROUP BY wet_path")
def baseline_statistics(spark, folder):
    rows = records.conversions(_records(spark, folder))
    return quality.baseline_statistics(rows, "wet_path", F.coalesce(quality.hangul_share(F.col("text")) >= 0.1, F.lit(False)))


@query("WITH g AS (SELECT wet_path, idx, max(english) AS english FROM language_log GROUP BY ALL) SELECT wet_path, count(*) AS total, count(*) FILTER (WHERE english = 1) AS english FROM g GROUP BY ROLLUP (wet_path)")
def record_counts(spark, folder):
    """Logged and English records of each file and of all."""
    log = table(spark, folder, "language_log").groupBy("wet_path", "idx").agg(F.max("english").alias("english"))
    return log.rollup("wet_path").agg(F.count("*").alias("total"), F.count_if(F.col("english") == 1).alias("english"))


# ---- files


def _written(spark) -> str:
    return shared_folder(spark)


@query(f"WITH {_RECORDS} SELECT wet_path, row_number() OVER (PARTITION BY wet_path ORDER BY idx) AS idx, rec_type, list_filter(map_entries(headers), lambda e: lower(e.key) = 'warc-target-uri')[1].value AS uri, coalesce(text, '') AS text FROM r")
def wet_archive(spark, folder):
    """Records written as gzipped WET files, one for each path, and read again, numbered as they stand in the file."""
    base = _written(spark)
    rows = _records(spark, folder)
    text = F.coalesce("text", F.lit(""))
    names = F.filter(F.map_entries("headers"), lambda e: ~F.lower(e["key"]).isin("warc-type", "content-length", "test-path"))
    heads = F.array_join(F.transform(names, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    value = F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), "rec_type", F.lit("\r\nTest-Path: "), "wet_path", F.lit("\r\nContent-Length: "), F.octet_length(text), F.when(heads != "", F.concat(F.lit("\r\n"), heads)).otherwise(""), F.lit("\r\n\r\n"), text)
    files = rows.select("wet_path", "idx", F.xxhash64("wet_path").alias("file"), value.alias("value")).repartition("file").sortWithinPartitions("file", "idx").select("file", "value")
    files.write.partitionBy("file").option("compression", "gzip").option("lineSep", "\r\n\r\n").text(base)
    read = records.read_wet(spark, f"{base}/*/*.gz")
    return read.select(records.header(F.col("headers"), "Test-Path").alias("wet_path"), "idx", "rec_type", records.header(F.col("headers"), "WARC-Target-URI").alias("uri"), F.coalesce("text", F.lit("")).alias("text"))


def _json_files(spark, folder) -> str:
    """Documents as JSON lines, and with every tenth of them a line that is none."""
    from ..sources import sinks

    base = _written(spark)
    sinks.write_json_lines(documents(spark, folder).select("doc_id", "text", "host"), f"{base}/good")
    documents(spark, folder).where("doc_id % 10 = 0").select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "text": "broken')).alias("value")).write.option("compression", "gzip").text(f"{base}/bad")
    return base


@query("SELECT doc_id, text, host FROM documents")
def json_lines_tolerant(spark, folder):
    """Malformed lines are passed over."""
    return records.read_json_lines(spark, _json_files(spark, folder), "doc_id long, text string, host string", pattern="*.gz")


@query("SELECT doc_id, text, false AS malformed FROM documents UNION ALL SELECT NULL, NULL, true FROM documents WHERE doc_id % 10 = 0")
def json_lines_flagged(spark, folder):
    """Malformed lines are kept and marked."""
    return records.read_json_lines(spark, _json_files(spark, folder), "doc_id long, text string", mode="flagged", pattern="*.gz")


@query("SELECT doc_id, text FROM documents")
def json_lines_strict(spark, folder):
    """Every line must be an object."""
    return records.read_json_lines(spark, f"{_json_files(spark, folder)}/good", "doc_id long, text string", mode="strict", pattern="*.gz")


@query("SELECT count(*) AS malformed FROM documents WHERE doc_id % 10 = 0")
def json_lines_check(spark, folder):
    """How many lines are no JSON object."""
    return records.all_json(spark.read.option("recursiveFileLookup", "true").text(_json_files(spark, folder)))


@query("SELECT coalesce(host, 'bad') AS host, count(*) AS total, count(*) FILTER (WHERE text <> '') AS kept, count(*) FILTER (WHERE NOT coalesce(text <> '', false)) AS filtered, count(*) FILTER (WHERE bad) AS malformed FROM (SELECT host, text, false AS bad FROM documents UNION ALL SELECT 'bad', NULL, true FROM documents WHERE doc_id % 10 = 0) GROUP BY coalesce(host, 'bad')")
def file_statistics_malformed(spark, folder):
    rows = records.read_json_lines(spark, _json_files(spark, folder), "doc_id long, text string, host string", mode="flagged", pattern="*.gz").withColumn("host", F.coalesce("host", F.lit("bad")))
    return quality.file_statistics(rows, "host", F.coalesce(F.col("text") != "", F.lit(False)), malformed=F.col("malformed")).where("host is not null")


@query(_DF + "SELECT snapshot, line_key, least(df, 65535)::INT AS df FROM df")
def frequency_files(spark, folder):
    """Line counts written by snapshot and read again."""
    from ..sources import sinks

    base = _written(spark)
    maps = lines.document_frequency(documents(spark, folder), ["snapshot"]).withColumn("df", T.saturating(F.col("df")))
    sinks.write_frequency(maps, base, ["snapshot"])
    return spark.read.schema("line_key string, df int, snapshot string").parquet(base)


@query(f"WITH {_PATHS} SELECT wet_path FROM p")
def path_list_file(spark, folder):
    """Paths written as a list, one a line with blanks around, and read again in file order."""
    base = _written(spark)
    _paths(spark, folder).select(F.concat(F.lit(" "), "wet_path", F.lit(" ")).alias("value")).coalesce(1).write.text(base)
    return records.read_list(spark, base, "wet_path").select("wet_path")


@query(f"WITH {_RECORDS} SELECT wet_path, idx, {s_normalize_data('text')} AS text FROM r WHERE rec_type = 'conversion' AND text <> '' AND len({_STOPS}) >= 5")
def english_baseline(spark, folder):
    """The whole step from records to normalized texts in English, told by stop words here."""
    from .pipelines import english_baseline as whole

    return whole(_records(spark, folder), lambda t: heuristics.stop_word_count(t) >= 5).select("wet_path", "idx", "text")


@query(f"WITH {_RECORDS} SELECT wet_path, idx, text FROM r WHERE rec_type = 'conversion' AND {_HANGUL}")
def korean_baseline(spark, folder):
    from .pipelines import korean_baseline as whole

    return whole(_records(spark, folder)).select("wet_path", "idx", "text")


@query(
    f"WITH {_RECORDS}, l AS (SELECT wet_path, idx, unnest(string_split({s_normalize_data('text')}, chr(10))) AS line FROM r WHERE rec_type = 'conversion' AND text <> '' AND len({_STOPS}) >= 5) SELECT wet_path, {s_key('line')} AS line_key, count(DISTINCT idx) AS df FROM l GROUP BY ALL"
)
def archive_frequency(spark, folder):
    """From records to line counts of each file in one plan."""
    from .pipelines import archive_frequency as whole

    return whole(_records(spark, folder), ["wet_path"], lambda t: heuristics.stop_word_count(t) >= 5)


# ---- records and lists


@query(f"WITH {_RECORDS} SELECT wet_path, idx, {s_normalize_data('text')} AS text, array_to_string(list_sort(list_filter(map_keys(headers), lambda k: k <> 'WARC-Identified-Content-Language')), ',') AS names FROM r WHERE rec_type = 'conversion' AND text IS NOT NULL")
def baseline_records(spark, folder):
    rows = records.baseline(_records(spark, folder)).where("text is not null")
    return rows.select("wet_path", "idx", T.normalize_data(F.col("text")).alias("text"), F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("names"))


@query(f"WITH {_RECORDS} SELECT wet_path, idx, list_filter(map_entries(headers), lambda e: lower(e.key) = 'warc-target-uri')[1].value AS uri FROM r")
def record_header(spark, folder):
    return _records(spark, folder).select("wet_path", "idx", records.header(F.col("headers"), "WARC-Target-URI").alias("uri"))


@query(f"WITH {_RECORDS}, g AS (SELECT wet_path, idx FROM language_log GROUP BY ALL HAVING max(english) = 1) SELECT r.wet_path, r.idx FROM r SEMI JOIN g ON r.wet_path = g.wet_path AND r.idx = g.idx WHERE rec_type = 'conversion'")
def english_records(spark, folder):
    """Conversion records that the language log calls English."""
    english = table(spark, folder, "language_log").groupBy("wet_path", "idx").agg(F.max("english").alias("english")).where("english = 1")
    return records.conversions(_records(spark, folder)).join(english, ["wet_path", "idx"], "left_semi").select("wet_path", "idx")


@query(f"WITH {_PATHS} SELECT wet_path, replace(replace(wet_path, 'crawl-data', 'data/extracted/en'), '.warc.wet.gz', '.json.gz') AS target FROM p")
def path_rewrite(spark, folder):
    return _paths(spark, folder).select("wet_path", records.rewritten(F.col("wet_path"), "data/extracted/en").alias("target"))


@query(f"WITH {_PATHS} SELECT wet_path, row_number() OVER (ORDER BY wet_path) - 1 AS idx FROM p")
def all_wet_paths(spark, folder):
    """The files of all snapshots in the order of their paths; a list of files is small."""
    return sampling.numbered(_paths(spark, folder), [], ["wet_path"]).select("wet_path", "idx")


@query(f"WITH {_PATHS} SELECT snapshot, wet_path, file_idx // 7 AS chunk FROM p")
def chunks(spark, folder):
    return sampling.chunks(_paths(spark, folder), 7).select("snapshot", "wet_path", "chunk")


@query(f"WITH {_PATHS} SELECT snapshot, wet_path FROM p WHERE file_idx % 5 = 2")
def shard_of_files(spark, folder):
    """One shard of five, for a cluster that starts a job for each shard."""
    return sampling.shard(_paths(spark, folder), 2, 5).select("snapshot", "wet_path")


def _split_sql(shards: int, pieces: int) -> str:
    return f"""z AS (SELECT *, file_idx // greatest(ceil(count(*) OVER (PARTITION BY snapshot) / {shards * pieces})::BIGINT, 1) AS piece FROM p),
sp AS (SELECT *, CASE WHEN piece >= {(shards - 1) * pieces} THEN 'valid' ELSE 'train' END AS split, (CASE WHEN piece >= {(shards - 1) * pieces} THEN piece - {(shards - 1) * pieces} ELSE piece END)::BIGINT AS shard_idx FROM z)"""


@query(f"WITH {_PATHS}, {_split_sql(10, 2)} SELECT snapshot, wet_path, split, shard_idx FROM sp")
def split_shards(spark, folder):
    """The split over files in list order."""
    placed = _paths(spark, folder).withColumn("place", F.col("file_idx"))
    return sampling.split_shards(placed, ["snapshot"], 10, 2).select("snapshot", "wet_path", "split", "shard_idx")


@query()
def shuffled_split(spark, folder):
    """The split over files in an order drawn from a seed."""
    placed = sampling.shuffled(_paths(spark, folder), ["snapshot"], seed=3)
    return sampling.split_shards(placed, ["snapshot"], 10, 2).select("snapshot", "wet_path", "split", "shard_idx")


@query(f"WITH {_PATHS}, {_split_sql(10, 2)} SELECT snapshot, wet_path, split, shard_idx FROM sp WHERE (split = 'train' AND shard_idx BETWEEN 0 AND 4) OR (split = 'valid' AND shard_idx BETWEEN 0 AND 0)")
def train_slice(spark, folder):
    placed = _paths(spark, folder).withColumn("place", F.col("file_idx"))
    return sampling.sliced(sampling.split_shards(placed, ["snapshot"], 10, 2), (0, 5), (0, 1)).select("snapshot", "wet_path", "split", "shard_idx")


@query(f"WITH {_PATHS} SELECT wet_path FROM p SEMI JOIN (SELECT trim(wet_path) AS wet_path FROM count_info) c USING (wet_path)")
def allowed_files(spark, folder):
    return sampling.allowed(_paths(spark, folder), table(spark, folder, "count_info").select(F.trim("wet_path").alias("wet_path"))).select("wet_path")


@query(f"WITH {_PATHS} SELECT wet_path FROM p ANTI JOIN (SELECT trim(wet_path) AS wet_path FROM wet_records) c USING (wet_path)")
def pending_files(spark, folder):
    return sampling.pending(_paths(spark, folder), table(spark, folder, "wet_records").select(F.trim("wet_path").alias("wet_path"))).select("wet_path")


@query("WITH g AS (SELECT DISTINCT wet_path, idx FROM language_log), n AS (SELECT *, row_number() OVER (PARTITION BY wet_path ORDER BY idx) AS n FROM g) SELECT wet_path, idx FROM n WHERE n <= 3")
def first_records(spark, folder):
    """The first three logged records of each file: the limit of trial runs."""
    return sampling.first_rows(table(spark, folder, "language_log").select("wet_path", "idx").distinct(), "wet_path", "idx", 3)


@query(f"WITH {_PATHS} SELECT * FROM (SELECT snapshot, wet_path FROM p SEMI JOIN snapshots USING (snapshot) UNION SELECT snapshot, trim(wet_path) FROM count_info)")
def all_files(spark, folder):
    """Files that are listed or that documents come from."""
    listed = _paths(spark, folder).join(table(spark, folder, "snapshots"), "snapshot", "left_semi").select("snapshot", "wet_path")
    return listed.union(table(spark, folder, "count_info").select("snapshot", F.trim("wet_path").alias("wet_path"))).distinct()
