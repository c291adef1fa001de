"""The registered queries over whole tables, each beside the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import style as S
from ..functions import text as T
from ..operators import annotate as A
from ..operators import dictionary as D
from ..operators import islands as I
from ..operators import layout as L
from ..operators import search as X
from ..operators import trees as TR
from ..sources import markup as M
from . import dsl
from .pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


_PUNCT = T.PUNCT.replace("'", "''")
_WORDS = f"(SELECT * FROM (SELECT doc_id, lang, source, unnest(string_split(text, ' ')) AS word FROM documents) WHERE NOT contains('{_PUNCT}', word))"
_SENT = "(SELECT * FROM (SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents WHERE text <> '') WHERE sentence <> '')"
_LINES = "(SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"
_TERMS = [("en", "the"), ("en", "that"), ("en", "with"), ("fr", "les"), ("fr", "des"), ("de", "die"), ("de", "und"), ("es", "las"), ("es", "que"), ("fr", "que"), ("en", "of the"), ("en", "was and"), ("de", "die der")]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TERMS) + ") t(dictionary, term)"
_ISLAND = "rows between unbounded preceding and current row"


def terms(spark: SparkSession) -> DataFrame:
    return rows(spark, "dictionary string, term string", *_TERMS)


def words(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return X.word_rows(table(spark, d, "documents"), *keys)


# --- search -----------------------------------------------------------------


@query(f"SELECT dictionary, lower(word) AS match, count(*) AS n FROM {_WORDS} JOIN {_TERMS_SQL} ON lower(word) = term GROUP BY ALL HAVING count(*) >= 2")
def dict_match_words(spark, d):
    return X.count_matches(X.match_words(words(spark, d), terms(spark)), "dictionary", least=2)


@query(f"SELECT dictionary, term AS match, count(*) AS n FROM {_SENT} JOIN {_TERMS_SQL} ON contains(lower(sentence), term) WHERE contains(term, ' ') GROUP BY ALL")
def dict_match_phrases(spark, d):
    s = X.sentence_rows(table(spark, d, "documents"), "doc_id")
    return X.count_matches(X.match_phrases(s, terms(spark).filter(F.contains("term", F.lit(" ")))), "dictionary")


@query(f"SELECT source, lang, dictionary, count(*) AS n FROM {_WORDS} JOIN {_TERMS_SQL} ON lower(word) = term GROUP BY ALL")
def dict_match_per_section(spark, d):
    return X.match_words(words(spark, d, "source", "lang"), terms(spark)).groupBy("source", "lang", "dictionary").agg(F.count("*").alias("n"))


@query(f"SELECT source, " + ", ".join(f"coalesce(string_agg(match, ' | ' ORDER BY match) FILTER (dictionary = '{k}'), '') AS {k}" for k in ("en", "fr", "de", "es")) + f" FROM (SELECT DISTINCT source, dictionary, term AS match FROM {_WORDS} JOIN {_TERMS_SQL} ON lower(word) = term) GROUP BY source")
def section_dict_pivot(spark, d):
    return X.section_pivot(X.match_words(words(spark, d, "source"), terms(spark)), "source", ["en", "fr", "de", "es"])


@query(f"SELECT t.dictionary, coalesce(n, 0) AS n FROM (SELECT DISTINCT dictionary FROM (SELECT * FROM {_TERMS_SQL} UNION ALL SELECT 'none', 'zzzzzz')) t LEFT JOIN (SELECT dictionary, count(*) AS n FROM {_WORDS} JOIN {_TERMS_SQL} ON lower(word) = term GROUP BY 1) USING (dictionary)")
def dict_tools_with_zero(spark, d):
    tools = terms(spark).unionByName(rows(spark, "dictionary string, term string", ("none", "zzzzzz")))
    return X.with_empty_tools(X.count_matches(X.match_words(words(spark, d), tools), "dictionary"), tools)


@query(f"SELECT lang, match, n, rank FROM (SELECT lang, word AS match, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM {_WORDS} GROUP BY lang, word) WHERE rank <= 5")
def top_terms_per_language(spark, d):
    return X.top(X.count_matches(words(spark, d, "lang").withColumnRenamed("word", "match"), "lang"), 5, "n", "lang")


@query(f"SELECT word AS match, count(*) AS n FROM {_WORDS} GROUP BY word ORDER BY n DESC, word LIMIT 50")
def corpus_top50_words(spark, d):
    return X.top(X.count_matches(words(spark, d).withColumnRenamed("word", "match")), 50)


@query(f"SELECT lang, count(*) AS n FROM {_WORDS} WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') AND lower(word) NOT IN (SELECT lower(n_name) FROM nation UNION ALL SELECT unnest(['the', 'and', 'der', 'les'])) GROUP BY lang")
def stopword_anti_join(spark, d):
    stop = table(spark, d, "nation").select(F.col("n_name").alias("word")).unionByName(rows(spark, "word string", ("the",), ("and",), ("der",), ("les",)))
    return X.filter_words(words(spark, d, "lang"), stop=stop).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n FROM {_WORDS} WHERE word = upper(word) AND word <> lower(word) GROUP BY lang")
def pattern_all_caps(spark, d):
    return X.match_pattern(words(spark, d, "lang"), "_ALLCAPS").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT word AS match, count(*) AS n FROM {_WORDS} WHERE regexp_full_match(word, '[0-9]+') GROUP BY 1")
def pattern_number(spark, d):
    return X.count_matches(X.match_pattern(words(spark, d), "_NUMBER").withColumnRenamed("word", "match"))


@query(f"SELECT word AS match, count(*) AS n FROM {_WORDS} WHERE regexp_matches(word, '^(?:[Tt]h[ae])') GROUP BY 1 HAVING count(*) >= 10")
def pattern_regex(spark, d):
    return X.count_matches(X.match_pattern(words(spark, d), "_REGEX", "[Tt]h[ae]").withColumnRenamed("word", "match"), least=10)


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def filter_contains_keep(spark, d):
    return X.filter_files(table(spark, d, "documents"), F.contains("text", F.lit("License"))).select("doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE NOT contains(text, 'License') GROUP BY lang")
def filter_contains_drop(spark, d):
    return X.filter_files(table(spark, d, "documents"), F.contains("text", F.lit("License")), keep=False).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS n FROM {_WORDS} WHERE lower(word) IN (SELECT term FROM {_TERMS_SQL}) GROUP BY source")
def hits_dictionary_semi(spark, d):
    hits = words(spark, d, "source").withColumnRenamed("word", "match")
    return X.keep_hits_in_dictionary(hits, terms(spark)).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(text, '^(?:The )') THEN 'The ' WHEN regexp_matches(text, '^(?:[A-Z]{2})') THEN '[A-Z]{2}' WHEN regexp_matches(text, '^(?:[A-Z][a-z]+ed)') THEN '[A-Z][a-z]+ed' END AS pattern, count(*) AS n FROM documents GROUP BY 1")
def first_matching_regex(spark, d):
    return table(spark, d, "documents").groupBy(T.first_matching(F.col("text"), ["The ", "[A-Z]{2}", "[A-Z][a-z]+ed"]).alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE (turn >= 1 AND turn < 3) OR (turn >= 5 AND turn < 9)")
def page_range_filter(spark, d):
    return table(spark, d, "conversations").filter(T.in_ranges(F.col("turn"), [(1, 3), (5, 9)])).select("conv_id", "turn")


@query(f"SELECT doc_id, pos, dictionary, match, before, after FROM (SELECT doc_id, pos, word, lag(word) OVER w AS before, lead(word) OVER w AS after FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) WHERE NOT contains('{_PUNCT}', word)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) JOIN (SELECT dictionary, term AS match FROM {_TERMS_SQL} WHERE dictionary IN ('es', 'de')) ON lower(word) = match")
def concordance_lag_lead(spark, d):
    return X.concordance(table(spark, d, "documents"), terms(spark).filter("dictionary IN ('es', 'de')"), "doc_id")


@query(f"SELECT source, tool, kind, match, count(*) AS n FROM (SELECT source, dictionary AS tool, 'dictionary' AS kind, lower(word) AS match FROM {_WORDS} JOIN {_TERMS_SQL} ON lower(word) = term UNION ALL SELECT source, dictionary, 'dictionary', term FROM {_SENT} JOIN {_TERMS_SQL} ON contains(lower(sentence), term) WHERE contains(term, ' ') UNION ALL SELECT source, 'caps', 'pattern', word FROM {_WORDS} WHERE word = upper(word) AND word <> lower(word)) GROUP BY ALL")
def search_all_facets(spark, d):
    docs = table(spark, d, "documents")
    return X.search(docs, terms(spark), {"caps": ("_ALLCAPS", "")}, keys=("source",))


# --- text -------------------------------------------------------------------


@query(f"SELECT doc_id, n, line FROM {_LINES}")
def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line"))


@query(f"SELECT doc_id, count(*) AS paragraphs, sum(k)::BIGINT AS lines FROM (SELECT doc_id, g, count(line) FILTER (line <> '') AS k FROM (SELECT doc_id, n, rtrim(line, ' ' || chr(9) || chr(13)) AS line, sum(CASE WHEN rtrim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n {_ISLAND}) AS g FROM {_LINES}) GROUP BY doc_id, g) GROUP BY doc_id")
def paragraphs_split(spark, d):
    p = T.paragraphs(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(p).alias("paragraphs"), F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + F.size(x)).alias("lines"))


@query("SELECT doc_id, count(*) AS n, max(length(sentence)) AS longest FROM " + _SENT + " GROUP BY doc_id")
def sentence_counts(spark, d):
    s = X.sentence_rows(table(spark, d, "documents"), "doc_id")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).alias("longest"))


@query("SELECT doc_id, (p - 1) || ': ' || s AS line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS p FROM documents WHERE text <> '') WHERE s <> ''")
def numbered_sentences(spark, d):
    s = X.sentence_rows(table(spark, d, "documents"), "doc_id")
    return s.select("doc_id", T.numbered(F.col("sent_no"), F.col("sentence")).alias("line"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS h FROM documents")
def strip_non_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_non_ascii(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(translate(text, '.,;:|', '_____')) AS h FROM documents")
def translate_punct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.translate_all(F.col("text"), ".,;:|")).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^A-Za-z0-9\\s]', '', 'g')) AS h, md5(regexp_replace(text, '[^A-Za-z\\s]', '', 'g')) AS letters FROM documents")
def remove_punctuation(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_punctuation(t)).alias("h"), F.md5(T.strip_punctuation(t, digits=True)).alias("letters"))


@query("SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 24) AS name FROM pages")
def flatten_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.flatten_name(F.col("url"), 24).alias("name"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS base FROM pages")
def url_basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("base"))


@query("SELECT i, CASE WHEN i >= 256 THEN '@.' || i ELSE (CASE WHEN i >= 26 THEN chr((96 + i // 26)::INT) ELSE '' END) || chr((97 + i % 26)::INT) END AS letters FROM (SELECT unnest(range(0, 300)) AS i)")
def letter_ids(spark, d):
    return spark.range(300).select(F.col("id").alias("i"), T.letter_id(F.col("id")).alias("letters"))


@query("SELECT doc_id, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits, len(regexp_extract_all(text, '\\d+')) AS matches, length(text) AS chars FROM documents")
def split_matches(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.explode_outer(T.split_matches(F.col("text"), r"\d+")).alias("p"))
    hit = F.col("p.kind") == "re_match"
    size = F.coalesce(F.length("p.piece"), F.lit(0))
    return pieces.groupBy("doc_id").agg(F.sum(F.when(hit, size).otherwise(0)).alias("digits"), F.count_if(hit).alias("matches"), F.sum(size).alias("chars"))


# --- HTML -------------------------------------------------------------------


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def html_hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(M.hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", M.title(F.col("html")).alias("title"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY tag")
def tag_counts(spark, d):
    return table(spark, d, "pages").select(F.explode(M.tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""SELECT suffix, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) JOIN (VALUES ('html'), ('er'), ('en')) s(suffix) ON href LIKE '%' || suffix GROUP BY suffix""")
def hrefs_by_suffix(spark, d):
    refs = table(spark, d, "pages").select(F.explode(M.hrefs(F.col("html"))).alias("href"))
    kinds = F.array(*[F.when(F.endswith("href", F.lit(s)), F.lit(s)) for s in ("html", "er", "en")])
    return refs.select(F.explode(F.array_compact(kinds)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT page_id AS t_id, '/' || list_extract(string_split(split_part(split_part(url, '?', 1), '#', 1), '/'), -1) AS t_path, url FROM pages), a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS link FROM pages) SELECT a.page_id, count(*) AS links, count(t.t_id) AS resolved FROM a LEFT JOIN (SELECT t_path, min(t_id) AS t_id FROM u GROUP BY 1) t ON a.link = t.t_path GROUP BY a.page_id""")
def link_resolution(spark, d):
    pages = table(spark, d, "pages")
    path = F.concat(F.lit("/"), T.basename(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))))
    targets = pages.groupBy(path.alias("t_id")).agg(F.min("page_id").alias("t_page"))
    links = pages.select("page_id", F.explode(M.hrefs(F.col("html"))).alias("link"))
    return links.join(targets, F.col("link") == F.col("t_id"), "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count("t_page").alias("resolved"))


# --- windows ----------------------------------------------------------------


@query("WITH t AS (SELECT user_id, ts AS top, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase') SELECT e.event_id, max(t.top) AS top FROM events e LEFT JOIN t ON t.user_id = e.user_id AND t.top <= e.ts AND e.ts < t.nxt WHERE e.event_type <> 'purchase' GROUP BY e.event_id")
def asof_page_top(spark, d):
    e = table(spark, d, "events")
    tops = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("top"))
    return I.asof(e.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id"), tops, "user_id", "ts", "top").select("event_id", "top")


_RUNS = f"(SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {_ISLAND}) AS run FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))"


@query(f"SELECT user_id, run::BIGINT AS run, event_type, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS ids, count(*) AS n FROM {_RUNS} GROUP BY user_id, run, event_type")
def islands_runs(spark, d):
    e = table(spark, d, "events").withColumn("ids", F.col("event_id").cast("string"))
    return I.runs(e, ["user_id"], "event_id", "event_type", "ids")


@query(f"SELECT user_id, grp, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id rows between unbounded preceding and 1 preceding), 0)::BIGINT AS grp FROM events) GROUP BY ALL")
def confidence_split(spark, d):
    g = I.group_until(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase")
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn {_ISLAND})::BIGINT AS grp FROM conversations")
def fencepost_groups(spark, d):
    return I.group_from(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "grp")


@query("SELECT conv_id, turn, 'C' || conv_id || '.' || CASE WHEN i >= 26 THEN chr((96 + i // 26)::INT) ELSE '' END || chr((97 + i % 26)::INT) AS paragraph_id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)")
def paragraph_ids(spark, d):
    return I.paragraph_ids(table(spark, d, "conversations"), ["conv_id"], "turn", F.concat(F.lit("C"), F.col("conv_id").cast("string"))).select("conv_id", "turn", "paragraph_id")


@query(f"SELECT user_id, span::BIGINT AS span, string_agg(left(event_type, 1), '' ORDER BY event_id) AS text, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR event_type <> p OR abs(value - v) > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {_ISLAND}) AS span FROM (SELECT *, lag(event_type) OVER w AS p, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY user_id, span")
def char_runs_to_spans(spark, d):
    e = table(spark, d, "events").withColumn("text", F.substring("event_type", 1, 1))
    return I.spans_from_chars(e, ["user_id"], "event_id", ["event_type"], "value", "text", 100.0).select("user_id", "span", "text", F.length("text").cast("long").alias("n"))


@query("WITH g AS (SELECT user_id, event_id, round(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS gap FROM events), m AS (SELECT user_id, gap AS mode FROM (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, gap) AS r FROM g WHERE gap IS NOT NULL GROUP BY user_id, gap) WHERE r = 1) SELECT user_id, event_id, sum(CASE WHEN abs(gap) > 1.5 * abs(mode) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id rows between unbounded preceding and current row)::BIGINT AS paragraph FROM g JOIN m USING (user_id) WHERE gap IS NOT NULL")
def spacing_mode_paragraphs(spark, d):
    return I.mode_breaks(table(spark, d, "events").withColumn("y", F.col("event_id").cast("double")), ["user_id"], "event_id", "y").select("user_id", "event_id", "paragraph")


@query("SELECT event_type, round(regr_intercept(value, event_id), 6) AS intercept, round(regr_slope(value, event_id), 6) AS slope, round(regr_r2(value, event_id), 6) AS r2 FROM events GROUP BY event_type")
def ols_markers(spark, d):
    return I.line_fit(table(spark, d, "events"), ["event_type"], "event_id", "value")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events) WHERE c <= 10 OR c % 100 = 1")
def log_sampler(spark, d):
    return I.sample_log(table(spark, d, "events"), "event_type", "event_id").select("event_type", "event_id")


@query("SELECT k, ord, num FROM (VALUES ('a', 1, 1), ('a', 2, 2), ('a', 4, 5), ('b', 1, 3)) t(k, ord, num)")
def accept_sequence(spark, d):
    v = rows(spark, "k string, ord long, num long", ("a", 1, 1), ("a", 2, 2), ("a", 3, 40), ("a", 4, 5), ("a", 5, 3), ("b", 1, 3), ("b", 2, 9))
    return I.accept_numbers(v, "k", "ord", "num")


# --- style, geometry --------------------------------------------------------


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS canonical FROM part")
def style_canonicalise(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("style"))
    return A.canonical_styles(p).select(F.col("ref").alias("p_partkey"), "canonical")


_BOX = "(SELECT l_orderkey, l_linenumber, (l_partkey % 500)::INT AS x0, (l_partkey % 500 + l_quantity)::INT AS x1, (l_suppkey % 300)::INT AS y0, (l_suppkey % 300 + l_linenumber * 5)::INT AS y1 FROM lineitem)"


def boxes(spark, d):
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.box(x, x + F.col("l_quantity"), y, y + F.col("l_linenumber") * 5).alias("box"))


@query(f"SELECT l_orderkey, l_linenumber, greatest(x0, 100) AS x0, least(x1, 300) AS x1, greatest(y0, 50) AS y0, least(y1, 200) AS y1 FROM {_BOX} WHERE greatest(x0, 100) <= least(x1, 300) AND greatest(y0, 50) <= least(y1, 200)")
def bbox_intersect(spark, d):
    frame = G.box(*[F.lit(v) for v in (100, 300, 50, 200)])
    return boxes(spark, d).withColumn("r", G.intersect(F.col("box"), frame)).filter("r IS NOT NULL").select("l_orderkey", "l_linenumber", "r.*")


@query(f"SELECT l_orderkey, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM {_BOX} GROUP BY l_orderkey")
def bbox_union(spark, d):
    agg = [f(f"box.{c}").alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))]
    return boxes(spark, d).groupBy("l_orderkey").agg(*agg)


@query(f"SELECT count(*) AS n FROM {_BOX} WHERE 250 BETWEEN x0 AND x1 AND 100 BETWEEN y0 AND y1")
def point_in_box(spark, d):
    return boxes(spark, d).filter(G.contains_point(F.col("box"), F.lit(250), F.lit(100))).agg(F.count("*").alias("n"))


@query(f"SELECT a.l_orderkey, a.l_linenumber AS a_id, b.l_linenumber AS b_id FROM {_BOX} a JOIN {_BOX} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def overlap_self_join(spark, d):
    return L.overlap_pairs(boxes(spark, d), "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, round(atan2(p_size, p_retailprice), 9) AS angle, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS dist, abs(p_size - 25) <= 20 AND abs(p_size - 30) <= 20 AND abs(25 - 30) <= 20 AS gray, lower(lpad(printf('%X', p_size), 2, '0')) AS hex FROM part")
def geometry_angles(spark, d):
    z, s, p = F.lit(0.0), F.col("p_size"), F.col("p_retailprice")
    turned = G.turn(F.lit(1.0), z, z, z, p, s)
    return table(spark, d, "part").select("p_partkey", F.round(turned, 9).alias("angle"), F.round(G.distance(z, z, p, s), 6).alias("dist"), G.is_gray(s, F.lit(25), F.lit(30)).alias("gray"), G.hex2(s).alias("hex"))


# --- annotation, dictionaries -----------------------------------------------


@query("SELECT doc_id, md5(regexp_replace(text, '(License|the|der|la)', '<a title=\"\\1\">\\1</a>', 'g')) AS h FROM documents")
def dictionary_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.markup(F.col("text"), ["the", "der", "la", "License"])).alias("h"))


@query("SELECT term_key, ord, term FROM (SELECT lower(trim(p_type)) AS term_key, p_partkey AS ord, p_type AS term, row_number() OVER (PARTITION BY lower(trim(p_type)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def dict_dedupe_first_wins(spark, d):
    return D.index(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("term"))).select("term_key", "ord", "term")


def entries(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("Q"), (F.col("n_nationkey") % 7).cast("string"))).alias("wikidata_id"))
    return D.index(n)


_ENTRIES = "(SELECT n_nationkey AS ord, n_name AS term, CASE WHEN n_nationkey % 3 > 0 THEN 'Q' || (n_nationkey % 7) END AS wikidata_id, lower(trim(n_name)) AS term_key FROM nation)"


@query(f"SELECT term_key, term, wikidata_id FROM {_ENTRIES} WHERE term_key NOT IN (SELECT lower(r_name) FROM region) UNION ALL SELECT lower(r_name), r_name, 'R' FROM region")
def dict_upsert(spark, d):
    new = table(spark, d, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("term"), F.lit("R").alias("wikidata_id"), F.lower("r_name").alias("term_key"))
    return D.upsert(entries(spark, d), new).select("term_key", "term", "wikidata_id")


@query(f"SELECT term_key FROM {_ENTRIES} WHERE ord >= 5")
def dict_delete(spark, d):
    return D.delete(entries(spark, d), table(spark, d, "nation").filter("n_nationkey < 5").select(F.upper("n_name").alias("term"))).select("term_key")


@query(f"SELECT term_key FROM {_ENTRIES} WHERE wikidata_id IS NULL")
def missing_ids(spark, d):
    return D.missing_ids(entries(spark, d)).select("term_key")


@query(f"SELECT wikidata_id, min(ord) AS ord FROM {_ENTRIES} WHERE wikidata_id IS NOT NULL GROUP BY 1")
def unique_ids(spark, d):
    return D.unique_by_id(entries(spark, d)).select("wikidata_id", "ord")


@query(f"SELECT wikidata_id, count(*) AS n FROM {_ENTRIES} WHERE wikidata_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return D.duplicate_ids(entries(spark, d))


@query(f"SELECT term_key, coalesce(wikidata_id, CASE WHEN ord = 0 THEN 'Q99' END, 'NOT_FOUND') AS wikidata_id FROM {_ENTRIES}")
def fill_missing_ids(spark, d):
    found = table(spark, d, "nation").filter("n_nationkey = 0").select(F.lower("n_name").alias("term_key"), F.lit("Q99").alias("found_id"))
    return D.fill_ids(entries(spark, d), found).select("term_key", "wikidata_id")


_LANG = lambda k: f"(SELECT lower(word) AS term FROM {_WORDS} WHERE lang = '{k}')"


def lang_terms(spark, d, k):
    docs = table(spark, d, "documents").filter(F.col("lang") == k)
    return D.term_set(X.word_rows(docs).withColumnRenamed("word", "term"), True)


@query(f"SELECT DISTINCT term FROM (SELECT trim(term) AS term FROM {_LANG('fr')} INTERSECT SELECT trim(term) FROM {_LANG('es')})")
def terms_intersect(spark, d):
    return lang_terms(spark, d, "fr").intersect(lang_terms(spark, d, "es"))


@query(f"SELECT count(*) AS n FROM (SELECT trim(term) FROM {_LANG('es')} EXCEPT SELECT trim(term) FROM {_LANG('fr')})")
def terms_except(spark, d):
    return lang_terms(spark, d, "es").subtract(lang_terms(spark, d, "fr")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT trim(term) FROM {_LANG('es')} UNION SELECT trim(term) FROM {_LANG('de')})")
def terms_union(spark, d):
    return lang_terms(spark, d, "es").union(lang_terms(spark, d, "de")).distinct().agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def enrich_left(spark, d):
    hits = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("match"))
    own = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("term_key"), F.col("n_name").alias("wikidata_id"))
    return X.enrich(hits, own).select("c_custkey", F.col("wikidata_id").alias("label"))


@query("SELECT n_name AS term, list_sort(list(DISTINCT 'Q' || c_custkey)) AS ids FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 10 = n_nationkey % 10 GROUP BY n_name")
def disambiguate(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = c.groupBy(F.col("n_name").alias("term")).agg(F.collect_list(F.concat(F.lit("Q"), F.col("c_custkey").cast("string"))).alias("raw_ids")).withColumn("name", F.upper("term"))
    title = F.when(F.col("c_custkey") % 10 == F.col("n_nationkey") % 10, F.lower("n_name")).otherwise("other")
    return D.disambiguate(raw, c.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), title.alias("title")))


@query("SELECT c_name FROM customer WHERE NOT regexp_matches(lower(c_mktsegment), '^(?:auto|build)')")
def blacklist(spark, d):
    return table(spark, d, "customer").filter(D.not_blacklisted(F.lower("c_mktsegment"), ("auto", "build"))).select("c_name")


@query("SELECT term, qid, rank FROM (SELECT c_mktsegment AS term, 'Q' || c_custkey AS qid, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 97 DESC, 'Q' || c_custkey) AS rank FROM customer) WHERE rank <= 5")
def top5_candidates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("term"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), (F.col("c_custkey") % 97).alias("statements"), F.col("c_custkey").alias("ord"))
    return D.candidates(c).select("term", "qid", "rank")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' INTERSECT SELECT p_partkey FROM part WHERE p_size = 10")
def triples_pattern(spark, d):
    p = table(spark, d, "part")
    triples = p.select(F.col("p_partkey").alias("subject"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).alias("predicate", "object"))
    both = D.objects(triples, "brand", "Brand#11").select("subject").join(D.objects(triples, "size", "10").select("subject"), "subject")
    return both.select(F.col("subject").alias("p_partkey")).distinct()


# --- plans ------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND length(text) > 500 AND lang = 'en'")
def dsl_expression(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(dsl.parse("and(contains(text, 'License'), greater_than(length(text), 500), equals(lower(lang), 'en'))", docs.columns)).select("doc_id")


@query(f"SELECT doc_id || '#' || n AS path, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS content FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM (SELECT doc_id, s AS line, p AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS p FROM documents WHERE text <> '') WHERE s <> '')) WHERE contains(line, 'License')")
def pipeline_sentences(spark, d):
    return Pipeline(spark).table(table(spark, d, "documents"), "doc_id", "text").split("txt2sent").filter("contains(content, 'License')").apply("normalize").data


@query("SELECT page_id, " + ", ".join(f"len(list_filter(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1), lambda x: x = '{t}'))::BIGINT AS {t}" for t in ("p", "a", "li")) + " FROM pages")
def page_profile_pivot(spark, d):
    objects = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.explode(M.tags(F.col("html"))).alias("object_type"))
    return L.object_profile(objects, ["p", "a", "li"]).withColumnRenamed("page", "page_id")


@query("SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def cooccurrence(spark, d):
    one = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return one.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n")


@query()
def merge_span_lines(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("span_id"), (F.col("l_partkey") % 500).cast("int").alias("x0"), (F.col("l_partkey") % 500 + 30).cast("int").alias("x1"), (F.col("l_suppkey") % 100).cast("int").alias("y0"), (F.col("l_suppkey") % 100 + 10).cast("int").alias("y1"), F.col("l_returnflag").alias("text"))
    return L.merge_lines(v)


# --- trees, spans, further scalars ------------------------------------------


@query("SELECT user_id, item::BIGINT AS item, string_agg(CASE WHEN event_id % 7 = 0 THEN event_id::VARCHAR ELSE event_type END, ' ' ORDER BY event_id) AS text FROM (SELECT *, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id rows between unbounded preceding and current row) AS item FROM events) GROUP BY user_id, item")
def footnote_list_items(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type")).alias("text"))
    return TR.list_items(e, "user_id")


@query(f"SELECT doc_id, div::BIGINT AS div, min(n) AS n, md5(string_agg(line, ' ' ORDER BY n)) AS h FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*\\p{{Ll}}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n rows between unbounded preceding and current row) AS div FROM {_LINES}) GROUP BY doc_id, div")
def merge_continued_lines(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "text"))
    return TR.merge_continued(v, "doc_id", "n").select("doc_id", "div", "n", F.md5("text").alias("h"))


@query("SELECT doc, ord, parent, level, floats FROM (VALUES ('d', 0, -1, 1, 0), ('d', 1, 0, NULL, 0), ('d', 2, 0, 2, 0), ('d', 3, 2, NULL, 0), ('d', 4, 3, NULL, 1), ('d', 5, 3, NULL, 0), ('d', 6, -1, 1, 0), ('d', 7, 6, 2, 0)) t(doc, ord, parent, level, floats)")
def section_stack(spark, d):
    v = rows(spark, "doc string, ord long, class string, text string", *[("d", k, c, "") for k, c in enumerate(["section", "p", "sub_section", "start", "p", "end", "section", "sub_section"])])
    return TR.nested(v, "doc")


@query("SELECT c_mktsegment AS term, 'Q' || min(c_custkey) AS qid FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def best_entity(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("term"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_name").alias("label"), F.col("c_custkey").alias("rank"), F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("de").alias("lang"))
    return TR.best_candidate(c, "en").select("term", "qid")


@query("SELECT l_linenumber AS size, l_quantity::INT AS bytes, min(l_orderkey) AS page, count(*) AS n FROM lineitem GROUP BY ALL")
def image_dedupe(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("size"), F.col("l_quantity").cast("int").alias("bytes"), F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return TR.distinct_images(v).select("size", "bytes", "page", "n")


@query("SELECT conv_id AS table_id, (turn - m)::BIGINT AS row, col, text FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS m, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS col FROM conversations)")
def table_cells(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.split("text", " ").alias("cells")))), lambda s: s["cells"]).alias("rows"))
    return TR.table_cells(c)


@query("SELECT l_shipmode_like AS value, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def commonest_values(spark, d):
    v = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("value"))
    return TR.repeated_values(v, "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def content_store_upsert(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("content"), F.col("event_id").alias("version"))
    return TR.latest(v).withColumnRenamed("path", "user_id")


@query("SELECT user_id, paragraph::BIGINT AS paragraph, count(*) AS runs FROM (SELECT DISTINCT user_id, paragraph, run FROM (SELECT *, sum(c) OVER (PARTITION BY user_id, paragraph ORDER BY event_id rows between unbounded preceding and current row) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id, paragraph ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY event_id rows between unbounded preceding and current row) AS paragraph FROM (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))))) GROUP BY user_id, paragraph")
def page_paragraph_runs(spark, d):
    v = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("value").alias("y0"), F.col("event_type").alias("family"), F.lit(1.0).alias("size"), F.col("event_type").alias("text"))
    return TR.paragraphs_of_page(v, "user_id", 50.0).groupBy("user_id", "paragraph").agg(F.count("*").alias("runs"))


@query("SELECT event_id, top FROM (WITH t AS (SELECT user_id, event_id AS top, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events WHERE event_type = 'purchase') SELECT e.event_id, t.top FROM events e JOIN t ON t.user_id = e.user_id AND t.top <= e.event_id AND e.event_id < t.nxt WHERE e.event_type <> 'purchase' AND e.event_id - t.top BETWEEN 2 AND 900)")
def header_footer_filter(spark, d):
    e = table(spark, d, "events").withColumn("y", F.col("event_id"))
    tops = e.filter("event_type = 'purchase'").select("user_id", F.col("y").alias("top"))
    return TR.body_spans(e.filter("event_type <> 'purchase'").select("user_id", "y", "event_id"), tops, "user_id", 2, 100, 1000).select("event_id", "top")


@query("SELECT p_partkey, CASE WHEN p_size < 0.9 * lag(p_size) OVER w AND p_retailprice > lag(p_retailprice) OVER w THEN 'sub' WHEN p_size < 0.9 * lag(p_size) OVER w AND p_retailprice < lag(p_retailprice) OVER w THEN 'super' END AS script FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def script_detection(spark, d):
    return I.script_kind(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_size", "p_retailprice").select("p_partkey", "script")


@query("SELECT c_custkey, round(c_acctbal, 1) AS r FROM (SELECT c_custkey, round_even(c_acctbal, 1) AS c_acctbal FROM customer)")
def px_rounding(spark, d):
    px = S.px(F.concat(F.col("c_acctbal").cast("string"), F.lit("px")), 1)
    return table(spark, d, "customer").select("c_custkey", px.alias("r"))
