"""Dictionaries as keyed tables: an entry table (ord, term, term_key, ...) and what changes it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALLOWED_ENTRY = ("term", "name", "description", "wikidataID", "wikipediaPage")
ALLOWED_DICTIONARY = ("title", "version")


def key(term: Column) -> Column:
    return F.lower(F.trim(term))


def index(entries: DataFrame) -> DataFrame:
    """One entry for each key, the first in order."""
    order = W.partitionBy("term_key").orderBy("ord")
    keyed = entries.filter(F.trim(F.coalesce("term", F.lit(""))) != "").withColumn("term_key", key(F.col("term")))
    return keyed.withColumn("first_", F.row_number().over(order)).filter("first_ = 1").drop("first_")


def from_terms(terms: DataFrame, duplicates: str = "ignore") -> DataFrame:
    """Entries of a word list (ord, term): stripped, blanks skipped; duplicates ignore, replace or error."""
    rows = terms.select("ord", F.trim("term").alias("term")).filter("term <> ''").withColumn("name", F.col("term"))
    if duplicates == "error":
        rows = rows.withColumn("n_", F.count("*").over(W.partitionBy(key(F.col("term")))))
        return rows.withColumn("term", F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("duplicate term "), "term"))).otherwise(F.col("term"))).drop("n_")
    order = W.partitionBy(key(F.col("term"))).orderBy(F.col("ord").desc() if duplicates == "replace" else F.col("ord"))
    return rows.withColumn("at_", F.row_number().over(order)).filter("at_ = 1").drop("at_").withColumn("term_key", key(F.col("term")))


def lookup(entries: DataFrame, term: str, ignorecase: bool = True) -> DataFrame:
    found = entries.filter(F.col("term_key") == term.lower())
    return found if ignorecase else found.filter(F.col("term") == term)


def upsert(entries: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """New entries win over old ones of the same key, and lose what these had; with replace=False a clash is an error."""
    if replace:
        return entries.join(new.select("term_key"), "term_key", "left_anti").unionByName(new, allowMissingColumns=True)
    clash = new.join(entries.select("term_key", F.lit(True).alias("old_")), "term_key", "left")
    return entries.unionByName(clash.withColumn("term", F.when(F.col("old_"), F.raise_error(F.lit("entry exists"))).otherwise(F.col("term"))).drop("old_"), allowMissingColumns=True)


def delete(entries: DataFrame, terms: DataFrame) -> DataFrame:
    return entries.join(terms.select(key(F.col("term")).alias("term_key")).distinct(), "term_key", "left_anti")


def missing_ids(entries: DataFrame) -> DataFrame:
    return entries.filter(F.trim(F.coalesce("wikidata_id", F.lit(""))) == "")


def unique_by_id(entries: DataFrame) -> DataFrame:
    order = W.partitionBy("wikidata_id").orderBy("ord")
    return entries.filter(F.coalesce("wikidata_id", F.lit("")) != "").withColumn("at_", F.row_number().over(order)).filter("at_ = 1").drop("at_")


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.filter(F.coalesce("wikidata_id", F.lit("")) != "").groupBy("wikidata_id").agg(F.count("*").alias("n")).filter("n > 1")


def fill_ids(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Ids from another table (term_key, found_id), NOT_FOUND where there is none."""
    blank = F.trim(F.coalesce("wikidata_id", F.lit(""))) == ""
    joined = entries.join(found.select("term_key", "found_id"), "term_key", "left")
    return joined.withColumn("wikidata_id", F.when(blank, F.coalesce("found_id", F.lit("NOT_FOUND"))).otherwise(F.col("wikidata_id"))).drop("found_id")


def term_set(entries: DataFrame, ignorecase: bool = True) -> DataFrame:
    return entries.select((key(F.col("term")) if ignorecase else F.col("term")).alias("term")).distinct()


def violations(elements: DataFrame) -> DataFrame:
    """A row for each attribute that its element may not have; elements: id, tag, attrs (map)."""
    allowed = F.when(F.col("tag") == "dictionary", F.array(*map(F.lit, ALLOWED_DICTIONARY))).otherwise(F.array(*map(F.lit, ALLOWED_ENTRY)))
    return elements.select("id", "tag", F.explode(F.array_except(F.map_keys("attrs"), allowed)).alias("attribute"))


def candidates(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates of each term with most statements (ties: smaller id); of equal ids the first row counts."""
    first = hits.withColumn("dup_", F.row_number().over(W.partitionBy("term", "qid").orderBy("ord"))).filter("dup_ = 1").drop("dup_")
    order = W.partitionBy("term").orderBy(F.desc("statements"), "qid")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def parse_candidate(title: Column, uri: Column) -> Column:
    """(qid, title, statements) of a search result's title "name (Q1) : n statements" and its address."""
    return F.struct(F.substring_index(uri, "/", -1).alias("qid"), F.trim(F.substring_index(title, "(Q", 1)).alias("title"), F.regexp_extract(title, r"(\d+) statement", 1).try_cast("int").alias("statements"))


def not_blacklisted(description: Column, blacklist=("article", "journal", "film", "song", "album")) -> Column:
    return ~F.coalesce(description, F.lit("")).rlike("^(?:" + "|".join(blacklist) + ")")


def disambiguate(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """term, ids: candidates of entries with exactly one list of raw ids whose page title is the entry's name."""
    rows = entries.filter(F.size("raw_ids") > 0).select("term", "name", F.explode("raw_ids").alias("qid"))
    same = rows.join(pages.select("qid", "title"), "qid").filter(F.lower("title") == F.lower("name"))
    return same.groupBy("term").agg(F.array_sort(F.collect_set("qid")).alias("ids"))


def sparql_enrich(entries: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """Entries with a list of the results' values that share their id; all entries stay.

    results: uri (ends in the id), value.
    """
    own = results.select(F.substring_index("uri", "/", -1).alias("wikidata_id"), "value").filter(F.trim("value") != "")
    own = own.groupBy("wikidata_id").agg(F.array_sort(F.collect_list("value")).alias(name))
    return entries.join(own, "wikidata_id", "left")


def objects(triples: DataFrame, predicate: str, object_: str | None = None) -> DataFrame:
    found = triples.filter(F.col("predicate") == predicate)
    return found if object_ is None else found.filter(F.col("object") == object_)


def markup_pattern(terms: list[str]) -> str:
    """An alternation of literal terms, longest first."""
    import re

    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def markup(text: Column, terms: list[str]) -> Column:
    """Terms of a text as links that carry them."""
    return F.regexp_replace(text, f"({markup_pattern(terms)})", '<a title="$1">$1</a>')


def summary(entries: DataFrame) -> DataFrame:
    """entries, terms, ids, without_id: how many rows, distinct keys and distinct ids there are, and keys without an id."""
    id_ = F.nullif(F.trim(F.coalesce("wikidata_id", F.lit(""))), F.lit(""))
    rows = entries.filter(F.trim(F.coalesce("term", F.lit(""))) != "")
    return rows.agg(F.count("*").alias("entries"), F.count_distinct(key(F.col("term"))).alias("terms"), F.count_distinct(id_).alias("ids"), F.count_distinct(F.when(id_.isNull(), key(F.col("term")))).alias("without_id"))


def first_entry(entries: DataFrame, *by: str) -> DataFrame:
    """The first entry in the order of the document, of each dictionary if ``by`` names it."""
    least = F.min_by(F.struct(*[c for c in entries.columns if c not in by]), "ord").alias("e")
    return entries.groupBy(*by).agg(least).filter("e IS NOT NULL").select(*by, "e.*")


def sorted_names(entries: DataFrame) -> DataFrame:
    """name, at: the distinct names in order."""
    names = entries.select(F.coalesce("name", "term").alias("name")).distinct()
    return names.withColumn("at", F.row_number().over(W.orderBy("name")))


def minimal(spark, title: str = "minimal", version: str = "0.0.1", desc: str | None = None) -> DataFrame:
    """The row that describes a dictionary; a version has three numbers."""
    import re

    if not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError(f"bad version {version}")
    return spark.createDataFrame([(title, version, desc)], "title string, version string, desc string")


def with_fields(entries: DataFrame, **fields: Column) -> DataFrame:
    """Entries with fields set (name, term, description, ...); a new term changes the key."""
    for name, value in fields.items():
        entries = entries.withColumn(name, value)
    return entries.withColumn("term_key", key(F.col("term"))) if "term" in fields else entries
