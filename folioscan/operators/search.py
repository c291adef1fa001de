"""Searching documents with dictionaries and patterns; every operator maps DataFrames to a DataFrame.

Dictionaries are tables (dictionary, term). Word matches are equi-joins on the
lower-cased word; small ones are sent to the words, which stay where they are,
and for large ones Spark picks the strategy. Phrases are found by the characters
around their first space and then checked, never by comparing all pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


#: A dictionary of at most so many rows goes to the texts; larger ones meet them by a shuffle.
SMALL = 10_000
#: So few phrases are looked for in each sentence itself, which costs less than its anchors.
FEW = 64


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most SMALL rows: they are counted once, as Spark knows no size of rows made in Python."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def word_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, word: a row for each word."""
    return docs.select(*keys, F.explode(T.words(F.col("text"))).alias("word"))


def sentence_rows(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


def filter_words(words: DataFrame, least: int = 3, stop: DataFrame | None = None, numeric: bool = False, alnum: bool = False, regex: str | None = None, keep: bool = True) -> DataFrame:
    """Words of some length, not numbers, not in the stop lists (given as a table, or the built-in lists).

    alnum: only words of letters and digits; regex: only words that begin with it, or with keep=False only others.
    """
    kept = words.filter(F.length("word") >= least)
    if not numeric:
        kept = kept.filter(~T.is_number(F.col("word")))
    if alnum:
        kept = kept.filter(F.col("word").rlike(r"^[\p{L}\p{N}]+$"))
    if regex is not None:
        kept = kept.filter(T.prefix_match(F.col("word"), regex) if keep else ~T.prefix_match(F.col("word"), regex))
    low = F.lower("word")
    if stop is None:
        return kept.filter(~low.isin(*T.STOPWORDS, *T.STOPWORDS_PUB))
    return kept.join(small(stop.select(F.lower("word").alias("stop_")).distinct()), low == F.col("stop_"), "left_anti")


def match_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each occurrence of a term of one word: the words' keys, dictionary, match."""
    keys = [c for c in words.columns if c != "word"]
    low = words.select(*keys, F.lower("word").alias("match"))
    return low.join(small(terms.select("dictionary", F.lower("term").alias("match")).distinct()), "match").select(*keys, "dictionary", "match")


def _anchor(phrase: Column) -> Column:
    """Three characters on both sides of the first space, where no other space is among them; else one on each side; else ''."""
    at = F.instr(phrase, " ")
    wide, thin = F.substring(phrase, at - 3, F.lit(7)), F.substring(phrase, at - 1, F.lit(3))
    return F.when((at > 3) & wide.rlike(r"^\S{3} \S{3}$"), wide).when((at > 1) & thin.rlike(r"^\S \S$"), thin).otherwise("")


def match_phrases(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each (term, sentence) pair where the lower-cased sentence contains the term.

    A term is looked up by its anchor, the characters around its first space. A
    sentence has at most two anchors for each of its spaces, so rows grow with
    words; containment decides. Terms without an anchor meet every sentence. The
    anchors of a small dictionary are read first, and a sentence is repeated
    only for those among its own; FEW terms are looked for without anchors.
    """
    keys = [c for c in sentences.columns if c != "sentence"]
    own = terms.select("dictionary", F.lower("term").alias("match")).filter("match <> ''").distinct()
    own = own.withColumn("anchor", _anchor(F.col("match")))
    low = sentences.select(*keys, F.lower("sentence").alias("low"))
    around = lambda p: F.regexp_extract_all("low", F.lit(f"(?=({p}))"), F.lit(1))
    anchors = F.array_distinct(F.concat(F.array(F.lit("")), around(r"\S{3} \S{3}"), around(r"\S \S")))
    known = [r.anchor for r in own.select("anchor").limit(SMALL + 1).collect()]
    if len(known) <= FEW:
        return low.join(F.broadcast(own), F.contains("low", F.col("match"))).select(*keys, "dictionary", "match")
    if len(known) <= SMALL:
        own, anchors = F.broadcast(own), F.filter(anchors, lambda a: a.isin(sorted(set(known))))
    met = low.select(*keys, "low", F.explode(anchors).alias("anchor")).join(own, "anchor")
    return met.filter(F.contains("low", F.col("match"))).select(*keys, "dictionary", "match")


def match_pattern(words: DataFrame, kind: str, regex: str = "") -> DataFrame:
    """Words that a pattern accepts: _ALL, _ALLCAPS, _NUMBER or _REGEX (anchored at the start)."""
    tests = {"_ALL": F.lit(True), "_ALLCAPS": T.is_all_caps(F.col("word")), "_NUMBER": T.is_number(F.col("word")), "_REGEX": T.prefix_match(F.col("word"), regex)}
    if kind not in tests:
        raise ValueError(f"unknown pattern type {kind}")
    return words.filter(tests[kind])


def count_matches(hits: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """keys, match, n for matches with at least ``least`` occurrences."""
    return hits.groupBy(*keys, "match").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def with_empty_tools(counts: DataFrame, tools: DataFrame) -> DataFrame:
    """Counts by dictionary, dictionaries without hits included with 0."""
    per = counts.groupBy("dictionary").agg(F.sum("n").alias("n"))
    return tools.select("dictionary").distinct().join(per, "dictionary", "left").select("dictionary", F.coalesce("n", F.lit(0)).alias("n"))


def section_pivot(hits: DataFrame, section: str, dictionaries: list[str]) -> DataFrame:
    """A row for each section with hits, a column for each dictionary: its distinct hits, joined."""
    joined = F.array_join(F.array_sort(F.collect_set("match")), " | ")
    return hits.groupBy(section).pivot("dictionary", dictionaries).agg(joined).na.fill("", dictionaries)


def top(counts: DataFrame, k: int, by: str = "n", *partition: str) -> DataFrame:
    """The k largest, ties in the order of the match; of each partition, if any is given."""
    if not partition:
        return counts.orderBy(F.desc(by), "match").limit(k)
    order = W.partitionBy(*partition).orderBy(F.desc(by), "match")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def enrich(hits: DataFrame, entries: DataFrame, lang: str | None = None, require_id: bool = False) -> DataFrame:
    """Hits with their entry's id and a label, the synonym in ``lang`` where there is one."""
    label = F.col("match")
    if lang:
        label = F.coalesce(F.get(F.filter("synonyms", lambda s: s["lang"] == lang), 0)["text"], label)
    joined = hits.join(entries.withColumnRenamed("term_key", "match"), "match", "left")
    if require_id:
        joined = joined.filter(F.coalesce("wikidata_id", F.lit("")) != "")
    return joined.withColumn("label", label)


def snowball(docs: DataFrame, seed: DataFrame, rounds: int = 2, least: int = 3) -> DataFrame:
    """term, round: the seed terms (round 0), then in each round the words of documents that have a known term.

    A round counts the words of those documents, makes entries of the ones with
    more than ``least`` hits that pass the word filter, and searches again with
    them. The known terms are one array, frequent ones first, so most documents
    are decided by its first terms; neither texts nor words are shuffled, only counts.
    """
    known = seed.select(F.lower("term").alias("term")).distinct().select("term", F.lit(0).alias("round"), F.lit(2**62).alias("n"))
    for r in range(1, rounds + 1):
        listed = known.agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "term")), asc=False), lambda s: s["term"]).alias("terms"))
        found = docs.filter(F.arrays_overlap(T.words(F.lower("text")), listed.scalar()))
        counted = filter_words(word_rows(found).groupBy("word").agg(F.count("*").alias("n")))  # the filter sees each word once
        fresh = counted.groupBy(F.lower("word").alias("term")).agg(F.sum("n").alias("n")).filter(F.col("n") > least)
        known = known.unionByName(fresh.join(known, "term", "left_anti").select("term", F.lit(r).alias("round"), "n"))
    return known.select("term", "round")


def annotation_counts(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """match, n, ids: how often each surface form was marked and the ids its entries have; hits without an entry are left out.

    hits: match; entries: term, wikidata_id. Hits are counted before the join, so a frequent form is one row.
    """
    per = hits.groupBy("match").agg(F.count("*").alias("n"))
    ids = entries.groupBy(F.lower("term").alias("low_")).agg(F.array_sort(F.collect_set("wikidata_id")).alias("ids"))
    return per.join(ids, F.lower("match") == F.col("low_")).select("match", "n", "ids")


def keep_hits_in_dictionary(hits: DataFrame, terms: DataFrame) -> DataFrame:
    return hits.join(small(terms.select(F.lower("term").alias("key_")).distinct()), F.lower("match") == F.col("key_"), "left_semi")


def concordance(docs: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """keys, match, before, after: each matched word with the words on both sides (a window before the join)."""
    rows = docs.select(*keys, F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    order = W.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("before", F.lag("word").over(order)).withColumn("after", F.lead("word").over(order))
    return match_words(rows.select(*keys, "pos", "before", "after", "word"), terms)


def filter_files(files: DataFrame, accept: Column, keep: bool = True) -> DataFrame:
    """Files whose content passes, or with keep=False those that do not."""
    return files.filter(F.coalesce(accept, F.lit(False)) if keep else ~F.coalesce(accept, F.lit(False)))


def refine(hits: Column, new: Column) -> Column:
    """A refinement replaces hits only where it finds something."""
    return F.when(F.size(new) > 0, new).otherwise(hits)


def filter_chain(text: Column, steps: list[tuple[str, str | list[str]]]) -> Column:
    """The hits of a text after a chain of commands, each of which sees the hits before it.

    contains adds its value where the text has it; dictionary adds the text's words that are among its terms; regex
    keeps the hits that begin so, and lookup those among its values, but both only where something is left.
    """
    hits = F.array().cast("array<string>")
    for command, value in steps:  # lambdas run at once, so they see this step's value
        if command == "contains":
            hits = F.when(F.contains(text, F.lit(value)), F.array_append(hits, F.lit(value))).otherwise(hits)
        elif command == "dictionary":
            hits = F.concat(hits, F.filter(T.words(F.lower(text)), lambda w: w.isin(*[v.lower() for v in value])))
        elif command == "regex":
            hits = refine(hits, F.filter(hits, lambda h: T.prefix_match(h, value)))
        elif command == "lookup":
            hits = refine(hits, F.filter(hits, lambda h: h.isin(*value)))
        else:
            raise ValueError(f"unknown command {command}")
    return hits


def search(docs: DataFrame, dictionaries: DataFrame | None = None, patterns: dict[str, tuple[str, str]] | None = None, keys: tuple[str, ...] = ("doc_id",), phrases: bool = True, facets: tuple = ()) -> DataFrame:
    """keys, tool, kind, match, n: the hits of all dictionaries and patterns {name: (kind, regex)}."""
    unknown = set(facets) - {"dictionary", "pattern"}
    if unknown:
        raise ValueError(f"unknown facets {sorted(unknown)}")
    words, parts = word_rows(docs, *keys), []
    if dictionaries is not None:
        found = match_words(words, dictionaries)
        if phrases:
            several = dictionaries.filter(F.contains(F.trim("term"), F.lit(" ")))
            found = found.unionByName(match_phrases(sentence_rows(docs, *keys), several).select(*found.columns))
        parts.append(found.withColumnRenamed("dictionary", "tool").withColumn("kind", F.lit("dictionary")))
    for name, (kind, regex) in (patterns or {}).items():
        parts.append(match_pattern(words, kind, regex).select(*keys, F.lit(name).alias("tool"), F.col("word").alias("match"), F.lit("pattern").alias("kind")))
    if not parts:
        raise ValueError("give dictionaries or patterns")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys, "tool", "kind", "match").agg(F.count("*").alias("n"))


def keywords(docs: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """Phrases of 2 to 6 words between stop words and punctuation that occur more than once: phrase, n, score.

    score sums, over a phrase's words, degree / frequency among all phrases. Phrases
    of other lengths only count for their words; these are counted with the
    phrases, a word as a phrase of its own kind, so texts are read once.
    """
    cleaned = F.regexp_replace(F.lower("text"), r"[^\p{L}\s-]+", " \u0001 ")
    tokens = F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")
    marked = F.array_join(F.transform(tokens, lambda w: F.when(w.isin(*T.STOPWORDS), "\u0001").otherwise(w)), " ")
    phrases = docs.select(F.explode(F.split(marked, "\u0001")).alias("p")).select(F.trim("p").alias("p")).filter("p <> ''").select("p", F.split("p", " ").alias("ws"))
    own = F.when(F.size("ws").between(least, most), F.col("p"))
    texts = phrases.select(F.size("ws").alias("k"), F.posexplode(F.concat(F.array(own), "ws")).alias("pos", "match")).filter("match IS NOT NULL")
    counted = texts.groupBy((F.col("pos") == 0).alias("phrase"), "match").agg(F.count("*").alias("n"), F.sum("k").alias("degree"))
    weight = counted.filter("NOT phrase").select(F.col("match").alias("w"), (F.col("degree") / F.col("n")).alias("weight"))
    kept = counted.filter("phrase AND n > 1").select("match", "n", F.explode(F.split("match", " ")).alias("w"))
    return kept.join(weight, "w").groupBy("match").agg(F.first("n").alias("n"), F.round(F.sum("weight"), 6).alias("score"))
