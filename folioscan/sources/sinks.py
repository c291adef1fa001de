"""Writing results: sections, sentences, dictionaries, keywords, tables for reading."""
from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_sections(sections: DataFrame, path: str, key: str = "doc_id") -> None:
    sections.write.partitionBy(key).mode("overwrite").parquet(path)


def write_numbered(sentences: DataFrame, path: str) -> None:
    """Lines "n: sentence" (columns n, text)."""
    sentences.orderBy("n").select(T.numbered(F.col("n"), F.col("text")).alias("value")).write.mode("overwrite").text(path)


def write_dictionary(entries: DataFrame, path: str, title: str, version: str = "0.0.1") -> None:
    """Entries as XML below a root that carries title and version."""
    columns = [F.col("term").alias("_term"), *[F.col(c).alias(n) for c, n in (("name", "_name"), ("description", "_description"), ("wikidata_id", "_wikidataID")) if c in entries.columns]]
    root = f'dictionary title="{html.escape(title)}" version="{html.escape(version)}"'
    entries.select(*columns).write.format("xml").option("rowTag", "entry").option("rootTag", root).mode("overwrite").save(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_by_marker(divs: DataFrame, path: str) -> None:
    """A folder for each marker (stripped, lower case, no punctuation)."""
    marker = T.flatten_name(F.lower(F.trim("marker")))
    divs.withColumn("marker", marker).write.partitionBy("marker").mode("overwrite").parquet(path)


def guarded(path: str) -> str:
    """A glob that may be deleted: neither upward steps nor an open end."""
    if ".." in path or path.endswith("*"):
        raise ValueError(f"refused: {path}")
    return path


def html_table(df: DataFrame, most: int = 1000) -> str:
    """A result of at most ``most`` rows as an HTML table (a report, not a data sink)."""
    rows = df.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f'<table id="results"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def tree_names(files: DataFrame, most: int = 24) -> DataFrame:
    """path, tree: a folder name for each file from its stem, equal ones numbered _1, _2, ... in order of paths."""
    from pyspark.sql import Window as W

    stem = T.flatten_name(F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", ""), most)
    w = W.partitionBy("flat")
    rows = files.withColumn("flat", stem).withColumn("at", F.row_number().over(w.orderBy("path"))).withColumn("n", F.count("*").over(w))
    return rows.select("path", F.when(F.col("n") > 1, F.concat_ws("_", "flat", F.col("at").cast("string"))).otherwise(F.col("flat")).alias("tree"))
