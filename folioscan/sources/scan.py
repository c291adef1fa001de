"""Reading collections: path templates, typed files, dictionaries, word lists, numbered sentences, JSON pages."""
from __future__ import annotations

import ast
import configparser
import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Where the sections of a document stand below its folder.
SECTIONS = {
    "xml": "sections/**/*.xml",
    "journal": "sections/*_front/*_journal-meta/*_journal-id.xml",
    "publisher": "sections/*_front/*_journal-meta/*_publisher.xml",
    "abstract": "sections/*_front/*_article-meta/*_abstract.xml",
    "body_xml": "sections/*_body/**/*.xml",
    "intro": "sections/*_body/*_introduction/*_p.xml",
    "figure": "sections/*_body/**/*_fig.xml",
    "figure_old": "sections/figures/figure_*.xml",
    "note": "sections/*_back/**/*_notes.xml",
    "para": "sections/*_body/**/*_p.xml",
    "table": "sections/**/*_table-wrap",
    "table_label": "sections/**/*_table-wrap/*_label.xml",
    "table_caption": "sections/**/*_table-wrap/*_caption.xml",
    "table_body": "sections/**/*_table-wrap/*_table.xml",
    "title": "sections/*_body/**/*_title.xml",
    "back_xml": "sections/*_back/**/*.xml",
    "ref-list": "sections/*_back/*_ref-list",
    "ref": "sections/*_back/*_ref-list/*_ref.xml",
}
RESERVED_FILES = ("fulltext.xml", "fulltext.pdf", "fulltext.html", "eupmc_result.json", "fulltext.txt", "scholarly.html")
RESERVED_DIRS = ("html", "pdfimages", "results", "sections", "svg")


def expand_scheme(scheme: dict[str, str | list[str]], edits: dict[str, str] | None = None) -> list[str]:
    """Glob strings of a keyed path scheme: lists multiply out; keys starting _ are remarks; FILE ends without slash, SUFFIX is .x."""
    scheme = scheme | (edits or {})
    keys = [k for k in scheme if not k.startswith("_")]
    out = []
    for values in itertools.product(*[[v] if isinstance(v := scheme[k], str) else v for k in keys]):
        path = ""
        for k, v in zip(keys, values, strict=True):
            if v == "_REQD":
                raise ValueError(f"{k} must be given")
            if v not in ("_NULL", "_DESC"):
                path += f".{v}" if k == "SUFFIX" else v if k == "FILE" else f"{v}/"
        out.append(path)
    return out


def list_paths(spark: SparkSession, glob: str, recursive: bool = True) -> DataFrame:
    """path, size of all files that a glob (braces allowed) finds; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()


def load_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, kind, text, content: text of xml, svg and txt files that is valid UTF-8, bytes of images, nothing of others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    suffix = F.lower(F.substring_index("path", ".", -1))
    textual = suffix.isin("xml", "svg", "txt", "html", "md")
    return files.select("path", suffix.alias("kind"), F.when(textual, F.try_validate_utf8(F.col("content").cast("string"))).alias("text"), F.when(suffix.isin("png", "jpg", "gif"), F.col("content")).alias("content"))


def glob_pattern(glob: str) -> str:
    """The regex of a path that ends as the glob says: ** stands for any folders or none, * for what has no slash."""
    parts = re.split(r"(\*\*/|\*)", glob)
    made = "".join({"**/": "(?:[^/]+/)*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts)
    return f"(?:^|/){made}$"


def sections(paths: DataFrame, *kinds: str) -> DataFrame:
    """path, section of files, or of folders for those kinds, whose path fits a section's glob; one pass over the paths for all kinds.

    A folder fits where the path of a file has it.
    """
    folder = lambda k: not SECTIONS[k].endswith(".xml")
    pattern = lambda k: glob_pattern(SECTIONS[k])[:-1] + ("(?=/|$)" if folder(k) else "$")
    found = [F.when(F.col("path").rlike(pattern(k)), F.struct((F.regexp_extract("path", f"^.*?{pattern(k)}", 0) if folder(k) else F.col("path")).alias("path"), F.lit(k).alias("section"))) for k in (kinds or SECTIONS)]
    return paths.select(F.explode(F.array_compact(F.array(*found))).alias("s")).select("s.*").distinct()


def trees(paths: DataFrame) -> DataFrame:
    """tree, n_files of folders that hold a reserved file or folder."""
    rows = paths.select(F.regexp_extract("path", r"^(.*?)/([^/]+)$", 1).alias("folder"), T.basename(F.col("path")).alias("name"))
    direct = rows.filter(F.col("name").isin(*RESERVED_FILES)).select(F.col("folder").alias("tree"))
    below = rows.select(F.regexp_extract("folder", rf"^(.*?)/({'|'.join(RESERVED_DIRS)})(/|$)", 1).alias("tree")).filter("tree <> ''")
    return direct.unionByName(below).groupBy("tree").agg(F.count("*").alias("n_files"))


def children(paths: DataFrame, folder: str, pattern: str = ".*") -> DataFrame:
    """Files right in a folder whose name begins with the pattern."""
    return paths.filter(F.regexp_extract("path", r"^(.*?)/[^/]+$", 1) == folder).filter(T.prefix_match(T.basename(F.col("path")), pattern))


def is_reserved(name: Column) -> Column:
    return name.isin(*RESERVED_FILES, *RESERVED_DIRS) | name.startswith("_") | name.rlike(r"\.(count|snippets|document)\.xml$")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of dictionary files: term, name, description, wikidata_id, synonyms (text, lang), path, ord."""
    schema = "_term string, _name string, _description string, _wikidataID string, _wikipediaPage string, synonym array<struct<_VALUE:string,`_xml:lang`:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    synonyms = F.transform("synonym", lambda s: F.struct(F.trim(s["_VALUE"]).alias("text"), s["_xml:lang"].alias("lang")))
    return raw.select(
        F.monotonically_increasing_id().alias("ord"), F.col("_term").alias("term"), F.lower(F.trim("_term")).alias("term_key"), F.col("_name").alias("name"), F.col("_description").alias("description"),
        F.col("_wikidataID").alias("wikidata_id"), F.col("_wikipediaPage").alias("wikipedia_page"), F.coalesce(synonyms, F.array().cast("array<struct<text:string,lang:string>>")).alias("synonyms"),
    )


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """title, version, path of dictionary files; a file without a title is an error when it is read."""
    raw = spark.read.format("xml").option("rowTag", "dictionary").schema("_title string, _version string").load(path).withColumn("path", F.input_file_name())
    title = F.coalesce(F.nullif(F.trim("_title"), F.lit("")), F.raise_error(F.concat(F.lit("a dictionary without title: "), "path")))
    return raw.select(title.alias("title"), F.col("_version").alias("version"), "path")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term) of a word list, a term a line, blank lines left out."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("term")).filter("term <> ''")


def read_csv_terms(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(ord, term) of one column of a CSV file with a header."""
    return spark.read.option("header", "true").csv(path).select(F.monotonically_increasing_id().alias("ord"), F.trim(F.col(f"`{column}`")).alias("term")).filter("term <> ''")


def select_csv(spark: SparkSession, path: str, name: str, selector: str, value: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path).filter(F.col(f"`{selector}`") == value).select(f"`{name}`")


def read_numbered_sentences(spark: SparkSession, path: str) -> DataFrame:
    """n, text of lines "n: text"."""
    return spark.read.text(path).select(T.read_numbered(F.col("value")).alias("s")).select("s.n", "s.text")


def out_of_order(sentences: DataFrame, key: str) -> DataFrame:
    """Sentences without number, or not numbered 0, 1, 2, ... within their document."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy(key).orderBy(F.col("n").asc_nulls_first())) - 1
    return sentences.withColumn("expected", at).filter(F.col("n").isNull() | (F.col("n") != F.col("expected")))


def read_sparql_results(spark: SparkSession, path: str) -> DataFrame:
    """result, name, uri, literal: a row for each binding of a results file; a file without results is an error."""
    raw = spark.read.format("xml").option("rowTag", "result").schema("binding array<struct<_name:string,uri:string,literal:struct<_VALUE:string>>>").load(path)
    if raw.isEmpty():
        raise ValueError(f"no results in {path}")
    return raw.select(F.monotonically_increasing_id().alias("result"), F.explode("binding").alias("b")).select("result", F.col("b._name").alias("name"), F.col("b.uri").alias("uri"), F.col("b.literal._VALUE").alias("literal"))


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """page, pos and the fields of each character of pages extracted to JSON."""
    char = "struct<text:string,x0:double,y0:double,x1:double,y1:double,width:double,size:double,fontname:string,upright:int,non_stroking_color:string,object_type:string>"
    pages = spark.read.option("multiLine", "true").schema(f"pages array<struct<page_number:int,width:double,height:double,chars:array<{char}>>>").json(path)
    rows = pages.select(F.explode("pages").alias("p")).select(F.col("p.page_number").alias("page"), F.posexplode("p.chars").alias("pos", "c"))
    return rows.select("page", "pos", "c.*")


def page_tops(pages: DataFrame, margin: float = 50.0) -> DataFrame:
    """doc_id, page, top: where each page begins on one long page, from heights."""
    from pyspark.sql import Window as W

    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return pages.select("doc_id", "page", F.coalesce(F.sum(F.col("height") + margin).over(before), F.lit(0.0)).alias("top"))


def read_literal(path: str) -> dict:
    """A configuration written as a Python literal; trailing commas are fine."""
    with open(path, encoding="utf-8") as f:
        return ast.literal_eval(f.read())


def read_symbols(path: str, seen: set[str] | None = None) -> dict[str, str]:
    """All settings of an ini file and of those that keys ending in _ini name; later values win, cycles end."""
    seen = set() if seen is None else seen
    if path in seen:
        return {}
    seen.add(path)
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read(path, encoding="utf-8")
    found: dict[str, str] = {}
    for section in parser.sections():
        for key, value in parser.items(section, raw=True):
            found[key] = value
            if key.endswith("_ini"):
                found |= read_symbols(value, seen)
    return found


def register(catalog: dict[str, str], name: str, path: str) -> dict[str, str]:
    """A catalog with one more named project or dictionary; a name given twice is an error."""
    if name in catalog:
        raise ValueError(f"{name} is already registered")
    return catalog | {name: path}


def fulltexts(spark: SparkSession, project: str) -> DataFrame:
    """The plain full texts of a project's trees."""
    return load_files(spark, f"{project.rstrip('/')}/*/fulltext*.txt")


def with_suffix(path: Column, suffix: str) -> Column:
    """A path with another suffix; a name without one gets it."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def entity_url(qid: Column, site: str = "https://www.wikidata.org/wiki/") -> Column:
    """The page of an entity or, for a P number, a property; null for another id."""
    return F.when(qid.rlike(r"^Q\d+$"), F.concat(F.lit(site), qid)).when(qid.rlike(r"^P\d+$"), F.concat(F.lit(f"{site}Property:"), qid))
