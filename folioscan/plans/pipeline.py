"""A builder for runs over a collection: scan, split, apply, filter, combine, write."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import markup, scan
from . import dsl


class Pipeline:
    """Each step gives a new pipeline over a DataFrame (path, content); nothing runs before write() or data is used."""

    def __init__(self, spark: SparkSession, data: DataFrame | None = None):
        self.spark, self.data = spark, data

    def _next(self, data: DataFrame) -> Pipeline:
        return Pipeline(self.spark, data)

    def table(self, df: DataFrame, key: str, content: str) -> Pipeline:
        return self._next(df.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content")))

    def scan(self, glob: str) -> Pipeline:
        return self._next(scan.load_files(self.spark, glob).select("path", F.col("text").alias("content")))

    def split(self, kind: str) -> Pipeline:
        """txt2para, txt2sent or xml2sect."""
        if kind == "xml2sect":
            rows = markup.xml_sections(self.data, "path", "content")
            return self._next(rows.select(F.concat_ws("/", F.col("path")).alias("path"), F.col("xml").alias("content")))
        if kind == "txt2para":
            parts = F.transform(T.paragraphs(F.col("content")), lambda p: F.array_join(p, "\n"))
        elif kind == "txt2sent":
            parts = T.sentences(F.col("content"))
        else:
            raise ValueError(f"unknown split {kind}")
        rows = self.data.select("path", F.posexplode(parts).alias("n", "content"))
        return self._next(rows.select(F.concat_ws("#", "path", F.col("n").cast("string")).alias("path"), "content"))

    def apply(self, f: Callable[[Column], Column] | str) -> Pipeline:
        names = {"xml2txt": markup.plain_text, "txt2words": lambda c: F.array_join(T.words(c), " "), "lower": F.lower, "normalize": T.normalize_space, "txt2ascii": T.nfkd_ascii}
        f = names[f] if isinstance(f, str) else f
        return self._next(self.data.withColumn("content", f(F.col("content"))))

    def filter(self, expression: str, keep: bool = True) -> Pipeline:
        test = F.coalesce(dsl.parse(expression, ["path", "content"]), F.lit(False))
        return self._next(self.data.filter(test if keep else ~test))

    def limit(self, n: int) -> Pipeline:
        return self._next(self.data.limit(n))

    def convert(self, *names: str) -> Pipeline:
        """Converters by name, one after the other; an unknown name is an error before anything runs."""
        for f in [converter(n) for n in names]:
            self = self._next(f(self.data))
        return self

    def combine(self, separator: str = "\n") -> Pipeline:
        """All contents in the order of paths as one: for results of a size that one file holds."""
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda s: s["content"]), separator)
        return self._next(self.data.agg(F.lit("combined").alias("path"), joined.alias("content")))

    def check(self, expression: str) -> Pipeline:
        """Fails when data is used if a row does not satisfy the expression."""
        test = F.coalesce(dsl.parse(expression, ["path", "content"]), F.lit(False))
        return self._next(self.data.withColumn("content", F.when(test, F.col("content")).otherwise(F.raise_error(F.concat(F.lit(f"{expression} fails at "), "path")))))

    def write(self, path: str) -> None:
        self.data.write.mode("overwrite").parquet(path)


def _one(f: Callable[[Column], Column], suffix: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(sibling(F.col("path"), suffix).alias("path"), f(F.col("content")).alias("content"))


def _svg_lines(df: DataFrame) -> DataFrame:
    spans = markup.svg_spans(df, "path", "content")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "\n")
    return spans.groupBy("path").agg(text.alias("content")).select(sibling(F.col("path"), "html").alias("path"), markup.html_page(F.lit("page"), markup.div_span(F.col("content"))).alias("content"))


def _many(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: Pipeline(df.sparkSession, df).split(kind).data


#: name -> (arity, DataFrame -> DataFrame), both of path and content.
CONVERTERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "svg2page": ("1_1", _svg_lines),
    "xml2html": ("1_1", _one(lambda c: markup.html_page(F.lit("document"), markup.div_span(markup.plain_text(c))), "html")),
    "xml2txt": ("1_1", _one(markup.plain_text, "txt")),
    "xml2sect": ("1_n", _many("xml2sect")),
    "txt2para": ("1_n", _many("txt2para")),
    "txt2sent": ("1_n", _many("txt2sent")),
    "combine": ("n_1", lambda df: Pipeline(df.sparkSession, df).combine().data),
}


def converter(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in CONVERTERS:
        raise ValueError(f"no converter {name}; there are {sorted(CONVERTERS)}")
    return CONVERTERS[name][1]


def sibling(path: Column, suffix: str) -> Column:
    """The path of what a file is converted to: the same stem in the folder beside its own that is named as the suffix.

    A path without a folder keeps its place.
    """
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    above = F.regexp_extract(path, r"^(.*?/?)[^/]+/[^/]*$", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.concat(above, F.lit(f"{suffix}/"))).otherwise("")
    return F.concat(folder, stem, F.lit(f".{suffix}"))


def read_config(text: str) -> dict[str, dict]:
    """The runs of a JSON configuration {"resources": {classes, projects, patterns, defaults}, "demos": {name: run}}.

    A run takes the defaults first; what it names must be among the resources. Errors come at once.
    """
    import json

    data = json.loads(text)
    missing = {"resources", "demos"} - set(data)
    if missing:
        raise ValueError(f"a configuration needs {sorted(missing)}")
    resources, runs = data["resources"], {}
    for name, own in data["demos"].items():
        run = resources.get("defaults", {}) | own
        for kind in ("classes", "projects", "patterns"):
            if unknown := set(run.get(kind, ())) - set(resources.get(kind, ())):
                raise ValueError(f"{name}: unknown {kind} {sorted(unknown)}")
        runs[name] = run
    return runs


def arguments(spec: dict[str, dict], values: dict) -> dict:
    """Values for the arguments of a specification {name: {type, default, choices, required}}, checked and converted at once.

    type is str, int, float or bool. Unknown names, missing required ones, values outside the choices and values of
    another type are errors.
    """
    kinds = {"str": str, "int": int, "float": float, "bool": lambda v: str(v).lower() in ("true", "1", "yes")}
    if unknown := set(values) - set(spec):
        raise ValueError(f"unknown arguments {sorted(unknown)}")
    out = {}
    for name, rule in spec.items():
        value = values.get(name, rule.get("default"))
        if value is None and rule.get("required"):
            raise ValueError(f"{name} is missing")
        many = isinstance(value, list)
        made = [kinds[rule.get("type", "str")](v) for v in (value if many else [value])] if value is not None else [None]
        if value is not None and "choices" in rule and (bad := [v for v in made if v not in rule["choices"]]):
            raise ValueError(f"{name}: {bad} not among {rule['choices']}")
        out[name] = made if many else made[0]
    return out


def flags(items: list[str] | str, have: dict | None = None) -> dict:
    """Flags name=value added to those there are; anything else is an error."""
    out = dict(have or {})
    for item in [items] if isinstance(items, str) else items:
        name, sign, value = item.partition("=")
        if not sign or not name.strip():
            raise ValueError(f"bad flag {item!r}")
        out[name.strip()] = value.strip()
    return out


def is_true(have: dict, flag: str) -> bool:
    """Whether a flag is set: missing, empty, None and False are not."""
    return bool(have.get(flag)) and str(have[flag]) not in ("None", "False")


def linked_files(pages: DataFrame, store: DataFrame, suffix: str = "pdf", most: int | None = None) -> DataFrame:
    """page_id, href, path: the addresses of a page that end in the suffix, with the file that the store of snapshots (url, path) has.

    Addresses are asked for once each; those the store lacks stay, with a null path. most: the first so many of a page.
    """
    found = pages.select("page_id", F.posexplode(markup.hrefs(F.col("html"))).alias("n", "href")).filter(F.col("href").endswith(suffix))
    if most is not None:
        from pyspark.sql import Window as W

        found = found.withColumn("r", F.row_number().over(W.partitionBy("page_id").orderBy("n"))).filter(F.col("r") <= most)
    return found.select("page_id", "href").join(snapshots(found.select(F.col("href").alias("url")), store), F.col("href") == F.col("url"), "left").select("page_id", "href", "path")


def snapshots(urls: DataFrame, store: DataFrame) -> DataFrame:
    """url, path of each distinct address in the store of snapshots, the latest version of each; failures are missing."""
    latest = store.groupBy("url").agg(F.max_by("path", "version").alias("path"))
    return urls.select("url").distinct().join(latest, "url")
