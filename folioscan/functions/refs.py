"""Bibliographic references and cross-reference targets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKET = r"\(([^()]*?(?:19|20)\d\d[a-z]?[^()]*)\)"
#: A reference "first others date", and the parts of a cross-reference target, each matched at a word's start.
BIBLIO = r"^((?:de|d'|el)?\s*[A-Z]\S+)(.+)(20\d\d[a-z]*)"
PACKAGE = r"WGI+|WG[123]|SR(?:CCL|OCC|1\.?5)"
SECTION = r"Chapter|Anne(xe)?|SPM|SM|TS|ES|[Ss]ections?"
OBJECT = r"[Ff]ig(ure)?|[Tt]ab(le)?|[Ff]ootnote|Box|CCBox|CSBox"
SUBSECTION = r"\d+$|[A-F]$|ES|([A-E]?\.?\d+(\.\d+)?(\.\d+)?)"
#: What is written anew in a target, in this order.
TARGET_RULES = (
    (r"SR\s*1\.5", "SR1.5 "), (r"WG1\.", "WG1 "), (r"TS\.", "TS "), (r"SPM\.", "SPM "), (r"\s+", " "), (r"WPM", "SPM"), (r"WG\s*I", "WGI"),
    (r"Cross\-([Cc]hapter)\s*[Bb]ox", "CCBox"), (r"Cross\-([Ss]ection)\s*[Bb]ox", "CSBox"), (r"Cross\-([Ww]orking\s+[Gg]roup|WG)\s+[Bb]ox", "CWGBox"),
)


def doi_url(text: Column) -> Column:
    """The last "doi:..." of a text before a full stop, as a URL; null without one."""
    doi = F.regexp_extract(text, r"^.*\s(doi:[^\s]*)\.", 1)
    url = F.replace(F.replace(doi, F.lit("doi:https"), F.lit("https")), F.lit("doi:"), F.lit("https://doi.org/"))
    return F.when(doi != "", url)


def brackets_with_year(text: Column) -> Column:
    """The insides of brackets that hold a year."""
    return F.regexp_extract_all(text, F.lit(BRACKET), F.lit(1))


def references(bracket: Column) -> Column:
    """The references of a bracket, separated by semicolons."""
    return F.filter(F.transform(F.split(bracket, ";"), lambda x: F.trim(x)), lambda x: x != "")


def biblioref(s: Column) -> Column:
    """(first, others, date) of a reference "first others date"; null for another text."""
    parts = F.struct(*[F.regexp_extract(s, BIBLIO, i).alias(n) for i, n in ((1, "first"), (2, "others"), (3, "date"))])
    return F.when(s.rlike(BIBLIO), parts)


def brace_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1))


def last_braces(text: Column) -> Column:
    """What the last pair of braces in the first line holds; null without one."""
    return F.nullif(F.regexp_extract(text, r"^.*\{(.*)\}.*", 1), F.lit(""))


def clean_target(s: Column) -> Column:
    """A target with the spellings of TARGET_RULES put right."""
    for pattern, to in TARGET_RULES:
        s = F.regexp_replace(s, pattern, to)
    return s


def targets(braces: Column) -> Column:
    """The targets of a brace group, cleaned: parts between colons, semicolons and commas; run-together packages are parted first."""
    parted = F.replace(F.replace(braces, F.lit(" WG"), F.lit(", WG")), F.lit(" SR"), F.lit(", SR"))
    parts = F.transform(F.split(parted, r"\s*[:;,]\s*"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x != ""), clean_target)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def parse_target(s: Column) -> Column:
    """(package, section, object, subsection, unparsed): words taken off the front in this order, each if it fits, else ''."""

    def step(name: str, pattern: str):
        def take(t: Column) -> Column:
            word = F.coalesce(F.get(t["words"], t["at"]), F.lit(""))
            fits = (t["at"] < F.size(t["words"])) & word.rlike(f"^(?:{pattern})")
            return t.withField(name, F.when(fits, word).otherwise("")).withField("at", t["at"] + fits.cast("int"))

        return take

    t = F.struct(F.split(s, r"\s+").alias("words"), F.lit(0).alias("at"))
    for name, pattern in (("package", PACKAGE), ("section", SECTION), ("object", OBJECT), ("subsection", SUBSECTION)):
        t = _let(t, step(name, pattern))
    rest = lambda t: F.array_join(F.slice(t["words"], t["at"] + 1, F.size(t["words"])), " ")
    return _let(t, lambda t: F.struct(*[t[n].alias(n) for n in ("package", "section", "object", "subsection")], rest(t).alias("unparsed")))


def normalize_target(target: Column) -> Column:
    """A parsed target with what was left over moved to where it belongs.

    A section name at the front of the rest becomes the section, if that is
    missing or the same; a single word left becomes a missing subsection, as
    does the first one of a chapter box if the rest starts with a capital or is
    one character; "in Chapter N" gives section and subsection; a rest that
    repeats the subsection loses it.
    """
    words = lambda t: F.filter(F.split(t["unparsed"], r"\s+"), lambda w: w != "")
    first = lambda t: F.coalesce(F.get(t["rest"], 0), F.lit(""))
    tail = lambda t, n: F.slice(t["rest"], n + 1, F.size(t["rest"]))
    some = lambda t: F.size(t["rest"]) > 0

    def section(t):
        own = some(t) & ((first(t).rlike(f"^(?:{SECTION})") & (t["section"] == "")) | (t["section"] == first(t)))
        return t.withField("section", F.when(own, first(t)).otherwise(t["section"])).withField("rest", F.when(own, tail(t, 1)).otherwise(t["rest"]))

    def single(t):
        return t.withField("subsection", F.when((F.size(t["rest"]) == 1) & (t["subsection"] == ""), first(t)).otherwise(t["subsection"]))

    def box(t):
        capital = (F.length(t["unparsed"]) == 1) | t["unparsed"].rlike(r"^\p{Lu}")
        own = some(t) & (t["object"] == "CCBox") & (t["subsection"] == "") & capital
        return t.withField("subsection", F.when(own, first(t)).otherwise(t["subsection"])).withField("rest", F.when(own, F.slice(t["rest"], 1, F.size(t["rest"]) - 1)).otherwise(t["rest"]))

    def chapter(t):
        own = (F.size(t["rest"]) == 3) & (first(t) == "in") & (F.get(t["rest"], 1) == "Chapter") & (t["section"] == "")
        number = F.concat(F.get(t["rest"], 2), F.lit("."), t["subsection"])
        new = t.withField("section", F.when(own, "Chapter").otherwise(t["section"])).withField("subsection", F.when(own, number).otherwise(t["subsection"]))
        return new.withField("rest", F.when(own, F.slice(t["rest"], 1, 0)).otherwise(t["rest"]))

    def repeated(t):
        return t.withField("rest", F.when(some(t) & (t["subsection"] == first(t)), tail(t, 1)).otherwise(t["rest"]))

    t = _let(target, lambda t: t.withField("rest", words(t)))
    for step in (section, single, box, chapter, repeated):
        t = _let(t, step)
    return _let(t, lambda t: F.struct(*[t[n].alias(n) for n in ("package", "section", "object", "subsection")], F.array_join(t["rest"], " ").alias("unparsed")))


def target_path(target: Column) -> Column:
    """package/section/object/subsection, without the missing ones: where the target belongs in a tree of folders."""
    return F.array_join(F.filter(F.array(*[target[n] for n in ("package", "section", "object", "subsection")]), lambda x: x != ""), "/")


def is_chapter(text: Column) -> Column:
    """Whether a heading names a chapter or the technical summary."""
    return text.startswith("Chapter") | text.startswith("Technical Summary")


def chapter_file(report: Column, chapter: Column, reports: dict[str, str]) -> Column:
    """A document path from a report name that the map knows and a chapter among spm, lr, ts; else null."""
    known = F.create_map(*[F.lit(x) for kv in reports.items() for x in kv])
    low = F.lower(chapter)
    return F.when(low.isin("spm", "lr", "ts"), F.concat(F.try_element_at(known, F.lower(report)), F.lit("/"), low))


def url_of(*parts: Column) -> Column:
    """Parts joined by slashes; null if any is missing."""
    return F.concat(*[x for p in parts for x in (p, F.lit("/"))][:-1])
