"""Text scalars as Column -> Column functions; all stay in the JVM but nfkd_ascii and unescape."""
from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tokens that are a substring of this run are no words.
PUNCT = "!@#$%^&*+{}[]:;'|<>,.?/~`\"\\"
#: Words of publications that say little, compared with the lower-cased word (so capitals never match).
STOPWORDS_PUB = (
    "figure", "permission", "reproduced", "copyright", "authors", "society", "university", "table", "manuscript", "published", "declare", "conflict",
    "research", "diagram", "images", "version", "data", "Fig", "different", "time", "min", "experiments", "group", "analysis", "study", "activity",
    "treated", "Extraction", "using", "mean", "work", "path", "samples", "performed", "analyzed", "support", "values", "approved", "significant",
    "thank", "interest", "supported",
)
#: The usual English stop words, as the public lists have them.
STOPWORDS = tuple("""i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split())  # fmt: skip


def words(s: Column) -> Column:
    """Tokens between single spaces that are not runs of punctuation."""
    return F.filter(F.split(s, " "), lambda w: ~F.contains(F.lit(PUNCT), w))


def strip_non_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def strip_punctuation(s: Column, digits: bool = False) -> Column:
    """Drop what is no letter, digit or space (nor digit)."""
    return F.regexp_replace(s, r"[^A-Za-z\s]" if digits else r"[^A-Za-z0-9\s]", "")


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def translate_all(s: Column, chars: str, to: str = "_") -> Column:
    return F.translate(s, chars, to * len(chars))


def flatten_name(s: Column, most: int | None = None) -> Column:
    """A file-system name: all but letters, digits and _ become _, cut to ``most``."""
    flat = F.regexp_replace(s, "[^A-Za-z0-9_]", "_")
    return flat if most is None else F.substring(flat, 1, most)


def basename(s: Column) -> Column:
    """What follows the last slash; null without one."""
    return F.when(F.contains(s, F.lit("/")), F.substring_index(s, "/", -1))


def section_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "([^/]+/sections/.*)$", 1), F.lit(""))


def lines(s: Column) -> Column:
    return F.split(s, "\n")


def paragraphs(s: Column) -> Column:
    """Arrays of lines: a leading line feed goes, lines lose trailing blanks, a blank line ends a paragraph."""
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\n", ""), r"[ \t\r]+(?=\n|\z)", ""), r"\n\z", "")
    parts = F.split(F.regexp_replace(trimmed, "(?m)^$", "\u0001"), "\u0001")
    return F.transform(parts, lambda p: F.filter(F.split(p, "\n"), lambda x: x != ""))


def sentences(s: Column) -> Column:
    """Split behind . ! or ? and white space; an explicit rule, not a trained model. Null and '' give none."""
    cut = F.split(F.regexp_replace(s, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(cut, lambda x: x != ""))


def numbered(position: Column, s: Column) -> Column:
    return F.concat(position.cast("string"), F.lit(": "), s)


def read_numbered(line: Column) -> Column:
    """(n, text) of a line "n: text"; later ": " parts are lost, as readers of these files do."""
    parts = F.split(line, ": ")
    return F.struct(F.get(parts, 0).try_cast("int").alias("n"), F.get(parts, 1).alias("text"))


def para_tags(s: Column) -> Column:
    """Inline markup to signs: cross-references @, superscripts ^, subscripts _."""
    for gone in ("\n", "</sup>", "</sub>", "</xref>"):
        s = F.replace(s, F.lit(gone), F.lit(""))
    for pattern, to in ((" +<", "<"), ("<xref[^>]*>", "@"), (" *<sup>", "^"), (" *<sub>", "_")):
        s = F.regexp_replace(s, pattern, to)
    return s


def join_broken_lines(s: Column) -> Column:
    """De-hyphenate line ends, then line ends to spaces."""
    s = F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), "-\n", "")
    return F.replace(s, F.lit("\n"), F.lit(" "))


def unquote(s: Column) -> Column:
    return F.regexp_replace(s, r"""^(['"])(.*)\1$""", "$2")


def quote(s: Column, mark: str = "'") -> Column:
    return F.concat(F.lit(mark), s, F.lit(mark))


def letter_id(i: Column) -> Column:
    """0 -> a, 25 -> z, 26 -> aa; from 256 on @.i."""
    two = F.when(i >= 26, F.char(F.lit(96) + F.floor(i / 26))).otherwise(F.lit(""))
    return F.when(i >= 256, F.concat(F.lit("@."), i.cast("string"))).otherwise(F.concat(two, F.char(F.lit(97) + i % 26)))


def dotted_parent(s: Column) -> Column:
    """A.1.2 -> A.1; null at the top."""
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.[^.]*$", ""))


def dotted_ancestors(s: Column) -> Column:
    """The id and all prefixes of it, shortest first: what a recursive closure would make, without recursion."""
    parts = F.split(s, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def is_all_caps(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def is_number(w: Column) -> Column:
    return w.rlike(r"^\p{N}+$")


def is_int(s: Column) -> Column:
    return s.rlike(r"^\s*[+-]?\d+\s*$")


def is_float(s: Column) -> Column:
    return F.trim(s).try_cast("double").isNotNull()


def prefix_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})")


def first_matching(s: Column, patterns: list[str]) -> Column:
    """The first of the patterns that the text begins with, or null."""
    return F.coalesce(*[F.when(prefix_match(s, p), F.lit(p)) for p in patterns])


def is_dotted_triple(s: Column) -> Column:
    parts = F.split(s, r"\.")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: F.coalesce(is_int(p), F.lit(False)))


def is_entity_id(s: Column) -> Column:
    return F.coalesce((s != "") & (s != "NOT_FOUND") & s.rlike(r"^[QP]\d{1,11}"), F.lit(False))


def natural_key(s: Column) -> Column:
    """Sorts a2 before a10: digit runs padded, the rest lower-cased."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def section_key(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda x: x.try_cast("int"))


def split_matches(s: Column, pattern: str) -> Column:
    """Ordered (kind, piece): re_pref before, re_match and re_post after matches; empty pieces left out."""
    cut = F.split(F.regexp_replace(s, f"({pattern})", "\u0001\u0002$1\u0001"), "\u0001")
    found = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.transform(cut, lambda p, i: F.struct(
        F.when(p.startswith("\u0002"), "re_match").when((i == F.size(cut) - 1) & (F.size(found) > 0), "re_post").otherwise("re_pref").alias("kind"), F.replace(p, F.lit("\u0002"), F.lit("")).alias("piece")))
    return F.filter(pieces, lambda x: x["piece"] != "")


def parse_arg(s: Column) -> Column:
    """name=value -> (name, value); a bare name is true; white space or a second = is an error, here null."""
    ok = ~s.rlike(r"\s") & (F.size(F.split(s, "=")) <= 2)
    value = F.when(F.contains(s, F.lit("=")), F.split_part(s, F.lit("="), F.lit(2))).otherwise("True")
    return F.when(ok, F.struct(F.split_part(s, F.lit("="), F.lit(1)).alias("name"), value.alias("value")))


def substitute(s: Column, symbols: dict[str, str]) -> Column:
    """${name} -> value, one pass for each symbol."""
    for name, value in symbols.items():
        s = F.replace(s, F.lit(f"${{{name}}}"), F.lit(value))
    return s


def page_ranges(spec: Column, offset: int = 0, last: int = 2**31 - 1) -> Column:
    """'_2', '4_5', '8', '16_' -> half-open ranges (lo, hi)."""
    lo = F.when(F.contains(spec, F.lit("_")), F.nullif(F.split_part(spec, F.lit("_"), F.lit(1)), F.lit(""))).otherwise(spec).try_cast("long")
    hi = F.when(F.contains(spec, F.lit("_")), F.nullif(F.split_part(spec, F.lit("_"), F.lit(2)), F.lit(""))).otherwise(spec).try_cast("long")
    return F.struct((F.coalesce(lo, F.lit(1)) + offset).alias("lo"), F.coalesce(hi + 1 + offset, F.lit(last)).alias("hi"))


def in_ranges(v: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether v lies in any half-open range; null does not."""
    test = F.lit(False)
    for lo, hi in ranges:
        test = test | ((v >= lo) & (v < hi))
    return F.coalesce(test, F.lit(False))


def file_kind(content: Column) -> Column:
    """Kind of an image by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("FFD8"), "jpeg").when(head == "89504E47", "png").when(head == "47494638", "gif").when(head.startswith("424D"), "bmp")


def is_base64(s: Column) -> Column:
    return F.try_to_binary(s, F.lit("base64")).isNotNull()


def boolean_query(groups: list[list[str]]) -> str:
    """("a" OR "b") AND ("c"): the text of a query to a literature service."""
    return " AND ".join("(" + " OR ".join(f'"{t}"' for t in g) + ")" for g in groups)


#: Texts that a worker holds as Python strings at a time.
_AT_ONCE = 64


@F.arrow_udf(StringType())
def nfkd_ascii(texts: pa.Array) -> pa.Array:
    """Compatibility decomposition without what is not ASCII; Spark has no built-in for it.

    A batch stays in Arrow; few of its texts are Python strings at a time.
    """
    plain = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    parts = [pa.array([plain(t) for t in texts.slice(k, _AT_ONCE).to_pylist()], pa.string()) for k in range(0, len(texts), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else texts


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Named and numeric entities to characters."""
    return texts.map(lambda t: None if t is None else html.unescape(t))
