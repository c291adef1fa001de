"""Rules that classify, number and link spans of text."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A class for texts that begin with the pattern; ``delete`` drops them.

    id and title are (group of the pattern, what goes before it); None sets none.
    """

    kind: str
    pattern: str
    delete: bool = False
    id: tuple[int, str] | None = None
    title: tuple[int, str] | None = None
    style: str = ""


#: The rules of climate reports.
RULES = (
    Rule("section_title", r"Section\s+(\d+):\s+(.*)", id=(1, "section_"), title=(2, ""), style="{color : blue; background : pink;}"),
    Rule("sub_section_title", r"\s*(\d+\.\d+)\s+(.*)", id=(1, "subsection_"), title=(2, ""), style="{color : green; background : yellow;}"),
    Rule("sub_sub_section_title", r"^\s*(\d+\.\d+\.\d+)\s+(.*)", id=(1, "subsection_"), title=(2, ""), style="{color : black; background : #dddddd;}"),
    Rule("confidence", r"^\s*\(?((very high|high|medium|low) confidence)\)?", title=(1, ""), style="{color : black; background : #dd88dd;}"),
    Rule("probability", r"^\s*\(?(likely|very likely|extremely likely|virtually certain)\)?", title=(1, ""), style="{color : cyan; background : #dd8888;}"),
    Rule("start", r"\s*\[?START\s*(FIGURE|TABLE)\s*(\d+\.\d+)\s*(HERE)?\]?", id=(2, "start_"), title=(1, "start_"), style="{color : green; background: pink}"),
    Rule("end", r"\s*\[?END\s*(FIGURE|TABLE)\s*(\d+\.\d+)\s*(HERE)?\]?", id=(2, "end_"), title=(1, "end_"), style="{color : green; background: blue}"),
    Rule("targets", r".*\{(.+)\}.*", title=(1, ""), style="{color : green; background: orange}"),
    Rule("cruft", r"^.*(Subject to Copy Edit |Adopted Longer Report IPCC AR6 SYR).*$", delete=True),
    Rule("page", r"^(p\.\d+)", title=(1, ""), style="{color : purple}"),
)


def _fits(text: Column, rule: Rule) -> Column:
    return text.rlike(f"(?d)^(?:{rule.pattern})")


def classify(text: Column, rules=RULES) -> Column:
    """The class of the last rule that fits, null if none does."""
    return F.coalesce(*[F.when(_fits(text, r), F.lit(r.kind)) for r in reversed(rules)])


def _made(text: Column, rules, what: str) -> Column:
    made = [(r, getattr(r, what)) for r in reversed(rules) if getattr(r, what)]
    return F.coalesce(*[F.when(_fits(text, r), F.concat(F.lit(before), F.regexp_extract(text, f"(?d)^(?:{r.pattern})", group))) for r, (group, before) in made]) if made else F.lit(None).cast("string")


def rule_id(text: Column, rules=RULES) -> Column:
    """The id of the last fitting rule that makes one."""
    return _made(text, rules, "id")


def rule_title(text: Column, rules=RULES) -> Column:
    """The title of the last fitting rule that makes one."""
    return _made(text, rules, "title")


def annotate(spans: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Spans with class, rule_id and rule_title; those that a deleting rule fits are left out."""
    gone = [_fits(F.col(text), r) for r in rules if r.delete]
    for bad in gone:
        spans = spans.filter(~F.coalesce(bad, F.lit(False)))
    rules = [r for r in rules if not r.delete]
    return spans.withColumn("class", classify(F.col(text), rules)).withColumn("rule_id", rule_id(F.col(text), rules)).withColumn("rule_title", rule_title(F.col(text), rules))


def mark_facts(spans: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The span before one of class confidence, of the same parent, becomes a fact."""
    w = W.partitionBy(*keys).orderBy(order)
    return spans.withColumn("class", F.when(F.coalesce(F.contains(F.lead("class").over(w), F.lit("confidence")), F.lit(False)), "fact").otherwise(F.col("class")))


def mark_footnotes(spans: DataFrame, size: float = 6.0) -> DataFrame:
    """Spans of a number in the footnotes' font size."""
    return spans.withColumn("class", F.when((F.col("size") == size) & F.trim("text").try_cast("double").isNotNull(), "footnote").otherwise(F.col("class")))


def without_unwanted(nodes: DataFrame, unwanted: list[tuple[str, str]]) -> DataFrame:
    """Nodes that no rule (class token, regex; '' for any text) drops."""
    bad = F.lit(False)
    for token, regex in unwanted:
        bad = bad | (F.array_contains("classes", token) & (F.col("text").rlike(regex) if regex else F.lit(True)))
    return nodes.filter(~F.coalesce(bad, F.lit(False)))


def mark_targets(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("{")) & F.contains(text, F.lit("}")), "targets")


def canonical_styles(styles: DataFrame) -> DataFrame:
    """Each class reference with the least one of the same style text."""
    least = styles.groupBy("style").agg(F.min("ref").alias("canonical"))
    return styles.join(least, "style").select("ref", "style", "canonical")


def resolve_links(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each id of an anchor (ids by comma or semicolon), with the target's text; unresolved ones stay, with nulls.

    anchors: a_id, a_text, links; targets: t_id, t_text.
    """
    ids = anchors.select("a_id", "a_text", F.explode(F.split("links", "[,;]")).alias("raw")).select("a_id", "a_text", F.trim("raw").alias("link_id"))
    return ids.filter("link_id <> ''").join(targets, F.col("link_id") == F.col("t_id"), "left")


def bad_links(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    return resolve_links(anchors, targets).filter("t_id IS NULL").select("a_id", "link_id").distinct()


def confidences(spans: DataFrame, keys: list[str], order: str = "ord", most: int = 50) -> DataFrame:
    """keys, statement, ord, part, class, level, text: a paragraph's spans cut into statements.

    A statement ends with a span of fewer than ``most`` characters that speaks of confidence; that span gets the class
    and the level before the word. A span with braces becomes what is before, in (class targets) and after them.
    Blank spans are left out.
    """
    from .islands import group_until

    kept = spans.filter(F.coalesce("text", F.lit("")) != "")
    ends = F.contains("text", F.lit("confidence")) & (F.length("text") < most)
    cut = group_until(kept, keys, order, ends, "statement").withColumn("ends_", ends)
    curly, said = r"(?d)^(.*)\{(.*)\}(.*)", r"^\s*\(?(.*)\s+confidence\s*\)?\s*(.*)"
    level = F.when(F.col("ends_") & F.col("text").rlike(said), F.regexp_extract("text", said, 1))
    one = lambda kind, text: F.struct(kind.cast("string").alias("class"), text.alias("text"))
    thirds = F.array(*[one(F.lit("targets" if i == 2 else None), F.regexp_extract("text", curly, i)) for i in (1, 2, 3)])
    parts = F.when(F.col("ends_"), F.array(one(F.lit("confidence"), F.col("text")))).when(F.col("text").rlike(curly), thirds).otherwise(F.array(one(F.lit(None), F.col("text"))))
    rows = cut.withColumn("level", level).select(*keys, "statement", order, "level", F.posexplode(parts).alias("part", "p"))
    return rows.select(*keys, "statement", order, "part", "p.class", "level", "p.text")


def followed_by_class(spans: DataFrame, keys: list[str], kind: str, order: str = "ord", name: str = "marks") -> DataFrame:
    """Whether the span after each has a class: how the number of a footnote is told from one in the text."""
    w = W.partitionBy(*keys).orderBy(order)
    return spans.withColumn(name, F.coalesce(F.lead("class").over(w) == kind, F.lit(False)))
