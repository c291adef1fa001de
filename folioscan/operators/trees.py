"""Operators on node and span tables: extraction, tidying, nesting, page frames, entity pages.

A node table has ord, parent, depth, kind, tag, text, attrs, last_desc for each
document key; a span table has ord, text and whatever else is named.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import style as S
from ..functions import text as T
from . import islands as I


def chunks(text: Column, chunk: str, splitter: str, node: str, keep_unmatched: bool = False) -> Column:
    """(chunk number, piece, kind) of the pieces of each chunk: kind is node where the piece begins so, else unmatched."""
    found = F.regexp_extract_all(text, F.lit(chunk), F.lit(1))
    pieces = F.flatten(F.transform(found, lambda c, i: F.transform(F.split(c, splitter), lambda p: F.struct(i.alias("chunk"), F.trim(p).alias("piece"), F.when(T.prefix_match(F.trim(p), node), "node").otherwise("unmatched").alias("kind")))))
    return pieces if keep_unmatched else F.filter(pieces, lambda p: p["kind"] == "node")


def group_values(df: DataFrame, keys: list[str], text: str, group: str, split: str, item: str) -> DataFrame:
    """Three levels: each {...} of a text, its parts, and (name, value) by the item pattern; names that do not fit are "unmatched".

    One row for each group and name, with the list of values in order.
    """
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(group), F.lit(1))).alias("grp", "g")).select(*keys, "grp", F.posexplode(F.split("g", split)).alias("pos", "part"))
    fits = F.trim("part").rlike(f"^(?:{item})")
    name = F.when(fits, F.regexp_extract(F.trim("part"), f"^(?:{item})", 1)).otherwise("unmatched")
    value = F.when(fits, F.regexp_extract(F.trim("part"), f"^(?:{item})", 2)).otherwise(F.trim("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    return rows.withColumn("name", name).withColumn("value", value).groupBy(*keys, "grp", "name").agg(listed.alias("values"))


def extract(text: Column, pattern: str, body: int = 2) -> Column:
    """(body, rest) of a text that the pattern (pre)(body)(post) fits as a whole start; null where it does not."""
    whole = f"^(?:{pattern})"
    rest = F.concat(F.regexp_extract(text, whole, body - 1), F.regexp_extract(text, whole, body + 1))
    return F.when(text.rlike(whole), F.struct(F.regexp_extract(text, whole, body).alias("body"), rest.alias("rest")))


def section_ids(div: Column, span: Column, section: str, subsection: str) -> Column:
    """(kind, id): the section pattern on the div comes first, then the subsection pattern on its span."""
    a, b = F.regexp_extract(div, f"^(?:{section})", 1), F.regexp_extract(span, f"^(?:{subsection})", 1)
    return F.when(a != "", F.struct(F.lit("section").alias("kind"), a.alias("id"))).when(b != "", F.struct(F.lit("subsection").alias("kind"), b.alias("id")))


def page_boxes(nodes: DataFrame, key: str, least: float = 300.0) -> DataFrame:
    """key, ord, page: absolute spans higher than ``least`` with the number in the name of the anchor that follows."""
    elems = nodes.filter("kind = 'elem'").withColumn("css", S.css_map(F.coalesce(F.col("attrs")["style"], F.lit(""))))
    follows = F.lead(F.when(F.col("tag") == "a", F.col("attrs")["name"])).over(W.partitionBy(key, "parent").orderBy("ord"))
    boxes = elems.withColumn("page", follows.try_cast("int"))
    tall = S.px(F.try_element_at("css", F.lit("height"))) > least
    return boxes.filter((F.col("tag") == "span") & (F.try_element_at("css", F.lit("position")) == "absolute") & tall).select(key, "ord", "page")


def property_maps(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, pid, name, statements (title -> value), value (the last untitled one): rows have ord, pid, name, title, value."""
    titled = F.collect_list(F.when(F.col("title").isNotNull(), F.struct("ord", "title", "value")))
    last = F.map_from_entries(F.transform(F.array_sort(titled), lambda s: F.struct(s["title"], s["value"])))
    one = rows.withColumn("again_", F.row_number().over(W.partitionBy(entity, "pid", "title").orderBy(F.desc("ord")))).filter("again_ = 1 OR title IS NULL")
    return one.groupBy(entity, "pid", "name").agg(last.alias("statements"), F.max_by(F.when(F.col("title").isNull(), F.col("value")), F.when(F.col("title").isNull(), F.col("ord"))).alias("value"))


def drop_styled(nodes: DataFrame, conditions: list[str]) -> DataFrame:
    """Nodes whose style meets no condition; texts are nodes of their own, so nothing has to be attached again."""
    css = S.css_map(F.coalesce(F.col("attrs")["style"], F.lit("")))
    bad = F.lit(False)
    for c in conditions:
        bad = bad | S.condition(F.coalesce(css, F.create_map().cast("map<string,string>")), c)
    return nodes.filter(~bad)


def single_heading(spans: DataFrame, key: str, prefix: str, low: float, high: float) -> DataFrame:
    """The span of each key that begins so, in a bold font of that size range, if there is exactly one."""
    found = spans.filter(F.startswith("text", F.lit(prefix)) & F.col("font").rlike("(?i)bold") & F.col("size").between(low, high))
    return found.withColumn("n_", F.count("*").over(W.partitionBy(key))).filter("n_ = 1").drop("n_")


def body_spans(spans: DataFrame, tops: DataFrame, key: str, header: float, footer: float, page: float) -> DataFrame:
    """Spans on one long page with y relative to their page's top, without those in header or footer."""
    at = I.asof(spans, tops, key, "y", "top").withColumn("rel", F.col("y") - F.col("top"))
    return at.filter((F.col("rel") >= header) & (F.col("rel") <= page - footer))


def nest(divs: pd.DataFrame) -> pd.DataFrame:
    """The stack machine of one document: rows in order, with class and text.

    section, sub_section and sub_sub_section (or these with _title) open levels 1 to 3 under the
    level above (not without one; deeper levels stay open), start marks push
    a float, end marks pop it; anything else goes under what is open.
    """
    levels = {"section": 1, "sub_section": 2, "sub_sub_section": 3}
    parents: dict[int, int] = {0: -1}
    current, floats, out = -1, [], []
    for r in divs.sort_values("ord").to_dict("records"):
        level = levels.get((r["class"] or "").removesuffix("_title"))
        if level and level - 1 in parents:
            out.append((r["ord"], parents[level - 1], level, len(floats)))
            parents[level] = current = r["ord"]
        elif r["class"] == "start":
            out.append((r["ord"], floats[-1] if floats else current, None, len(floats)))
            floats.append(r["ord"])
        elif r["class"] == "end":
            out.append((r["ord"], floats.pop() if floats else current, None, len(floats)))
        else:
            out.append((r["ord"], floats[-1] if floats else current, None, len(floats)))
    return pd.DataFrame(out, columns=["ord", "parent", "level", "floats"]).astype({"level": "Int64"})


def nested(divs: DataFrame, key: str) -> DataFrame:
    """key, ord, parent (-1: the document), level, floats: the stack machine for each document."""
    kind = divs.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = nest(pdf)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return divs.select(key, "ord", "class", "text").groupBy(key).applyInPandas(run, f"{key} {kind}, ord long, parent long, level long, floats int")


def merge_continued(divs: DataFrame, key: str, order: str = "ord", text: str = "text") -> DataFrame:
    """Divs joined to the one before where they begin in lower case."""
    starts = ~F.col(text).rlike(r"^\s*\p{Ll}")
    cut = I.group_from(divs, [key], order, starts, "div")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return cut.groupBy(key, "div").agg(F.min(order).alias(order), joined.alias(text))


def delete_nodes(nodes: DataFrame, key: str, bad: Column, keep_text: bool = True) -> DataFrame:
    """Nodes without the bad elements; their own texts stay, or with keep_text=False go with all below them."""
    if keep_text:
        return nodes.filter(~((F.col("kind") == "elem") & F.coalesce(bad, F.lit(False))))
    gone = nodes.filter((F.col("kind") == "elem") & F.coalesce(bad, F.lit(False))).select(key, F.col("ord").alias("at"))
    below = nodes.select(key, "ord", F.explode(F.array_append("above", F.col("ord"))).alias("at")).join(gone, [key, "at"], "left_semi").select(key, "ord").distinct()
    return nodes.join(below, [key, "ord"], "left_anti")


def paragraphs_of_page(spans: DataFrame, key: str, gap: float, order: str = "ord") -> DataFrame:
    """key, paragraph, run, family, size, text: a new paragraph after a large step down, a new run where the font changes."""
    w = W.partitionBy(key).orderBy(order)
    first = F.lag(order).over(w).isNull()
    rows = I.group_from(spans, [key], order, first | (F.abs(F.col("y0") - F.lag("y0").over(w)) > gap), "paragraph")
    w = W.partitionBy(key, "paragraph").orderBy(order)
    changed = F.lag(order).over(w).isNull() | (F.col("family") != F.lag("family").over(w)) | (F.col("size") != F.lag("size").over(w))
    rows = I.group_from(rows, [key, "paragraph"], order, changed, "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), " ")
    return rows.groupBy(key, "paragraph", "run", "family", "size").agg(joined.alias("text"))


def list_items(spans: DataFrame, key: str, order: str = "ord", mark: Column | None = None) -> DataFrame:
    """key, item, text: an item begins at each whole number, or at those alone where ``mark`` holds (a small or raised font)."""
    starts = T.is_int(F.col("text")) if mark is None else T.is_int(F.col("text")) & F.coalesce(mark, F.lit(False))
    cut = I.group_from(spans, [key], order, starts, "item")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), " ")
    return cut.groupBy(key, "item").agg(joined.alias("text"))


def heading_chunks(divs: DataFrame, key: str, pattern: str, low: float, high: float, order: str = "ord") -> DataFrame:
    """Divs with the number of the chunk that a bold heading of some size and form begins."""
    starts = F.col("font").rlike("(?i)bold") & F.col("size").between(low, high) & T.prefix_match(F.col("text"), pattern)
    return I.group_from(divs, [key], order, F.coalesce(starts, F.lit(False)), "chunk")


def is_footnote_mark(text: Column, size: Column, body_size: Column) -> Column:
    """A small whole number."""
    return T.is_int(text) & (size < 0.9 * body_size)


def neighbours(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with the next and the previous element's ord in document order."""
    w = W.partitionBy(key).orderBy("ord")
    return nodes.filter("kind = 'elem'").withColumn("next_ord", F.lead("ord").over(w)).withColumn("previous_ord", F.lag("ord").over(w))


def unique_prefix(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """The one name that begins with the prefix, counted in partial sums; nothing if several do."""
    found = names.filter(F.startswith(name, F.lit(prefix))) if prefix else names.limit(0)
    return found.agg(F.min(name).alias(name), F.count("*").alias("n_")).filter("n_ = 1").select(name)


def latest(store: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """The last content of each path."""
    return store.groupBy(key).agg(F.max_by("content", version).alias("content"))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that come more than once, with counts."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def levels(ids: DataFrame, id_: str = "id") -> DataFrame:
    """level, ids: dotted ids by depth, in the order of their numbers."""
    rows = ids.select(F.size(F.split(id_, r"\.")).alias("level"), F.struct(T.natural_key(F.col(id_)).alias("k"), F.col(id_).alias("id")).alias("s"))
    return rows.groupBy("level").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["id"]).alias("ids"))


def char_style(c: Column) -> Column:
    """A style map of a character's struct; null for one that does not stand upright."""
    entries = F.create_map(
        F.lit("font-family"), c["fontname"], F.lit("font-size"), F.concat(F.bround(c["size"], 2).cast("string"), F.lit("px")), F.lit("left"), F.concat(F.bround(c["x0"], 2).cast("string"), F.lit("px")),
        F.lit("color"), F.coalesce(c["non_stroking_color"], F.lit("")),
    )
    return F.when(c["upright"] == 1, entries)


def best_candidate(found: DataFrame, lang: str) -> DataFrame:
    """term, qid, label: of the candidates in a language an exact label first, then the lowest rank."""
    order = W.partitionBy("term").orderBy((F.lower("label") == F.lower("term")).desc(), "rank", "qid")
    return found.filter(F.col("lang") == lang).withColumn("at_", F.row_number().over(order)).filter("at_ = 1").select("term", "qid", "label")


def json_filter(rows: DataFrame, spec: str) -> DataFrame:
    """Rows that a JSON filter {"description", "regex", "property_value": {name: value}} accepts: description contains, label fits, properties are equal."""
    import json

    rule = json.loads(spec).get("filter", json.loads(spec))
    test = F.lit(True)
    if rule.get("description"):
        test = test & F.contains(F.lower("description"), F.lit(rule["description"].lower()))
    if rule.get("regex"):
        test = test & T.prefix_match(F.col("label"), rule["regex"])
    for name, value in (rule.get("property_value") or {}).items():
        test = test & (F.try_element_at("properties", F.lit(name)) == value)
    return rows.filter(F.coalesce(test, F.lit(False)))


def distinct_images(images: DataFrame) -> DataFrame:
    """One row for each (size, bytes), the first in order of page and place, with how often it comes."""
    return images.groupBy("size", "bytes").agg(F.min(F.struct("page", "x", "y")).alias("first"), F.count("*").alias("n")).select("size", "bytes", "first.*", "n")


def table_cells(tables: DataFrame) -> DataFrame:
    """table_id, row, col, text of tables given as arrays of rows of cells."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


def tidy(spans: DataFrame, key: str, rules) -> DataFrame:
    """The annotation run of a document: classes and ids by rules, divs that go on joined, then nested."""
    from . import annotate as A

    marked = A.annotate(merge_continued(spans, key), "text", rules)
    return marked.join(nested(marked.withColumn("class", F.coalesce("class", F.lit(""))), key), [key, "ord"])


def in_range(number: Column, low: float, high: float) -> Column:
    """Whether a number lies in a closed range, whose lower end comes first and is not 0."""
    if low > high or not low:
        raise ValueError("a range needs a lower end that is not 0 and an upper one not below it")
    return number.between(low, high)


def run_path_rule(nodes: DataFrame, key: str, path: str, html_class: str | None = None, delete: bool = False) -> DataFrame:
    """Nodes with the class set on all elements that a path selects, or with ``delete`` without each document's first one and what is below it."""
    from ..sources.markup import select_path

    found = select_path(nodes, key, path).select(key, "ord")
    if delete:
        first = found.groupBy(key).agg(F.min("ord").alias("first_"))
        return delete_nodes(nodes.join(first, key, "left"), key, F.col("ord") == F.col("first_"), keep_text=False).drop("first_")
    marked = nodes.join(found.withColumn("hit_", F.lit(True)), [key, "ord"], "left")
    put = F.map_concat(F.map_filter("attrs", lambda k, _: k != "class"), F.create_map(F.lit("class"), F.lit(html_class)))
    return marked.withColumn("attrs", F.when(F.col("hit_"), put).otherwise(F.col("attrs"))).select(*nodes.columns)


def decimal_sections(nodes: DataFrame, key: str, path: str, pattern: str = r"\d+(\.\d+)+") -> DataFrame:
    """key, ord, number, text: elements of a path whose own text begins with a dotted number."""
    from ..sources.markup import select_path

    own = nodes.filter("kind = 'text'").groupBy(key, F.col("parent").alias("ord")).agg(F.min_by("text", "sib").alias("text"))
    found = select_path(nodes, key, path).select(key, "ord").join(own, [key, "ord"])
    number = F.regexp_extract("text", rf"^\s*({pattern})\s", 1)
    return found.select(key, "ord", number.alias("number"), "text").filter("number <> ''")


def tidy_nodes(nodes: DataFrame, key: str, left: float = 49.0, font: float = 30.0, names=("position", "border", "writing-mode", "width", "left", "height"), unwanted: tuple = ()) -> DataFrame:
    """A node table tidied: breaks taken out, line numbers at the left edge and large fonts dropped with what is below them, then
    empty spans and divs; style names removed, line feeds in texts made spaces, elements without an id numbered.

    left: line numbers are numbers in an element that starts left of it; unwanted: paths of elements to drop as well.
    """
    from ..sources.markup import empty_elements, select_path

    css = S.css_map(F.coalesce(F.col("attrs")["style"], F.lit("")))
    value = lambda n: S.px(F.try_element_at(css, F.lit(n)))
    out = nodes.filter("NOT (kind = 'elem' AND tag = 'br')")
    own = out.filter("kind = 'text'").groupBy(key, F.col("parent").alias("ord")).agg(F.min_by("text", "sib").alias("own_"))
    flagged = out.join(own, [key, "ord"], "left")
    bad = ((value("left") < left) & F.col("own_").rlike(r"^\s*\d+\s*$")) | (value("font-size") > font)
    out = delete_nodes(flagged, key, bad, keep_text=False).drop("own_")
    for path in unwanted:
        gone = select_path(out, key, path).select(key, "ord").withColumn("gone_", F.lit(True))
        out = delete_nodes(out.join(gone, [key, "ord"], "left"), key, F.col("gone_"), keep_text=False).drop("gone_")
    empty = empty_elements(out, key).filter(F.col("tag").isin("span", "div")).select(key, "ord")
    out = out.join(empty, [key, "ord"], "left_anti")
    style = F.array_join(F.transform(F.filter(S.css_items(F.col("attrs")["style"]), lambda i: ~F.trim(F.split_part(i, F.lit(":"), F.lit(1))).isin(*names)), lambda i: F.concat(i, F.lit(";"))), " ")
    other = F.map_filter("attrs", lambda k, _: k != "style")
    attrs = F.when(F.coalesce(style, F.lit("")) != "", F.map_concat(other, F.create_map(F.lit("style"), style))).otherwise(other)
    attrs = F.when((F.col("kind") == "elem") & F.col("attrs")["id"].isNull(), F.map_concat(attrs, F.create_map(F.lit("id"), F.concat(F.lit("id"), F.col("ord").cast("string"))))).otherwise(attrs)
    return out.withColumn("attrs", attrs).withColumn("text", F.regexp_replace("text", r"\n", " "))


def repeated_groups(df: DataFrame, keys: list[str], text: str, group: str, split: str) -> DataFrame:
    """value, n: how often each part of the groups of a text comes, in texts that have more than one group."""
    found = df.select(*keys, F.regexp_extract_all(F.col(text), F.lit(group), F.lit(1)).alias("g")).filter(F.size("g") > 1)
    parts = found.select(F.explode("g").alias("g")).select(F.explode(F.split("g", split)).alias("value")).select(F.trim("value").alias("value")).filter("value <> ''")
    return parts.groupBy("value").agg(F.count("*").alias("n"))


def edges_in_box(edges: DataFrame, x0: float, x1: float, y0: float, y1: float, least: float = 2.0) -> DataFrame:
    """Edges at least so wide and high with an end in the box, its sides included: ax, ay, bx, by."""
    big = (F.abs(F.col("ax") - F.col("bx")) >= least) & (F.abs(F.col("ay") - F.col("by")) >= least)
    end = lambda p: F.col(f"{p}x").between(x0, x1) & F.col(f"{p}y").between(y0, y1)
    return edges.filter(big & (end("a") | end("b")))


def sorted_spans(spans: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Spans with ``at``, their place in their page from 1: by y, then x, then as they came."""
    return spans.withColumn("at", F.row_number().over(W.partitionBy(key).orderBy("y", "x", order)))


def columns_of(names: list[str], kind: str = "string") -> str:
    """A schema of named columns; blank names, names with spaces and repeated ones are errors."""
    if not names or not isinstance(names, list):
        raise ValueError("give a list of names")
    for i, name in enumerate(names):
        if not name.strip() or " " in name:
            raise ValueError(f"no name: {name!r}")
        if name in names[:i]:
            raise ValueError(f"{name} comes twice")
    return ", ".join(f"`{name}` {kind}" for name in names)


def figure_captions(docs: DataFrame, key: str = "doc_id", column: str = "xml") -> DataFrame:
    """key, path, label, caption, title of every figure of the documents."""
    from ..sources.markup import figure, xml_sections

    figures = xml_sections(docs, key, column).filter("tag = 'fig'").withColumn("f", figure(F.col("xml")))
    return figures.select(key, "path", "f.*")
