"""HTML and XML as relations: one parse for each document gives a row for each node."""
from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "ord int, parent int, depth int, sib int, kind string, tag string, text string, attrs map<string,string>, last_desc int, above array<int>"
ROWS = 4096
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = re.compile(r"(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>)", re.S | re.I)
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Builder(HTMLParser):
    """Tolerant: void elements close at once, some open elements close others, stray ends are dropped.

    entities: the names of the only entities that are decoded, each with its semicolon; None for all, as browsers do.
    """

    def __init__(self, entities: tuple[str, ...] | None = None):
        super().__init__(convert_charrefs=True)
        self.others = None if entities is None else re.compile(rf"&(?!(?:{'|'.join(map(re.escape, entities))});)")
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.kids: dict[int, int] = {}

    def _add(self, kind, tag, text, attrs) -> int:
        parent = self.stack[-1] if self.stack else -1
        sib = self.kids.get(parent, 0)
        self.kids[parent] = sib + 1
        self.rows.append([len(self.rows), parent, len(self.stack), sib, kind, tag, text, attrs, len(self.rows), list(self.stack)])
        return len(self.rows) - 1

    def _pop(self) -> None:
        self.rows[self.stack.pop()][8] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        while self.stack and self.rows[self.stack[-1]][5] in _CLOSES.get(tag, ()):
            self._pop()
        at = self._add("elem", tag, None, {k: v or "" for k, v in attrs})
        if tag not in _VOID:
            self.stack.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add("elem", tag, None, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if any(self.rows[i][5] == tag for i in self.stack):
            while self.rows[self.stack[-1]][5] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self._add("text", None, data, {})

    def feed(self, data):
        if self.others is None or "&" not in data:
            return super().feed(data)
        # what is not to be decoded is encoded, but for scripts and styles, where nothing is decoded
        super().feed("".join(part if k % 2 else self.others.sub("&amp;", part) for k, part in enumerate(_RAW.split(data))))

    def finish(self) -> list[tuple]:
        self.close()
        while self.stack:
            self._pop()
        return [tuple(r) for r in self.rows]


def parse_html(text: str | None, entities: tuple[str, ...] | None = None) -> list[tuple]:
    builder = _Builder(entities)
    builder.feed(text or "")
    return builder.finish()


def _parse_with(df: DataFrame, key: str, column: str, parse, schema: str) -> DataFrame:
    """key and the rows that ``parse`` makes of each document, in Arrow batches of about ROWS rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"{key} {df.schema[key].dataType.simpleString()}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(full))

    def batch_of(rows):
        columns = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(id_, *r) for r in parse(text)]
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return df.select(key, column).mapInArrow(run, full)


def html_nodes(pages: DataFrame, key: str = "page_id", column: str = "html", entities: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of HTML documents, well-formed or not: ord is preorder, last_desc the last node below.

    All entities are decoded, or only those named in ``entities``.
    """
    return _parse_with(pages, key, column, lambda text: parse_html(text, entities), NODE)


#: Elements that stay whole as one section; and those that are not looked into.
TERMINAL = frozenset((
    "abstract", "aff", "article-id", "article-categories", "author-notes", "caption", "contrib-group", "fig", "history", "issue", "journal_id",
    "journal-title-group", "kwd-group", "name", "notes", "p", "permissions", "person-group", "pub-date", "publisher", "ref", "table", "title",
    "title-group", "volume",
))
_CLOSED = frozenset({"disp-formula", "inline-formula"})
#: Characters that no section's name has.
_NAME = str.maketrans(dict.fromkeys("\t \n{}!@#$%^&*()[]:;'\",|\\~+=/`", "_"))


def parse_sections(xml: str | None, strict: bool = False) -> list[tuple]:
    """(path, ord, name, tag, kind, xml) of the terminal elements of a document, in document order.

    Terminal are the elements of TERMINAL and those without children; formulas
    with children give none. A section is named by the text its title begins with.
    Text that is no XML gives no rows, or with ``strict`` an error.
    """
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError as e:
        if strict:
            raise ValueError(f"no well-formed XML: {e}") from e
        return []
    out: list[tuple] = []
    local = lambda elem: elem.tag.split("}")[-1]

    def name(i: int, elem) -> str:
        title = local(elem)
        if title == "sec":
            title = next((t.text for t in elem if local(t) == "title"), None) or "UNKNOWN"
        return f"{i}_{title.translate(_NAME).lower()[:30]}"

    def walk(elem, path: str) -> None:
        for i, child in enumerate(elem):
            here, tag = f"{path}/{name(i, child)}", local(child)
            if tag in TERMINAL or not len(child):
                out.append((here, len(out), here.rsplit("/", 1)[-1], tag, "terminal", ET.tostring(child, encoding="unicode")))
            elif tag not in _CLOSED:
                walk(child, here)

    if root is not None and local(root) != "inline-formula":
        walk(root, "sections")
    return out


def xml_sections(docs: DataFrame, key: str = "doc_id", column: str = "xml", strict: bool = False) -> DataFrame:
    """A row for each terminal section; text that is no XML gives none, or with ``strict`` an error."""
    return _parse_with(docs, key, column, lambda x: parse_sections(x, strict), "path string, ord int, name string, tag string, kind string, xml string")


def inside(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with ``at``, a row for each element above: joins with ancestors are by (key, at), not by intervals."""
    return nodes.withColumn("at", F.explode("above"))


def text_content(nodes: DataFrame, key: str, tag: str) -> DataFrame:
    """key, ord, content: all text below each element with a tag."""
    own = nodes.filter((F.col("kind") == "elem") & (F.col("tag") == tag)).select(key, F.col("ord").alias("at"))
    texts = inside(nodes.filter(F.col("kind") == "text"), key).select(key, "at", "ord", "text")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    return texts.join(own, [key, "at"]).groupBy(key, F.col("at").alias("ord_")).agg(content.alias("content")).withColumnRenamed("ord_", "ord")


#: A path: steps with one or two slashes before a tag or *, and at most one test of an attribute.
_STEP = re.compile(r"(//?)([A-Za-z][\w-]*|\*)(?:\[(?:@([\w-]+)(?:='([^']*)')?|contains\(@([\w-]+), ?'([^']*)'\))\])?")


def parse_path(path: str) -> list[tuple[bool, str, Column]]:
    """(any depth, tag, test) of each step of a path such as //div[@class='x']/span; anything else is an error at once."""
    steps, at = [], 0
    while at < len(path):
        if not (m := _STEP.match(path, at)):
            raise ValueError(f"cannot read the path {path!r} at {path[at:]!r}")
        slashes, tag, has, value, part, contained = m.groups()
        test = F.lit(True)
        if has:
            test = F.col("attrs")[has].isNotNull() if value is None else F.col("attrs")[has] == value
        elif part:
            test = F.contains(F.col("attrs")[part], F.lit(contained))
        steps.append((slashes == "//", tag, F.coalesce(test, F.lit(False))))
        at = m.end()
    if not steps:
        raise ValueError("an empty path")
    return steps


def select_path(nodes: DataFrame, key: str, path: str) -> DataFrame:
    """The elements that a path selects: a step is an equi-join with the elements before it, by parent or by ancestors."""
    elems = nodes.filter("kind = 'elem'")
    found = None
    for deep, tag, test in parse_path(path):
        own = elems.filter(test if tag == "*" else (F.col("tag") == tag) & test)
        if found is None:
            found = own if deep else own.filter("parent = -1")
            continue
        before = found.select(key, F.col("ord").alias("at")).distinct()
        if deep:
            hit = inside(own, key).join(before, [key, "at"], "left_semi").select(key, "ord").distinct()
            found = own.join(hit, [key, "ord"], "left_semi")
        else:
            found = own.join(before.withColumnRenamed("at", "parent"), [key, "parent"], "left_semi")
    return found


def attr_equals(name: str, value: str) -> Column:
    """Whether an attribute is the value, white space apart."""
    return F.coalesce(F.trim(F.regexp_replace(F.col("attrs")[name], r"\s+", " ")) == " ".join(value.split()), F.lit(False))


def attr_has_word(name: str, word: str) -> Column:
    """Whether an attribute has the word among its words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.col("attrs")[name], r"\s+", " "), F.lit(" "))
    return F.coalesce(F.contains(padded, F.lit(f" {' '.join(word.split())} ")), F.lit(False))


def title_matches(title_: Column, wanted: Column, ignorecase: bool = True) -> Column:
    """Whether two titles are the same, without case by default; false where one is missing or empty."""
    a, b = (F.lower(title_), F.lower(wanted)) if ignorecase else (title_, wanted)
    return F.coalesce((a == b) & (a != ""), F.lit(False))


_SVG, _SVGX = "{http://www.w3.org/2000/svg}", "{http://www.xml-cml.org/schema/svgx}"
SVG_SPAN = "ord int, text string, x double, end_x double, y double, x0 double, x1 double, y0 double, y1 double, last_width double, size double, family string, weight string, style string, fill string, stroke string, rotated boolean"


def parse_svg(svg: str | None) -> list[tuple]:
    """The text elements of a page in SVG: content, place, box (as high as the font, and up), font and colours.

    Text that is no XML gives none; neither do elements without a place or a font size.
    """
    try:
        root = ET.fromstring(svg) if svg else None
    except ET.ParseError:
        return []
    out = []
    for i, e in enumerate(root.iter(f"{_SVG}text") if root is not None else ()):
        style = dict(part.split(":", 1) for part in e.get("style", "").split(";") if ":" in part)
        try:
            xs, widths = ([float(v) for v in e.get(k, "").split(",") if v.strip()] for k in ("x", f"{_SVGX}width"))
            x, y, size = xs[0], float(e.get("y", "")), float(style["font-size"].removesuffix("px"))
        except (ValueError, IndexError, KeyError):
            continue
        last = widths[-1] if widths else 0.0
        out.append((i, "".join(e.itertext()), x, xs[-1], y, x, xs[-1] + last * size, y - size, y, last, size, style.get("font-family"), style.get("font-weight"), style.get("font-style"), e.get("fill"), style.get("stroke"), bool(e.get("rotateDegrees"))))
    return out


#: The part of a page that holds content, as x and y ranges.
CONTENT = ((56, 999), (45, 780))


def svg_spans(pages: DataFrame, key: str, column: str = "svg", rotated: bool = False, content=CONTENT) -> DataFrame:
    """The spans of SVG pages that meet the content box and are not blank, with ``at``, their place in the order of y, then x.

    Rotated text is left out unless asked for.
    """
    from pyspark.sql import Window as W

    (left, right), (top, bottom) = content
    spans = _parse_with(pages, key, column, parse_svg, SVG_SPAN)
    spans = spans.filter((F.col("x1") >= left) & (F.col("x0") <= right) & (F.col("y1") >= top) & (F.col("y0") <= bottom) & F.col("text").rlike(r"\S"))
    spans = spans if rotated else spans.filter(~F.col("rotated"))
    return spans.withColumn("at", F.row_number().over(W.partitionBy(key).orderBy("y", "x", "ord")))


def html_page(title_: Column, body: Column, styles: dict[str, str] | None = None) -> Column:
    """A whole document around a body, with a head that has the encoding, the title and one style element."""
    css = "".join(f"{name} {{{value}}}\n" for name, value in (styles or {}).items())
    head = F.concat(F.lit('<html><head><meta charset="UTF-8"/><title>'), F.coalesce(escape(title_), F.lit("")), F.lit("</title>" + (f"<style>{css}</style>" if css else "") + "</head><body>"))
    return F.concat(head, F.coalesce(body, F.lit("")), F.lit("</body></html>"))


def escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def div_span(text: Column, style: str = "") -> Column:
    """A div with one span of the text."""
    return F.concat(F.lit(f'<div><span style="{style}">' if style else "<div><span>"), escape(text), F.lit("</span></div>"))


def hrefs(html: Column) -> Column:
    """The addresses of all anchors, from the text itself: no parse is needed for these."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), F.lit(""))


def tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<([a-z][a-z0-9]*)[ >/]"), F.lit(1))


def figure(xml: Column) -> Column:
    """(label, caption, title) of a figure; '' where missing. For well-formed XML."""
    return F.struct(*[F.coalesce(F.xpath_string(xml, F.lit(p)), F.lit("")).alias(n) for n, p in (("label", "fig/label"), ("caption", "fig/caption/p[1]"), ("title", "fig/caption/title"))])


def plain_text(xml: Column) -> Column:
    return F.xpath_string(xml, F.lit("/"))


def empty_elements(nodes: DataFrame, key: str) -> DataFrame:
    """Elements without text and without element children."""
    e, c = nodes.filter("kind = 'elem'"), nodes.select(key, F.col("parent").alias("ord"), F.when((F.col("kind") == "elem") | (F.trim("text") != ""), 1).alias("full"))
    return e.join(c.filter("full = 1").select(key, "ord").distinct(), [key, "ord"], "left_anti")


def entity_properties(nodes: DataFrame, key: str) -> DataFrame:
    """key, pid, name of an entity page: divs with a property id and the text of the first anchor in them."""
    divs = nodes.filter("kind = 'elem' AND attrs['data-property-id'] IS NOT NULL").select(key, F.col("attrs")["data-property-id"].alias("pid"), F.col("ord").alias("at"))
    texts = inside(nodes.filter("kind = 'text' AND trim(text) <> ''"), key).select(key, "at", "ord", "text")
    return texts.join(divs, [key, "at"]).groupBy(key, "pid").agg(F.min_by("text", "ord").alias("name"))


def same_tree(a: DataFrame, b: DataFrame) -> bool:
    """Whether two node tables hold the same trees."""
    cols = ["ord", "parent", "kind", "tag", "text"]
    x, y = (d.select(*cols, F.array_sort(F.map_entries("attrs")).alias("attrs")) for d in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
