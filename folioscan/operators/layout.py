"""From positioned spans to lines, and links between boxes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as G


def overlap_pairs(boxes: DataFrame, key: str, id_: str, cell: int = 100) -> DataFrame:
    """Pairs of boxes of a key that overlap: each box is put into the grid cells it touches, pairs meet in cells.

    A pair counts in the cell of its intersection's first corner only, so none comes twice.
    """
    xs, ys = (F.explode(F.sequence(F.floor(F.col(f"box.{c}0") / cell), F.floor(F.col(f"box.{c}1") / cell))) for c in "xy")
    dealt = boxes.select(key, id_, "box", xs.alias("cx")).select("*", ys.alias("cy"))
    a, b = dealt.alias("a"), dealt.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{id_}") < F.col(f"b.{id_}")))
    A, B = F.col("a.box"), F.col("b.box")
    first = (F.floor(F.greatest(A["x0"], B["x0"]) / cell) == F.col("a.cx")) & (F.floor(F.greatest(A["y0"], B["y0"]) / cell) == F.col("a.cy"))
    return both.filter(G.overlaps(A, B) & first).select(F.col(f"a.{key}").alias(key), F.col(f"a.{id_}").alias("a_id"), F.col(f"b.{id_}").alias("b_id"))


def _fold_lines(spans, grow: int) -> list[tuple]:
    """Lines (x0, x1, y0, y1, text) of one page's spans, which come in reading order."""

    def united(lines):
        out: list[tuple] = []
        for line in lines:
            x0, x1, y0, y1, text = line
            while out:
                u0, u1, v0, v1, before = out[-1]
                if u0 - grow > x1 or x0 - grow > u1 or v0 > y1 or y0 > v1:
                    break
                x0, x1, y0, y1 = min(u0, x0), max(u1, x1), min(v0, y0), max(v1, y1)
                text = before if text is None else text if before is None else f"{before} {text}"
                out.pop()
                if once:
                    break
            out.append((x0, x1, y0, y1, text))
        return out

    once = True  # a span joins the last line only
    lines = united(spans)
    once = False  # what grows by a merge may touch the line before it
    return united(lines)


def merge_lines(spans: DataFrame, key: str = "page", grow: int = 20) -> DataFrame:
    """Spans (page, span_id, x0, x1, y0, y1, text) to lines: the order-dependent fold of each page, many pages a batch.

    Spans in reading order join the line whose box, made wider by ``grow``,
    they touch; then neighbouring lines that touch are merged until none does.
    Spans without a whole box are left out; null texts add nothing. Spans are
    sorted by page and place, so the fold reads batches, in which pages are runs.
    """
    kind = spans.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, line int, x0 int, x1 int, y0 int, y1 int, text string"
    target = to_arrow_schema(StructType.fromDDL(schema))
    box = [F.col(c).cast("int").alias(c) for c in ("x0", "x1", "y0", "y1")]
    whole = spans.filter(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull())
    order = [key, "y0", "x0", "span_id", "x1", "y1", "text"]
    placed = whole.select(key, "span_id", *box, "text").repartition(key).sortWithinPartitions(*order).select(key, *target.names[2:])

    def run(batches):
        import pyarrow as pa

        def made(pages, lines):
            at = [(p, n, *line) for p, own in zip(pages, lines, strict=True) for n, line in enumerate(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*at, strict=True), target, strict=True)], schema=target)

        page, open_ = None, []  # the page that may go on in the next batch
        for batch in batches:
            pages, lines = [], []
            keys = batch.column(0).to_pylist()
            for k, span in zip(keys, zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True), strict=True):
                if k != page:
                    if open_:
                        pages.append(page)
                        lines.append(_fold_lines(open_, grow))
                    page, open_ = k, []
                open_.append(span)
            if pages:
                yield made(pages, lines)
        if open_:
            yield made([page], [_fold_lines(open_, grow)])

    return placed.mapInArrow(run, schema)


def page_frame(spans: DataFrame, header: float, footer: float, height: float) -> DataFrame:
    """Spans inside the page's body: not in its header or footer."""
    return spans.filter((F.col("y0") >= header) & (F.col("y1") <= height - footer))


def word_breaks(chars: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Characters after which a gap of more than 2.8 widths times the size follows."""
    from pyspark.sql import Window as W

    gap = F.lead("x0").over(W.partitionBy(*keys).orderBy(order)) - F.col("x1")
    return chars.withColumn("gap_", gap).filter(F.col("gap_") > 2.8 * F.col("width") * F.col("size")).drop("gap_")


def object_profile(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts by page and kind of object."""
    return objects.groupBy("page").pivot("object_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def image_name(page: str = "page", index: str = "index"):
    """The file name of an image: image_page_index_x0_x1_y0_y1."""
    return F.concat_ws("_", F.lit("image"), *[F.col(c).cast("string") for c in (page, index, "x0", "x1", "y0", "y1")])
