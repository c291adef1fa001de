"""Ordered-sequence operators as windows over a key and an order: islands, runs, fills, as-of."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def upto(keys: list[str], order: str, end: int = 0):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, end)


def group_from(df: DataFrame, keys: list[str], order: str, starts: Column, name: str = "grp") -> DataFrame:
    """Numbers groups; a row where ``starts`` holds begins one (rows before the first are group 0)."""
    return df.withColumn("start_", starts.cast("long")).withColumn(name, F.sum("start_").over(upto(keys, order))).drop("start_")


def group_until(df: DataFrame, keys: list[str], order: str, ends: Column, name: str = "grp") -> DataFrame:
    """Numbers groups; a row where ``ends`` holds is the last of one."""
    return df.withColumn("end_", ends.cast("long")).withColumn(name, F.coalesce(F.sum("end_").over(upto(keys, order, -1)), F.lit(0))).drop("end_")


def runs(df: DataFrame, keys: list[str], order: str, value: str, text: str) -> DataFrame:
    """keys, run, value, text, n: consecutive rows with equal value, their texts joined by spaces."""
    w = W.partitionBy(*keys).orderBy(order)
    cut = group_from(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return cut.groupBy(*keys, "run", value).agg(joined.alias(text), F.count("*").alias("n"))


def fill_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(keys, order)))


def paragraph_ids(df: DataFrame, keys: list[str], order: str, title: Column) -> DataFrame:
    """title.a, title.b, ... by place among the rows of the keys."""
    at = (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("int")
    return df.withColumn("paragraph_id", F.concat(title, F.lit("."), T.letter_id(at)))


def number_ids(df: DataFrame, keys: list[str], order: str, prefix: str = "id") -> DataFrame:
    return df.withColumn("id", F.concat(F.lit(prefix), (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("string")))


def asof(points: DataFrame, tops: DataFrame, key: str, at: str, top: str) -> DataFrame:
    """Points with the greatest top <= at of their key; null before the first top and from the last one on.

    Both sides are sorted once by one window: no range join. Payload columns of
    the points pass through.
    """
    cols = [c for c in points.columns if c not in (key, at)]
    marks = tops.select(key, F.col(top).alias(at), F.lit(0).alias("kind_"), F.col(top).alias("top_"), F.max(top).over(W.partitionBy(key)).alias("last_"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols])
    rows = points.select(key, at, F.lit(1).alias("kind_"), F.lit(None).cast(tops.schema[top].dataType).alias("top_"), F.lit(None).cast(tops.schema[top].dataType).alias("last_"), *cols)
    order = W.partitionBy(key).orderBy(at, "kind_").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn(top, F.last("top_", ignorenulls=True).over(order)).withColumn("last_", F.last("last_", ignorenulls=True).over(order))
    return both.filter("kind_ = 1").select(key, at, *cols, F.when(F.col(top) < F.col("last_"), F.col(top)).alias(top))


def spans_from_chars(chars: DataFrame, keys: list[str], order: str, font: list[str], y: str, text: str, tolerance: float = 1.0) -> DataFrame:
    """Characters to spans: a new one where the font or the line changes."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.lit(False)
    for c in font:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    changed = changed | (F.abs(F.col(y) - F.lag(y).over(w)) > tolerance) | F.lag(order).over(w).isNull()
    cut = group_from(chars, keys, order, F.coalesce(changed, F.lit(True)), "span")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return cut.groupBy(*keys, "span").agg(joined.alias(text), *[F.min_by(c, order).alias(c) for c in font], F.min_by(y, order).alias(y))


def spans_from_upright(chars: DataFrame, keys: list[str], order: str, font: list[str], y: str, text: str, tolerance: float = 0.1, upright: str | None = None) -> DataFrame:
    """Characters to spans as a page's text has them: white space never begins one.

    A character that is no space begins a span where the font or the line differs from the last such character's. White
    space joins the span on whose line it stands, and is dropped elsewhere. upright: only characters where it is 1.
    """
    if upright:
        chars = chars.filter(F.col(upright) == 1)
    solid = F.trim(F.col(text)) != ""
    before = upto(keys, order, -1)
    last = lambda c: F.last(F.when(solid, F.col(c)), ignorenulls=True).over(before)
    fresh = last(order).isNull() | (F.abs(F.col(y) - last(y)) > tolerance)
    changed = fresh
    for c in font:
        changed = changed | ~F.col(c).eqNullSafe(last(c))
    cut = group_from(chars.withColumn("fresh_", fresh), keys, order, F.coalesce(solid & changed, F.lit(False)), "span")
    cut = cut.filter(solid | ~F.col("fresh_"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return cut.groupBy(*keys, "span").agg(joined.alias(text), *[F.min_by(c, order).alias(c) for c in font], F.min_by(y, order).alias(y))


def script_kind(df: DataFrame, keys: list[str], order: str, size: str, y: str, up: bool = False) -> DataFrame:
    """sub or super where a span is smaller than 0.9 of the one before and lower or higher than it (y grows downwards, or up)."""
    w = W.partitionBy(*keys).orderBy(order)
    small, dy = F.col(size) < 0.9 * F.lag(size).over(w), F.col(y) - F.lag(y).over(w)
    below, above = (dy < 0, dy > 0) if up else (dy > 0, dy < 0)
    return df.withColumn("script", F.when(small & below, "sub").when(small & above, "super"))


def mode_breaks(df: DataFrame, keys: list[str], order: str, y: str, factor: float = 1.5) -> DataFrame:
    """paragraph numbers: a row whose distance from the one before exceeds factor times the most frequent distance starts one.

    Equal frequencies go to the smaller distance. The first row has no distance and is not returned.
    """
    w = W.partitionBy(*keys).orderBy(order)
    gaps = df.withColumn("gap", F.round(F.col(y) - F.lag(y).over(w), 2)).filter("gap IS NOT NULL")
    counted = gaps.groupBy(*keys, "gap").agg(F.count("*").alias("n_"))
    mode = counted.groupBy(*keys).agg(F.max_by("gap", F.struct("n_", -F.col("gap"))).alias("mode"))
    return group_from(gaps.join(mode, keys), keys, order, F.abs(F.col("gap")) > factor * F.abs(F.col("mode")), "paragraph")


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of each key: intercept, slope, r2."""
    fits = [f(F.col(y), F.col(x)) for f in (F.regr_intercept, F.regr_slope, F.regr_r2)]
    return df.groupBy(*keys).agg(*[F.round(f, 6).alias(n) for f, n in zip(fits, ("intercept", "slope", "r2"), strict=True)])


def accept_numbers(df: DataFrame, key: str, order: str, number: str, step: int = 5) -> DataFrame:
    """Accepts a number when 0 <= number - last accepted < step, last starting at 0: a fold over each key's rows.

    Acceptance depends on what was accepted before, so each key is folded over its ordered rows.
    """
    picked = F.array_sort(F.collect_list(F.struct(order, number)))
    fold = F.aggregate("rows_", F.struct(F.lit(0).cast("long").alias("last"), F.array().cast(f"array<struct<ord:bigint,num:bigint>>").alias("got")), lambda s, r: F.when(
        (r[number] - s["last"] >= 0) & (r[number] - s["last"] < step),
        F.struct(r[number].cast("long").alias("last"), F.array_append(s["got"], F.struct(r[order].cast("long").alias("ord"), r[number].cast("long").alias("num"))).alias("got"))).otherwise(s))
    out = df.groupBy(key).agg(picked.alias("rows_")).select(key, F.inline(fold["got"]))
    return out.toDF(key, order, number)


def float_extents(marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, object, id, first, last for boundaries (start_end, object, id) that come as exactly one pair."""
    found = marks.groupBy(*keys, "object", "id").agg(F.count("*").alias("n_"), F.min(order).alias("first"), F.max(order).alias("last"))
    return found.filter("n_ = 2").drop("n_")


def boundary(text: Column) -> Column:
    """(start_end, object, id) of a mark [START BOX 1.1 HERE]; null for other texts."""
    pattern = r"^\s*\[?(START|END)\s+(BOX|FIGURE|TABLE)\s+(\S+)\s+HERE\]?\s*$"
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i).alias(n) for i, n in ((1, "start_end"), (2, "object"), (3, "id"))]))


def section_tree(divs: DataFrame, key: str, order: str, level: str, id_: str) -> DataFrame:
    """Each row's parent: the last row with a smaller level before it, as windows of one level each."""
    levels = (1, 2, 3)
    last = {k: F.last(F.when(F.col(level) == k, F.col(id_)), ignorenulls=True).over(upto([key], order, -1)) for k in levels}
    parent = F.when(F.col(level) == 1, F.lit(None)).when(F.col(level) == 2, last[1]).when(F.col(level) == 3, last[2])
    at = {k: F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(upto([key], order, -1)) for k in levels}
    deepest = F.greatest(*[F.coalesce(at[k], F.lit(-1)) for k in levels])
    body = F.coalesce(*[F.when(at[k] == deepest, last[k]) for k in levels])
    return divs.withColumn("parent", F.when(F.col(level).isNull(), body).otherwise(parent))


def distinct_points(points: DataFrame, key: str, order: str, x: str, y: str, tol: float) -> DataFrame:
    """Points without those within L1 distance tol of one kept before, in order; a fold over each key's points."""
    got = F.aggregate("rows_", F.array().cast("array<struct<ord:bigint,x:double,y:double>>"), lambda kept, p: F.when(
        F.exists(kept, lambda k: F.abs(k["x"] - p[x]) + F.abs(k["y"] - p[y]) < tol), kept
    ).otherwise(F.array_append(kept, F.struct(p[order].cast("long").alias("ord"), p[x].cast("double").alias("x"), p[y].cast("double").alias("y")))))
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, x, y))).alias("rows_"))
    return rows.select(key, F.inline(got)).toDF(key, order, x, y)


def sample_log(df: DataFrame, level: str, order: str, initial: int = 10, routine: int = 100) -> DataFrame:
    """The first rows of each level, then every routine-th."""
    n = F.row_number().over(W.partitionBy(level).orderBy(order))
    return df.withColumn("count", n).filter((F.col("count") <= initial) | (F.col("count") % routine == 1))
