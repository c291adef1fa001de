"""CSS text, class tokens and font names as maps, arrays and structs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_STYLES = ("font-style", "font-weight", "font-family", "font-size", "color", "opacity")


def css_items(style: Column) -> Column:
    return F.filter(F.transform(F.split(style, ";"), lambda x: F.trim(x)), lambda x: x != "")


def css_is_valid(style: Column) -> Column:
    """Each item has exactly one colon and names are distinct."""
    items = css_items(style)
    names = F.transform(items, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    return F.forall(items, lambda x: F.size(F.split(x, ":")) == 2) & (F.size(F.array_distinct(names)) == F.size(names))


def css_map(style: Column) -> Column:
    """The declarations of a valid style as a map; null for others."""
    entries = F.transform(css_items(style), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.trim(F.split_part(x, F.lit(":"), F.lit(2)))))
    return F.when(css_is_valid(style), F.map_from_entries(entries))


def css_render(style: Column) -> Column:
    """name: value; for each entry, names in order, so that equal maps give equal texts."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(style)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(";"))), " ")


def css_partition(style: Column, names=TEXT_STYLES) -> tuple[Column, Column]:
    """The named declarations and the rest."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.map_filter(style, lambda k, _: F.array_contains(listed, k)), F.map_filter(style, lambda k, _: ~F.array_contains(listed, k))


def css_put(style: Column, name: str, value: Column) -> Column:
    """Set a declaration; an empty value changes nothing."""
    other = F.map_filter(style, lambda k, _: k != name)
    return F.when(F.coalesce(value, F.lit("")) == "", style).otherwise(F.map_concat(other, F.create_map(F.lit(name), value)))


def css_drop(style: Column, *names: str) -> Column:
    return F.map_filter(style, lambda k, _: ~k.isin(*names))


def px(value: Column, places: int | None = None) -> Column:
    """The number of a value in px; null if it is none; rounded half to even, if asked."""
    number = F.regexp_replace(F.trim(value), "px$", "").try_cast("double")
    return number if places is None else F.bround(number, places)


def condition(style: Column, text: str) -> Column:
    """A test "name op number" of a style map, op one of > < == !=; false if the name is missing or no number."""
    name, op, number = text.split()
    left, right = px(F.try_element_at(style, F.lit(name))), F.lit(float(number))
    tests = {">": left > right, "<": left < right, "==": left == right, "!=": left != right}
    return F.coalesce(tests[op], F.lit(False))


def short_style(family: Column, size: Column, bold: Column, italic: Column) -> Column:
    return F.concat(F.lower(F.substring(family, 1, 3)), F.replace(size.cast("string"), F.lit("."), F.lit("_")), F.when(bold, "b").otherwise(""), F.when(italic, "i").otherwise(""))


def font(name: Column) -> Column:
    """(family, weight, style, stretch) of a font name, by cutting known parts off in turn."""
    left = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    found = {}
    for field, rules in (("stretch", (("Narrow", "Condensed|Cn|Narrow"), ("Wide", "Wide"))), ("weight", (("Light", "Light|Thin"), ("Bold", "Bold|Heavyweight|Black"))), ("style", (("Italic", "Italic|Ita|Oblique"),))):
        value = F.lit("")
        for says, pattern in rules:
            has = left.rlike(pattern)
            value = F.when(has & (value == ""), says).otherwise(value)
            left = F.regexp_replace(left, f"^(.*?)({pattern})(.*)$", "$1$3")
        found[field] = value
    return F.struct(F.replace(left, F.lit("-"), F.lit("")).alias("family"), found["weight"].alias("weight"), found["style"].alias("style"), found["stretch"].alias("stretch"))


def classes(s: Column) -> Column:
    """Class tokens, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != "")))


def add_class(s: Column, token: str) -> Column:
    return F.array_join(F.array_sort(F.array_union(classes(s), F.array(F.lit(token)))), " ")


def remove_class(s: Column, token: str) -> Column:
    return F.array_join(F.array_remove(classes(s), token), " ")


def replace_class(s: Column, old: str, new: str) -> Column:
    return F.array_join(F.array_sort(F.array_union(F.array_remove(classes(s), old), F.array(F.lit(new)))), " ")


def has_class(s: Column, token: str) -> Column:
    return F.array_contains(classes(s), token)


def head_style(line: Column) -> Column:
    """(ref, css) of a line ".ref {css}"; null for another."""
    pattern = r"^\s*(\..*?)\s+\{(.*)\}\s*$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("ref"), F.regexp_extract(line, pattern, 2).alias("css")))


def style_difference(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """name: a/b of each field that differs, nulls being equal."""
    return F.concat_ws(" ", *[F.when(~a[k].eqNullSafe(b[k]), F.concat(F.lit(f"{k}: "), F.coalesce(a[k].cast("string"), F.lit("")), F.lit("/"), F.coalesce(b[k].cast("string"), F.lit("")))) for k in a])
