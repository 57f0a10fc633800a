"""Array helpers shared by the text and record expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda argument is bound once, whereas an expression used inside another
    lambda would be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_SEP = "\u001f"


def strings(values: Iterable[str]) -> Column:
    """A literal ``array<string>``, also when empty; folded to a constant."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEP.join(values)), _SEP)


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first spelling of each value, in order.

    Sorting (value, position, spelling) brings equal values together; the heads of
    those runs, sorted by position again, are the answer: n log n, not n squared.
    """
    marks = F.sort_array(F.transform(items, lambda x, i: F.struct(
        F.lower(x).alias("low"), i.alias("at"), x.alias("x"))))
    heads = let(marks, lambda m: F.filter(m, lambda s, i: (i == 0) | (
        s["low"] != F.get(m, i - 1)["low"])))
    in_order = F.sort_array(F.transform(heads, lambda s: F.struct(s["at"].alias("at"), s["x"].alias("x"))))
    return F.transform(in_order, lambda s: s["x"])


def drop_blank(items: Column) -> Column:
    return F.filter(items, lambda x: F.trim(x) != "")


def split_list(text: Column, sep: str = ",") -> Column:
    """``'a, b,,c'`` to ``[a, b, c]``: trimmed, blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), sep)
    return drop_blank(F.transform(parts, lambda x: F.trim(x)))


def join_list(items: Column, sep: str = ",", max_chars: int | None = None) -> Column:
    joined = F.array_join(items, sep)
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def head(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def evaluate_once(df, **columns: Column):
    """Add columns behind a generator.

    Catalyst inlines computed columns into filters it pushes down, which would
    run an expensive text expression twice; it does not push through a generator.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    keep = [c for c in df.columns if c not in columns]
    out = df.select(*keep, packed.alias("_once"))
    return out.select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])


def merge_defaults(stored: Column, defaults: dict[str, str]) -> Column:
    """A map with every stored entry, and the default of each key that isn't stored."""
    given = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    kept = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return let(kept, lambda m: F.map_concat(
        F.map_filter(given, lambda k, _: ~F.map_contains_key(m, k)), m))
