"""Column functions on paths (arrays of node names). All stay in the JVM as built-in higher-order functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subpaths(path: Column | str, min_len: int = 0, max_len: int | None = None) -> Column:
    """All proper contiguous sub-paths of min_len..max_len edges, with repeats; empty for a path of one node.

    The length bounds go into the generated sequence, so a consumer that needs lengths up to 2 never makes the longer ones.
    """
    p = col(path)
    top = F.size(p) - 2 if max_len is None else F.least(F.lit(max_len), F.size(p) - 2)
    grams = F.flatten(F.transform(F.sequence(F.lit(min_len), top), lambda k: F.transform(F.sequence(F.lit(1), F.size(p) - k), lambda i: F.slice(p, i, k + 1))))
    return F.when(top >= min_len, grams).otherwise(F.array().cast("array<array<string>>"))


def kgrams(path: Column | str, n: int) -> Column:
    """The n-node windows of a path, in order."""
    p = col(path)
    grams = F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.slice(p, i, n))
    return F.when(F.size(p) >= n, grams).otherwise(F.array().cast("array<array<string>>"))


def higher_order_nodes(path: Column | str, k: int) -> Column:
    """A path as nodes of order k; order 0 of one node is ['start', node]."""
    p = col(path)
    if k == 0:
        return F.concat(F.array(F.array(F.lit("start"))), F.transform(p, lambda v: F.array(v)))
    return kgrams(p, k)


def first_order_path(grams: Column | str) -> Column:
    """The node path of a sequence of overlapping k-grams."""
    g = col(grams)
    return F.concat(F.element_at(g, 1), F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda x: F.element_at(x, -1)))


def remove_repeats(path: Column | str) -> Column:
    """Drops nodes equal to their predecessor."""
    p = col(path)
    return F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1)))


def runs(path: Column | str, allowed: list[str]) -> Column:
    """Maximal runs of allowed nodes, in order."""
    p = col(path)
    known = F.array(*[F.lit(a) for a in allowed]) if allowed else F.array().cast("array<string>")
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("run"))

    def step(s: Column, x: Column) -> Column:
        closed = F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])
        inside = F.array_contains(known, x)
        return F.struct(F.when(inside, s["done"]).otherwise(closed).alias("done"), F.when(inside, F.concat(s["run"], F.array(x))).otherwise(F.array().cast("array<string>")).alias("run"))

    return F.aggregate(p, empty, step, lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))


def expand_sets(sets: Column | str) -> Column:
    """All paths that take one element of each position's array."""
    s = col(sets)
    one = F.array(F.array().cast("array<string>"))
    return F.aggregate(s, one, lambda acc, options: F.flatten(F.transform(acc, lambda a: F.transform(options, lambda o: F.concat(a, F.array(o))))))


def mapped(path: Column | str, mapping: dict[str, str]) -> Column:
    """Nodes replaced by labels; a node without one is an error."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    missing = lambda x: F.raise_error(F.concat(F.lit("no label for node "), x)).cast("string")
    return F.transform(col(path), lambda x: F.coalesce(F.try_element_at(table, x), missing(x)))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
