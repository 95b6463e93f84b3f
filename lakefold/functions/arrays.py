"""Array helpers shared by the per-document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Exclusive running sums of an ``array<int>``, as an array of the same size.

    A single fold that appends to its own output copies the output once per element.  Folding
    blocks of fixed size and then shifting every block by the total of the blocks before it keeps
    that cost linear in practice, without exploding the row and shuffling it.
    """
    empty = F.array().cast("array<int>")

    def scan(items: Column, start: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(start.alias("run"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["run"] + x).alias("run"), F.array_append(acc["out"], acc["run"]).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def split(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
        return F.when(F.size(items) > 0, F.transform(numbers, lambda b: F.slice(items, b * _BLOCK + 1, _BLOCK))).otherwise(
            F.array().cast("array<array<int>>")
        )

    def join(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0)), scan))

    return let(let(values, split), join)


def at(array: Column, index: Column | int) -> Column:
    """Zero-based element, null when out of range."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    Column expressions have no local names: a sub-expression that appears three times is built and
    evaluated three times, and nesting multiplies that.  A one-element array binds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(array: Column | str) -> Column:
    """The same array, for a generator to spread.

    The optimizer guards a generator over a plain column with a filter on the array's size and pushes that filter to
    the source, where the whole computation of the array is then repeated.  It leaves expressions alone.
    """
    return F.filter(array, lambda x: F.lit(True))


def indexed(array: Column, name: str = "v") -> Column:
    """``array<struct<i, v>>`` with the zero-based position beside each element."""
    return F.transform(array, lambda x, i: F.struct(i.alias("i"), x.alias(name)))


def tree_links(depths: Column) -> Column:
    """``array<struct<parent, children>>`` of pre-order nodes: the parent's zero-based place (null for roots) and child count.

    Each node is sorted in twice, as itself on its own level and as a possible parent one level below.  There the
    nearest possible parent before a node is its parent, and the nodes up to the next one are its children; running
    counts give both, so a document of ``n`` nodes costs ``n log n`` and stays in its row at any depth.
    """
    roles = F.concat(
        F.transform(depths, lambda d, i: F.struct(d.cast("int").alias("level"), i.alias("i"), F.lit(1).alias("own"))),
        F.transform(depths, lambda d, i: F.struct((d + 1).cast("int").alias("level"), i.alias("i"), F.lit(0).alias("own"))),
    )

    def link(order: Column) -> Column:
        above = F.filter(order, lambda r: r["own"] == 0)
        before = prefix_sums(F.transform(order, lambda r: r["own"]))  # nodes on their own level, before each place
        counted = F.filter(F.zip_with(order, before, lambda r, n: F.struct(r["own"].alias("own"), n.alias("n"))), lambda c: c["own"] == 0)
        bounds = F.concat(F.transform(counted, lambda c: c["n"]), F.array(F.size(depths)))
        return let(F.struct(above.alias("above"), bounds.alias("bounds"), before.alias("before")), lambda a: _joined_links(order, a))

    return let(F.array_sort(roles), link)


def _joined_links(order: Column, a: Column) -> Column:
    placed = F.transform(order, lambda r, k: F.struct(r.alias("r"), (k - F.get(a["before"], k) - 1).alias("above")))
    parents = F.transform(F.filter(placed, lambda p: p["r"]["own"] == 1), lambda p: let(F.get(a["above"], p["above"]), lambda u: F.struct(
        p["r"]["i"].alias("i"), F.when(u["level"] == p["r"]["level"], u["i"]).alias("parent"))))
    children = F.transform(a["above"], lambda u, k: F.struct(u["i"].alias("i"), (F.get(a["bounds"], k + 1) - F.get(a["bounds"], k)).alias("n")))
    return F.zip_with(F.array_sort(parents), F.array_sort(children), lambda p, c: F.struct(p["parent"].alias("parent"), c["n"].alias("children")))
