"""Split hot keys into slices of their order, and run ordered scans across the slices.

An ordered scan per product (previous price, latch, failure run) is normally a
window partitioned by the product. One product can hold a large share of all
rows, and then that window is one task. Here a product above ``limit`` rows is
cut into slices that follow one another in the order of its rows; every slice is
scanned on its own, each slice is summarised into one row, the summaries are
prefix-combined per product, and the result is carried into the rows of the later
slices. Cold products keep exactly one slice, so for them the plan is the ordinary
window.

Slices are found by counting: a key is cut into cells of equal time, a cell that
still holds more than ``limit`` rows is cut again, and rows of one time are cut by
the next columns of the order. So a burst is split like everything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.sources import folders

HOT_ROWS = 2_000_000
"""Rows of one key a single task may sort; beyond it the key is sliced."""

SMALL = 50_000
"""Cells that may be broadcast, counted first."""

SLICE = "_slice"
HOT = "_hot"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is first, last, min, max or sum of ``expr`` in row order.

    ``inclusive`` says whether the current row counts.
    """

    name: str
    expr: Column
    kind: str = "last"
    inclusive: bool = False


@dataclass(frozen=True)
class Sliced:
    """A frame with its slice column; ``hot`` is False when no key was cut. ``files``: the tables that
    it was stored in, which may go once nothing reads the frame."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool
    files: tuple[str, ...] = ()

    def drop_files(self) -> None:
        for place in self.files:
            folders.drop(self.df.sparkSession, place)

    @property
    def window(self):
        # by the keys alone where no key was cut, so that joins and folds by key need no further exchange
        return Window.partitionBy(*self.keys, *([SLICE] if self.hot else [])).orderBy(*self.order)


def _number(df: DataFrame, name: str) -> Column | None:
    """An order column as a whole number that sorts alike, if it has one."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(name)
    return F.col(name).cast("long") if kind in ("byte", "short", "integer", "long") else None


def slice_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int | None = None,
    sizes: DataFrame | None = None,
) -> Sliced:
    """Add the slice column. ``order[0]`` must be a timestamp.

    A slice has at most ``limit`` rows, unless more agree in every leading column of the
    order that is a time or a whole number. ``sizes(keys, n, lo, hi)`` may give upper bounds
    of the rows and the time range per key from a cheaper scan than ``df`` itself.

    The slice is the list of where the row's cells begin, so slices sort as their rows do.
    A table of cells to cut has at most total / limit rows.
    """
    limit = HOT_ROWS if limit is None else limit
    if sizes is None:
        at = F.col(order[0])
        sizes = df.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")
        )
    plan = sizes.filter(F.col("n") > limit)
    if plan.isEmpty():
        return Sliced(df.withColumn(SLICE, F.lit(0).cast("long")), tuple(keys), tuple(order), False)
    numbers = list(takewhile(lambda n: n is not None, (_number(df, c) for c in order)))
    none = F.array().cast("array<long>").alias(SLICE)
    cells = plan.select(
        *keys, none, F.lit(0).alias("_dim"), "n", F.unix_micros("lo").alias("_lo"), F.unix_micros("hi").alias("_hi")
    )
    rows = df.select(*keys, none, *[n.alias(f"_d{i}") for i, n in enumerate(numbers)])
    dims = [F.col(f"_d{i}") for i in range(len(numbers))]
    levels, places = [], []  # the tables stored on the way

    def stored(rows: DataFrame) -> DataFrame:
        rows, place = folders.stored(rows)
        places.append(place)
        return rows

    last = None
    while True:
        # four cells per limit leave room for uneven arrival
        width = F.expr(f"greatest(1, CAST(ceil((_hi - _lo + 1) / ceil(n * 4 / {limit})) AS BIGINT))")
        level = stored(cells.select(*keys, SLICE, "_dim", "_lo", width.alias("_width")))
        level = F.broadcast(level) if level.count() <= SMALL else level
        levels.append(level)
        # stored, so that no level makes the rows of those before it again; those go then
        rows, place = folders.stored(_cut(rows, level, keys, dims, "inner", not last).select(*keys, SLICE, "_dim", *dims))
        if last:
            folders.drop(df.sparkSession, last)
        last = place
        spread = [F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(f"_s{i}") for i, d in enumerate(dims)]
        dense = rows.groupBy(*keys, SLICE).agg(F.count("*").alias("n"), F.max("_dim").alias("_at"), *spread)
        # the first column, from this one on, in which the cell's rows differ
        ranges = [F.struct(F.lit(i).alias("dim"), f"_s{i}.lo", f"_s{i}.hi") for i in range(len(dims))]
        differing = F.filter(F.array(*ranges), lambda r: (r["dim"] >= F.col("_at")) & (r["lo"] < r["hi"]))
        cells = dense.filter(F.col("n") > limit).withColumn("_next", F.get(differing, F.lit(0)))
        cells = cells.filter(F.col("_next").isNotNull()).select(
            *keys, SLICE, F.col("_next.dim").alias("_dim"), "n", F.col("_next.lo").alias("_lo"), F.col("_next.hi").alias("_hi")
        )
        cells = stored(cells)
        if cells.isEmpty():
            break
    out = df.withColumns({SLICE: none, **{f"_d{i}": n for i, n in enumerate(numbers)}})
    for i, level in enumerate(levels):
        out = _cut(out, level, keys, dims, "left", not i).select(*df.columns, SLICE, *dims)
    # the rows are scanned and their slices summarised: cut once for both
    folders.drop(df.sparkSession, last)
    out, kept = folders.stored(out.select(*df.columns, SLICE, (F.size(SLICE) > 0).alias(HOT)))
    for place in places:
        folders.drop(df.sparkSession, place)
    return Sliced(out, tuple(keys), tuple(order), True, (kept,))


def _cut(
    df: DataFrame, level: DataFrame, keys: Sequence[str], dims: Sequence[Column], how: str, first: bool
) -> DataFrame:
    """The rows of cells that are cut again get where their new cell begins behind their slice."""
    level = level.withColumnRenamed("_dim", "_cut_dim")
    if "_dim" in df.columns:
        df = df.drop("_dim")
    value = F.get(F.array(*dims), F.col("_cut_dim"))
    begin = F.col("_lo") + F.floor((value - F.col("_lo")) / F.col("_width")) * F.col("_width")
    deeper = F.when(F.col("_lo").isNotNull(), F.concat(SLICE, F.array(begin.cast("long")))).otherwise(F.col(SLICE))
    on = [*keys, SLICE]
    if first:  # all rows have the same slice yet, and may lie by their keys already
        on, level = [*keys], level.drop(SLICE)
    joined = df.join(level, on, how)
    return joined.withColumn(SLICE, deeper).withColumnRenamed("_cut_dim", "_dim")


def _agg(kind: str, value: Column) -> Column:
    return {
        "first": lambda: F.first(value, ignorenulls=True),
        "last": lambda: F.last(value, ignorenulls=True),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "sum": lambda: F.sum(value),
    }[kind]()


def _whole(s: Running, order: Sequence[str]) -> Column:
    """The value over all rows of a group, as a plain aggregate."""
    if s.kind not in ("first", "last"):
        return _agg(s.kind, s.expr).alias(s.name)
    at = F.struct(*[F.col(c) for c in order], s.expr.alias("_v"))
    pick = F.max if s.kind == "last" else F.min
    return pick(F.when(s.expr.isNotNull(), at))["_v"].alias(s.name)


def _joined(kind: str, later: Column, earlier: Column) -> Column:
    """The value over earlier rows followed by later rows."""
    if kind == "last":
        return F.coalesce(later, earlier)
    if kind == "first":
        return F.coalesce(earlier, later)
    if kind == "min":
        return F.least(later, earlier)
    if kind == "max":
        return F.greatest(later, earlier)
    return F.when(
        later.isNotNull() | earlier.isNotNull(),
        F.coalesce(later, F.lit(0)) + F.coalesce(earlier, F.lit(0)),
    )


def _after(
    df: DataFrame, before: DataFrame, on: Sequence[str], specs: Sequence[Running], how: str = "left"
) -> DataFrame:
    """Join values of earlier rows under the same names and combine them into ``df``'s."""
    names = {s.name for s in specs}
    earlier = before.select(*on, *[F.col(s.name).alias("_e_" + s.name) for s in specs])
    return df.join(earlier, list(on), how).select(
        *[c for c in df.columns if c not in names],
        *[_joined(s.kind, F.col(s.name), F.col("_e_" + s.name)).alias(s.name) for s in specs],
    )


def running(src: Sliced, specs: Sequence[Running], initial: DataFrame | None = None) -> Sliced:
    """Add one column per spec, exact across slices.

    ``initial`` holds the values over rows before this frame, one row per key, with a
    column per spec; see ``closing``.
    """
    upto = {
        True: src.window.rowsBetween(Window.unboundedPreceding, 0),
        False: src.window.rowsBetween(Window.unboundedPreceding, -1),
    }
    files = src.files
    out = src.df.select(
        "*",
        *[_agg(s.kind, s.expr).over(upto[s.inclusive]).alias(s.name) for s in specs],
    )
    if src.hot:
        hot = src.df.filter(F.col(HOT))
        per_slice = hot.groupBy(*src.keys, SLICE).agg(*[_whole(s, src.order) for s in specs])
        before = (
            Window.partitionBy(*src.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_slice.select(
            *src.keys, SLICE, *[_agg(s.kind, F.col(s.name)).over(before).alias(s.name) for s in specs]
        )
        # a row a slice: stored, so that what made it is not on the disk beside the shuffle of the rows
        carry, place = folders.stored(carry)
        files = (*src.files, place)
        out = _after(out, carry, [*src.keys, SLICE], specs)
    if initial is not None:
        out = _after(out, initial, src.keys, specs)
    return Sliced(out, src.keys, src.order, src.hot, files)


def closing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    initial: DataFrame | None = None,
) -> DataFrame:
    """Values over all rows so far, one row per key: the ``initial`` of the next frame."""
    totals = df.groupBy(*keys).agg(*[_whole(s, order) for s in specs])
    return totals if initial is None else _after(totals, initial, keys, specs, "full")


def row_numbers(src: Sliced, name: str = "rn") -> Sliced:
    """1-based position of every row in its key's order."""
    return running(src, [Running(name, F.lit(1).cast("long"), "sum", True)])


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64
) -> DataFrame:
    """First ``k`` rows of every key by ``order``, with a column ``rn``.

    Two rounds: the best k of each (key, salt) first, then the best k of those;
    no task sees more than k x salts rows of one key in the second round.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= k)
        .withColumn("rn", F.row_number().over(final))
        .filter(F.col("rn") <= k)
        .drop("_salt")
    )


def _hashable(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.typeName()
    return kind in ("long", "integer", "string", "timestamp", "double", "boolean", "date")
