"""Prefixes of ordered rows, as-of joins and range joins, without a task that holds a whole group.

What comes before a row is combined by an associative function, so a group's rows can be cut into chunks of a bounded width: chunks
are combined side by side, then chunks of chunks, and what stands before each is handed down again. A group of n rows takes
log_width(n) shuffles up and as many down; each is by (group, chunk), so a group that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .graph import shared_checkpoints

#: Rows, or chunks, that are combined in one go.
WIDTH = 128
#: Lines of a bin of a range join.
BIN = 64


def prefix(rows: DataFrame, by: list[str], at: str, value: Column, combine: Callable[[Column, Column], Column], zero: Column, name: str = "before", width: int = WIDTH, last: int | None = None) -> DataFrame:
    """rows with `name`: the values of all earlier rows of the same `by`, combined in order.

    at: a whole number from 0 that orders the rows, with few rows at the same place (these are ordered by all they hold).
    combine(a, b) is associative with the identity zero and gives the type of value. Null keys are a group like others; rows
    with a null place are left out. last: the largest place or a bound of it, which is else looked up in a job of its own.
    """
    if width < 2:
        raise ValueError("chunks have two rows or more")
    own = rows.columns
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    given = rows.where(F.col(at).isNotNull())
    last = given.agg(F.max(at)).first()[0] if last is None else last
    chunk = lambda c: F.floor(F.col(c) / width).cast("long")
    kind = given.select(value.alias("v")).schema["v"].dataType.simpleString()

    def total(items: Column) -> Column:
        return F.aggregate(items, zero.cast(kind), lambda acc, x: combine(acc, x["v"]).cast(kind))

    def spread(items: Column, start: Column) -> Column:
        """Array of what stands before each item of a chunk."""
        return F.aggregate(
            items, F.struct(start.alias("acc"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda s, x: F.struct(combine(s["acc"], x["v"]).cast(kind).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")), lambda s: s["out"],
        )

    level = given.select(*named, F.col(at).cast("long").alias("_c"), value.alias("v"), F.struct(*own).alias("row"))
    first = level.groupBy(*keys, chunk("_c").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("_c", "v", F.struct("row").alias("r")))).alias("items"))
    levels, span = [first], (last or 0) // width
    while span > 0:
        up = levels[-1].select(*keys, F.col("_p").alias("_c"), total(F.col("items")).alias("v"))
        levels.append(up.groupBy(*keys, chunk("_c").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("_c", "v"))).alias("items")))
        span //= width
    start = levels[-1].withColumn("start", zero.cast(kind))
    for below in reversed(levels[:-1]):
        each = start.select(*keys, F.explode(F.arrays_zip(F.col("items._c").alias("_p"), spread(F.col("items"), F.col("start")).alias("start"))).alias("x")).select(*keys, "x.*")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        on = F.col("a._p") == F.col("b._p")
        for s in same:
            on = on & s
        start = below.alias("a").join(each.alias("b"), on).select(*(f"a.{k}" for k in keys), "a._p", "a.items", "b.start")
    out = start.select(F.explode(F.arrays_zip(F.col("items.r").alias("r"), spread(F.col("items"), F.col("start")).alias("before"))).alias("x"))
    return out.select("x.r.row.*", F.col("x.before").alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their number from 0 in each group `by`, in order; ties are ordered by all that a row holds.

    Rows are sorted in ranges of (group, order) and each range numbers its own; only the sizes, a row for each group in each range, are
    added up. The sorted rows are written to the checkpoint folder, so that numbers don't change when a task runs again.
    """
    shared_checkpoints(rows.sparkSession)
    keys = [*by, *order, *(c for c in rows.columns if c not in (*by, *order))]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    sizes = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    named = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return parts.join(named, on).select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias(name))


#: Places of a chunk whose rows a window goes over: it keeps no arrays, so chunks are wider than those of prefix().
SPAN = 1 << 10


def _scan(rows: DataFrame, by: list[str], at: str, value: Column, name: str, running: Callable[[Column, WindowSpec], Column], total: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column], backward: bool, last: int | None, unique: bool, width: int) -> DataFrame:
    """prefix() for functions that windows know: running(v, window) is what comes before a row of a chunk, total(v, order) the value of a chunk.

    Where the largest place is below `width`, groups are the chunks: nothing is joined, and scans of one place after the other share one shuffle.
    unique: no two rows of a group have one place, so that rows need no further order.
    """
    if width < 2:
        raise ValueError("chunks have two rows or more")
    own = rows.columns
    given = rows.where(F.col(at).isNotNull())
    last = (given.agg(F.max(at)).first()[0] or 0) if last is None else last
    place = F.desc(at) if backward else F.asc(at)
    ties = [] if unique else [F.col(c) for c in own if c not in (at, *by)]
    if last < width:
        w = Window.partitionBy(*by).orderBy(place, *([] if unique else [value]), *ties).rowsBetween(Window.unboundedPreceding, -1)
        return given.select(*own, running(value, w).alias(name))
    # names of this level, so that none is met twice in the levels above
    p, v, q, total_, before, inside = (f"_{x}_{at}" for x in "pvqtbi")
    keys = [f"_k{i}_{at}" for i in range(len(by))]
    cut = given.withColumn(p, F.floor(F.col(at) / width).cast("long")).withColumn(v, value)
    w = Window.partitionBy(*by, p).orderBy(place, *([] if unique else [v]), *ties).rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct((-F.col(at) if backward else F.col(at)).alias("at"), v, *(c.alias(f"o{i}") for i, c in enumerate(ties)))
    sums = cut.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(p).alias(q)).agg(total(F.col(v), order).alias(total_))
    start = _scan(sums, keys, q, F.col(total_), before, running, total, combine, backward, last // width, True, width)
    on = F.col(p) == F.col(q)
    for c, k in zip(by, keys):
        on = on & F.col(c).eqNullSafe(F.col(k))
    # the hint keeps a side whose size is guessed from narrow keys from being sent to the driver whole
    return cut.withColumn(inside, running(F.col(v), w)).join(start.hint("merge"), on).select(*own, combine(F.col(before), F.col(inside)).alias(name))


def running_sum(rows: DataFrame, by: list[str], at: str, value: Column, name: str = "before", width: int = SPAN, last: int | None = None, unique: bool = False) -> DataFrame:
    """rows with the sum of the values of all earlier rows of the same `by`; a null counts 0."""
    running = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0).cast("long"))
    return _scan(rows, by, at, F.coalesce(value, F.lit(0)).cast("long"), name, running, lambda v, order: F.sum(v), lambda a, b: a + b, False, last, unique, width)


def as_of(rows: DataFrame, by: list[str], at: str, value: Column, name: str, backward: bool = False, width: int = SPAN, last: int | None = None, unique: bool = False) -> DataFrame:
    """rows with the last value that isn't null of the earlier rows of the same `by`; backward: with the first of the later ones.

    As an as-of join: union both sides and let only the right one have a value.
    """
    running = lambda v, w: F.last(v, ignorenulls=True).over(w)
    return _scan(rows, by, at, value, name, running, lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)), lambda a, b: F.coalesce(b, a), backward, last, unique, width)


def running_max(rows: DataFrame, by: list[str], at: str, value: Column, name: str, width: int = SPAN, last: int | None = None, unique: bool = False) -> DataFrame:
    """rows with the largest value of all earlier rows of the same `by`; before the first null."""
    return _scan(rows, by, at, value, name, lambda v, w: F.max(v).over(w), lambda v, order: F.max(v), lambda a, b: F.greatest(a, b), False, last, unique, width)


def meet_ranges(left: DataFrame, right: DataFrame, by: str, left_range: tuple[str, str], right_range: tuple[str, str], size: int = BIN) -> DataFrame:
    """Pairs of rows of the same `by` whose ranges [start, end] share a line: columns of left, then those of right but `by`.

    Both are cut into bins of `size` lines and meet on (by, bin); a pair is kept in its first common bin. A range that ends before it
    starts, or has a null, meets nothing.
    """
    own = [c for c in right.columns if c != by]
    clash = set(left.columns) & set(own)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")

    def cut(d: DataFrame, ends: tuple[str, str], mark: str) -> DataFrame:
        a, b = (F.floor(F.col(c) / size) for c in ends)
        return d.where(F.col(ends[0]) <= F.col(ends[1])).withColumn(f"_first_{mark}", a).withColumn("_bin", F.explode(F.sequence(a, b)))

    both = cut(left, left_range, "l").join(cut(right, right_range, "r").hint("merge"), [by, "_bin"])
    both = both.where(F.col("_bin") == F.greatest("_first_l", "_first_r"))
    return both.where((F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))).select(*left.columns, *own)


def enclosing(lines: DataFrame, ranges: DataFrame, by: str = "path", size: int = BIN) -> DataFrame:
    """lines (by, line) with the name of the first range (start_line, end_line, name) of the same file that holds each; none: null.

    Of several the one that starts first, then ends first, then by name.
    """
    asked = lines.select(by, "line").distinct()
    hit = meet_ranges(asked.withColumn("_l", F.col("line")), ranges.select(by, "start_line", "end_line", "name"), by, ("line", "_l"), ("start_line", "end_line"), size)
    first = hit.groupBy(by, "line").agg(F.min(F.struct("start_line", "end_line", "name")).alias("x")).select(by, "line", "x.name")
    return asked.join(first.hint("merge"), [by, "line"], "left")
