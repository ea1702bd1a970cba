"""Benchmark cells and the leave-self-out benchmark.

Alpha is a position's return minus the median return of the *other* traders who traded the same symbol in the
same month on the same side. No cell is sorted: the ranks that can matter lie around its middle, and the values there are found for all
cells at once by refining a histogram per cell. Only the few values in the middle move. The median without trader t follows from ranks:
the k-th row not owned by t stands at rank k + (t's own rows with at most k others before them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import CELL
from tradewright.operators.ordering import exclusive_prefix, lookup_ranks, split_by_order
from tradewright.session import cut, hot_rows

BINS = 64  # of a cell's histogram in one round
ROUNDS = 9  # 64**9 > 2**52: after that only equal values are left in a bin
# A trader with more rows in one cell moves its middle so far that the rows are counted by value instead.
WIDEST = 256


def cell_benchmark(rows: DataFrame, min_cell: int, cell: list[str] = CELL, value: str = "pr") -> DataFrame:
    """Median return and row count of every cell with at least `min_cell` rows."""
    cells = cell_table(rows, min_cell, cell, value)
    mine = _numbered(rows.filter(F.col(value).isNotNull()).select(*cell, value), cells, cell)
    middle = middle_values(mine.select("cell_no", F.col(value).alias("v")), cells.select("cell_no", "n_cell", "_low", "_high", *_centre_ranks()), hot_rows(rows))
    return cells.join(middle, "cell_no").select(*cell, "n_cell", _centre().alias("bench"))


def cell_table(rows: DataFrame, min_cell: int, cell: list[str] = CELL, value: str = "pr") -> DataFrame:
    """Stage table of the qualifying cells with their size, range and a compact number for sorting and joining."""
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_cell"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    return cut(sizes.filter(F.col("n_cell") >= min_cell).withColumn("cell_no", F.monotonically_increasing_id()))


def _centre_ranks(width: Column | None = None) -> tuple[Column, Column]:
    """The ranks between which the middle of a cell lies when up to `width` of its rows, all of one trader, are left out."""
    w = F.lit(0) if width is None else width
    n = F.col("n_cell")
    return (F.greatest(F.floor((n - w - 1) / 2), F.lit(0)).cast("long").alias("_from"), F.least(F.floor((n + w) / 2), n - 1).cast("long").alias("_to"))


def narrowed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """One round: each cell's range of values is cut into BINS, and those that hold ranks _from to _to become its new range.

    `bounds`: cell_no, _from, _to, _low, _high, _below (rows under _low). The histogram is counted map-side, so that what moves is at most
    BINS + 1 rows a cell and task, however many rows the cell has.
    """
    inside = rows.join(bounds, "cell_no").filter(F.col("v").between(F.col("_low"), F.col("_high")))
    share = (F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    bins = inside.groupBy("cell_no", "_from", "_to", "_below", F.when(F.col("_high") > F.col("_low"), F.floor(share * BINS)).otherwise(0).cast("int").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    before = Window.partitionBy("cell_no").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 1 rows
    placed = bins.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return placed.filter((F.col("_before") <= F.col("_to")) & (F.col("_before") + F.col("_c") > F.col("_from"))).groupBy("cell_no", "_from", "_to").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_before").alias("_below"), F.sum("_c").alias("_inside"))


def middle_values(rows: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """Per cell the values that stand at ranks _from to _to: stage table cell_no, _from, _low, _high, at_v (array of (at, v, _c): `_c` rows of v
    from rank `at` on, equal values as one element) and _values (the value at each rank, beginning with _from).

    rows: cell_no, v. cells: cell_no, n_cell, _low, _high, _from, _to. One round for all cells, more for cells that still have more than `limit`
    rows in range. Whatever the round leaves in range, both arrays hold no more than the asked ranks.
    """
    bounds = narrowed(rows, cells.select("cell_no", "_from", "_to", "_low", "_high", F.lit(0).cast("long").alias("_below")))
    rounds = 0 if cells.filter(F.col("n_cell") > limit).isEmpty() else ROUNDS - 1
    bounds = cut(bounds) if rounds else bounds
    for _ in range(rounds):
        big = (F.col("_inside") > limit) & (F.col("_low") < F.col("_high"))
        if bounds.filter(big).isEmpty():
            break
        bounds = cut(bounds.filter(~big).unionByName(narrowed(rows, bounds.filter(big).drop("_inside"))))
    # at most limit + 1 distinct values are in range; of those only the values at the asked ranks are kept
    kept = rows.join(bounds.select("cell_no", "_from", "_to", "_low", "_high", "_below"), "cell_no").filter(F.col("v").between(F.col("_low"), F.col("_high")))
    counts = kept.groupBy("cell_no", "_from", "_to", "_below", "v").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("cell_no").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # distinct values in range
    placed = counts.withColumn("at", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0))).filter(
        (F.col("at") <= F.col("_to")) & (F.col("at") + F.col("_c") > F.col("_from")))
    found = placed.groupBy("cell_no", "_from", "_to").agg(
        F.min("v").alias("_low"), F.max("v").alias("_high"), F.sort_array(F.collect_list(F.struct("at", "v", "_c"))).alias("at_v"))
    copies = F.transform("at_v", lambda x: F.array_repeat(x["v"], (
        F.least(x["at"] + x["_c"], F.col("_to") + 1) - F.greatest(x["at"], F.col("_from"))).cast("int")))
    return cut(found.withColumn("_values", F.flatten(copies)).drop("_to"))


def _value_at(rank: Column) -> Column:
    """The value that stands at a rank between _from and _to."""
    return F.get("_values", (rank - F.col("_from")).cast("int"))


def _centre() -> Column:
    """Mean of the two middle values of the whole cell."""
    n = F.col("n_cell")
    return (_value_at(F.floor((n - 1) / 2)) + _value_at(F.floor(n / 2))) / 2


def leave_self_out(rows: DataFrame, cells: DataFrame, cell: list[str] = CELL, trader: str = "trader_id",
                   value: str = "pr", key: str = "position_key", limit: int | None = None) -> DataFrame:
    """One row per (cell, trader) of the qualifying cells: n_cell, n_own, bench, lso (NULL when alone)."""
    limit = hot_rows(rows) if limit is None else limit
    usable = rows.filter(F.col(value).isNotNull()).select(*cell, trader, value)
    mine = _numbered(usable, cells, cell).withColumnRenamed(value, "v")
    widths = cut(mine.groupBy("cell_no", trader).agg(F.count(F.lit(1)).alias("_own")).groupBy("cell_no").agg(F.max("_own").alias("_width"))
                 .join(cells.select("cell_no", "n_cell", "_low", "_high"), "cell_no"))
    out = _by_middle(mine, widths.filter(F.col("_width") <= WIDEST), trader, limit)
    wide = widths.filter(F.col("_width") > WIDEST)
    if not wide.isEmpty():
        out = out.unionByName(_by_value(mine.withColumnRenamed("v", value).join(wide.select("cell_no", "n_cell"), "cell_no"), trader, value))
    return out


def _numbered(rows: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    return rows.join(cells.select(*cell, "cell_no"), cell).drop(*cell)


def _by_middle(rows: DataFrame, cells: DataFrame, trader: str, limit: int) -> DataFrame:
    """Each trader's rows are counted once: all of them, those under the cell's middle, and those in it by value.

    Among equal values the trader's own are taken first, which leaves the value at every rank as it is.
    """
    middle = middle_values(rows.select("cell_no", "v"), cells.select("cell_no", "n_cell", "_low", "_high", *_centre_ranks(F.col("_width"))), limit)
    placed = rows.join(middle.select("cell_no", "_low", "_high"), "cell_no")
    own = placed.groupBy("cell_no", trader).agg(
        F.count(F.lit(1)).alias("n_own"), F.count(F.when(F.col("v") < F.col("_low"), 1)).alias("_under"))
    # few traders have rows in the middle: theirs are collected apart, so that counting the others keeps to plain numbers
    inside = placed.filter(F.col("v").between(F.col("_low"), F.col("_high"))).groupBy("cell_no", trader).agg(
        F.sort_array(F.collect_list("v")).alias("_mine")).join(middle.select("cell_no", "at_v"), "cell_no")
    # rank of the trader's j-th row in the middle, less the own rows of the middle before it
    first = lambda v: F.filter("at_v", lambda x: x["v"] == v)[0]["at"]
    ranks = F.transform("_mine", lambda v: first(v) - (F.array_position("_mine", v) - 1))
    inside = cut(inside.select(F.col("cell_no").alias("_cell"), F.col(trader).alias("_trader"), ranks.alias("_ranks")))
    found = own.join(inside, (F.col("cell_no") == F.col("_cell")) & F.col(trader).eqNullSafe(F.col("_trader")), "left").join(
        middle.select("cell_no", "_from", "_values").join(cells.select("cell_no", "n_cell"), "cell_no"), "cell_no")

    def at(k: Column) -> Column:
        own_before = F.when(F.col("_ranks").isNull(), 0).otherwise(F.size(F.filter("_ranks", lambda x: x - F.col("_under") <= k)))
        return _value_at(k + F.col("_under") + own_before)

    n = F.col("n_cell") - F.col("n_own")
    lso = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return found.select(
        "cell_no", trader, "n_cell", F.col("n_own").cast("long").alias("n_own"), _centre().alias("bench"), F.when(n > 0, lso).alias("lso"))


def _targets(ranked: DataFrame, trader: str, weight: Column) -> DataFrame:
    """Ranks of the two middle rows among the others; `_others` counts them before each own row."""
    k1 = F.floor((F.col("n_cell") - F.col("n_own") - 1) / 2)
    k2 = F.floor((F.col("n_cell") - F.col("n_own")) / 2)
    return ranked.groupBy("cell_no", trader, "n_cell", "n_own").agg(
        (k1 + F.sum(F.when(F.col("_others") <= k1, weight).otherwise(F.lit(0)))).cast("long").alias("_g1"),
        (k2 + F.sum(F.when(F.col("_others") <= k2, weight).otherwise(F.lit(0)))).cast("long").alias("_g2"))


def _by_value(rows: DataFrame, trader: str, value: str) -> DataFrame:
    """Cells in which one trader has very many rows: equal values are counted first and the ordering is cut into chunks."""
    own = split_by_order(rows.groupBy("cell_no", "n_cell", trader, value).agg(F.count(F.lit(1)).alias("_own_c")), ["cell_no", trader], [value])
    counts = own.groupBy("cell_no", value).agg(F.sum("_own_c").alias("c"))
    pooled = cut(exclusive_prefix(split_by_order(counts, ["cell_no"], [value]), ["cell_no"], "_chunk", [value], "c", "lo").drop("_chunk"))
    n_own = own.groupBy("cell_no", trader).agg(F.sum("_own_c").alias("n_own"))
    ranked = (
        exclusive_prefix(own, ["cell_no", trader], "_chunk", [value], "_own_c", "_own_lo")
        .join(pooled.select("cell_no", value, "lo"), ["cell_no", value])
        .withColumn("_others", F.col("lo") - F.col("_own_lo"))
        .join(n_own, ["cell_no", trader])
    )
    targets = cut(_targets(ranked, trader, F.col("_own_c")))
    ranks = targets.select("cell_no", "n_cell", F.explode(F.array(
        "_g1", "_g2", F.floor((F.col("n_cell") - 1) / 2), F.floor(F.col("n_cell") / 2))).alias("_rank")).distinct()
    found = lookup_ranks(pooled, ["cell_no"], value, ranks, "_rank").withColumnRenamed(value, "_v")
    return _assemble(targets, cut(ranks.join(found, ["cell_no", "_rank"])), trader)


def _assemble(targets: DataFrame, values: DataFrame, trader: str) -> DataFrame:
    """`values` holds only the middle ranks, so it is usually small enough for a broadcast; Catalyst decides."""
    first = values.select("cell_no", F.col("_rank").alias("_g1"), F.col("_v").alias("_v1"))
    second = values.select("cell_no", F.col("_rank").alias("_g2"), F.col("_v").alias("_v2"))
    bench = values.filter(_central(F.col("_rank"))).groupBy("cell_no").agg(F.avg("_v").alias("bench"))
    alone = F.col("n_cell") == F.col("n_own")
    return (
        targets.join(first, ["cell_no", "_g1"], "left").join(second, ["cell_no", "_g2"], "left").join(bench, "cell_no")
        .select("cell_no", trader, "n_cell", F.col("n_own").cast("long").alias("n_own"), "bench",
                F.when(~alone, (F.col("_v1") + F.col("_v2")) / 2).alias("lso"))
    )


def _central(rank: Column) -> Column:
    """Is this 0-based rank one of the two middle ranks of the whole cell?"""
    return (rank == F.floor((F.col("n_cell") - 1) / 2)) | (rank == F.floor(F.col("n_cell") / 2))


def with_alpha(rows: DataFrame, cells: DataFrame, benchmark: DataFrame, cell: list[str] = CELL,
               trader: str = "trader_id", value: str = "pr") -> DataFrame:
    """Adds alpha (leave-self-out) and alpha_incl (against the whole cell); NULL outside qualifying cells."""
    return (
        rows.join(cells.select(*cell, "cell_no"), cell, "left")
        .join(benchmark, ["cell_no", trader], "left")
        .withColumn("alpha", F.col(value) - F.col("lso"))
        .withColumn("alpha_incl", F.col(value) - F.col("bench"))
        .drop("lso", "bench", "cell_no")
    )


def self_dominance(cells: DataFrame, benchmark: DataFrame, scope: list[str], trader: str = "trader_id") -> DataFrame:
    """Per trader: rows lost because the trader is alone in the cell, and the largest share of any cell."""
    return benchmark.join(cells.select("cell_no", *scope), "cell_no").groupBy(*scope, trader).agg(
        F.sum(F.when(F.col("n_cell") == F.col("n_own"), F.col("n_own")).otherwise(F.lit(0)))
        .alias("n_alpha_dropped_self_dominated"),
        F.max(F.col("n_own") / F.col("n_cell")).alias("max_cell_share"))
