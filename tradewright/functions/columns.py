"""Scalar column expressions shared by every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewright.config import HOUR_MS

# Bucket labels with their upper edges (hours, exclusive; leverage, inclusive).
DURATION_EDGES = [(1, "<1h"), (4, "1-4h"), (12, "4-12h"), (24, "12-24h"), (72, "1-3d"), (168, "3-7d")]
DURATION_EDGES_LONG = [*DURATION_EDGES, (720, "7-30d")]
DURATION_EDGES_SHORT = DURATION_EDGES[:5]
LEVERAGE_EDGES = [(5, "<=5x"), (20, "6-20x"), (50, "21-50x")]
LIQUIDATION_EDGES = [(10, "<=10x"), (25, "11-25x"), (60, "26-60x"), (999, ">60x")]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Text or number to double; anything unreadable is NULL, never zero."""
    return col(c).try_cast("double")


def to_long(c: str | Column) -> Column:
    return col(c).try_cast("bigint")


def scaled(c: str | Column, digits: int) -> Column:
    """A field shipped as an integer scaled by 10**digits."""
    return to_double(c) / F.lit(float(10**digits))


def percent_text(c: str | Column) -> Column:
    """A percent number shipped as text, as a fraction."""
    return to_double(c) / F.lit(100.0)


def parse_metric(c: str | Column) -> Column:
    """'+5.54%' -> 5.54, '1,234.5' -> 1234.5; blanks, dashes and 'N/A' -> NULL."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), "[,%]", "")
    return F.regexp_replace(text, r"^\+", "").try_cast("double")


def month_of(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM")


def iso_date_ms(c: str | Column) -> Column:
    return F.unix_millis(col(c).cast("date").cast("timestamp"))


def duration_h(opened: str | Column, closed: str | Column) -> Column:
    o, c = col(opened), col(closed)
    return F.when((o != 0) & (c != 0), (c - o) / F.lit(float(HOUR_MS)))


def side_sign(side: str | Column, mode: str = "strict") -> Column:
    """+1 / -1. `strict` leaves other sides NULL (the row is dropped); `loose` reads them as short."""
    s = F.lower(col(side))
    strict = F.when(s.isin("long", "buy"), F.lit(1)).when(s.isin("short", "sell"), F.lit(-1))
    return F.coalesce(strict, F.lit(-1)) if mode == "loose" else strict


def is_long(side: str | Column = "side") -> Column:
    """Sources write `Long` or `long`."""
    return F.lower(col(side)) == "long"


def price_return(kind: str) -> Column:
    """De-leveraged return of one position, by the basis its source makes trustworthy.

    price: entry and exit price; roi: return on margin over leverage; net: PnL over notional.
    """
    if kind == "price":
        return (F.col("avg_close") / F.col("avg_cost") - 1) * side_sign("side", "loose")
    if kind == "roi":
        return F.col("roi") / F.col("leverage")
    if kind == "net":
        return F.col("pnl") / F.col("notional")
    raise ValueError(f"unknown return basis {kind!r}")


def guarded_price_return(bound: float = 3.0) -> Column:
    """Price return, NULL where an input is missing or not positive or the result is a bad tick."""
    usable = (
        (F.col("avg_cost") > 0) & (F.col("avg_close") > 0) & (F.col("notional") > 0)
        & (F.col("leverage") > 0) & (F.col("opened_ms") != 0)
    )
    pr = price_return("price")
    return F.when(usable & (F.abs(pr) <= bound), pr)


def derived_leverage(notional: str | Column, margin: str | Column) -> Column:
    return F.when(col(margin) > 0, col(notional) / col(margin)).otherwise(F.lit(0.0))


def partial_close(closed_volume: str | Column, max_oi: str | Column, tolerance: float | None = None) -> Column:
    """Ingest rule: closed less than the peak size. Study rule: differs from it by more than `tolerance`."""
    cv, oi = col(closed_volume), col(max_oi)
    if tolerance is None:
        return F.coalesce((oi != 0) & (cv < oi), F.lit(False))
    return F.coalesce((oi > 0) & (cv > 0) & (F.abs(cv - oi) / oi > tolerance), F.lit(False))


def bucket(value: str | Column, edges: list[tuple[float, str]], beyond: str, inclusive: bool = False,
           missing: str | None = None) -> Column:
    """The first bucket whose edge the value is under; NULL values are `missing`."""
    v = col(value)
    under = (lambda e: v <= e) if inclusive else (lambda e: v < e)
    out = F.when(v.isNull(), F.lit(missing))
    for edge, label in edges:
        out = out.when(under(edge), label)
    return out.otherwise(beyond)


def duration_bucket(value: str | Column = "dur_h", variant: str = "week") -> Column:
    if variant == "month":
        return bucket(value, DURATION_EDGES_LONG, ">30d")
    if variant == "short":
        return bucket(value, DURATION_EDGES_SHORT, ">3d")
    return bucket(value, DURATION_EDGES, ">7d")


def leverage_bucket(value: str | Column = "leverage") -> Column:
    """Unreadable leverage counts as the lowest."""
    return bucket(value, LEVERAGE_EDGES, ">50x", inclusive=True, missing=LEVERAGE_EDGES[0][1])


def liquidation_band(value: str | Column = "leverage") -> Column:
    v = col(value)
    return F.when((v > 0) & (v <= 999), bucket(v, LIQUIDATION_EDGES, "", inclusive=True))


def six_hour_block(ms: str | Column) -> Column:
    start = (F.hour(F.timestamp_millis(col(ms))) / 6).cast("int") * 6
    return F.concat(F.lpad(start.cast("string"), 2, "0"), F.lit("-"),
                    F.lpad((start + 5).cast("string"), 2, "0"), F.lit("h"))


def weekday(ms: str | Column) -> Column:
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.element_at(names, F.weekday(F.timestamp_millis(col(ms))) + 1)


def local_hour(ms: str | Column, zone: str = "GMT-5") -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_millis(col(ms)), zone))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    """Mean over its standard error with the population sd; 0 without spread or with fewer than two values."""
    return F.when((n >= 2) & (sd > 0), mean / (sd / F.sqrt(n.cast("double")))).otherwise(F.lit(0.0))


def payoff(avg_win: Column, avg_loss: Column) -> Column:
    return avg_win / F.abs(avg_loss)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))
