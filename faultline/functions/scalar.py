"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def round_even(value: str | Column, places: int = 0) -> Column:
    """Rounded for output; ties go to the even neighbour."""
    scale = float(10**places)
    return F.rint(col(value) * F.lit(scale)) / F.lit(scale)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def plus_hours(ts: str | Column, hours: str | Column | float) -> Column:
    amount = F.lit(hours) if isinstance(hours, (int, float)) else col(hours)
    return col(ts) + F.make_dt_interval(F.lit(0), amount.cast("int"))


def iso_text(ts: str | Column) -> Column:
    """ISO text of a timestamp, with a fraction only when it is not zero."""
    ts = col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def parse_iso(text: str | Column) -> Column:
    """ISO text to UTC wall clock; any other text, also looser forms that a cast takes, must fail the run."""
    value = col(text)
    bad = F.raise_error(F.concat(F.lit("not an ISO date or time: "), value)).cast("timestamp_ntz")
    return F.when(value.isNull() | is_iso(value), _standard(value).try_cast("timestamp").cast("timestamp_ntz")).otherwise(bad)


ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(.\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)


def is_iso(text: str | Column) -> Column:
    """True where the text is an ISO date or timestamp. The shape test keeps out the looser forms Spark casts."""
    value = col(text)
    return F.coalesce(value.rlike(ISO_PATTERN) & _standard(value).try_cast("timestamp").isNotNull(), F.lit(False))


def _standard(value: Column) -> Column:
    """The text in the form Spark casts: a T between date and time, and ":00" added to a bare hour."""
    standard = F.concat(F.substring(value, 1, 10), F.lit("T"), F.substring(value, 12, 64))
    padded = F.regexp_replace(standard, r"T(\d{2})(Z|[+-].*)?$", "T$1:00$2")
    has_minutes = F.substring(value, 14, 1) == ":"  # the usual form, for which no pattern is searched
    return F.when(F.length(value) == 10, value).when(has_minutes, standard).otherwise(padded)


def one_of(value: str | Column, allowed: Iterable[str]) -> Column:
    """Membership that is False, never null, for a null value."""
    return F.coalesce(col(value).isin(list(allowed)), F.lit(False))


def truthy(value: str | Column) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(col(value) != "", F.lit(False))


def explode_present(df: DataFrame, items: Iterable[Column], name: str, *keep: str | Column) -> DataFrame:
    """One row per item that is not null, as ``name`` beside the columns to keep.

    The items become a column first and nulls go after the explode: Spark interprets what stands inside a generator or a
    higher-order function, expression by expression, while a projection is compiled.
    """
    wide = df.select(*keep, F.array(*items).alias("_items"))
    kept = [column for column in wide.columns if column != "_items"]
    return wide.select(*kept, F.explode("_items").alias(name)).where(F.col(name).isNotNull())


def lookup(key: str | Column, table: Mapping[str, object], default: object = None) -> Column:
    """Constant table lookup as one CASE expression."""
    key = col(key)
    result = None
    for name, value in table.items():
        literal = F.lit(value)
        result = F.when(key == name, literal) if result is None else result.when(key == name, literal)
    return result.otherwise(F.lit(default))


def json_object(**fields: str | Column) -> Column:
    """Compact JSON text that keeps null fields."""
    struct = F.struct(*[col(value).alias(name) for name, value in fields.items()])
    return F.to_json(struct, {"ignoreNullFields": "false"})


def encode_for_uri(value: str | Column) -> Column:
    """Percent-encode everything but letters, digits and - _ . ~"""
    encoded = F.url_encode(col(value))
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def title_case(value: str | Column) -> Column:
    """SPARE_VENDOR_WAITING -> Spare Vendor Waiting"""
    return F.initcap(F.replace(F.lower(col(value)), F.lit("_"), F.lit(" ")))


def actual_or_estimated() -> Column:
    """Downtime of an incident; an actual value of zero counts as not known."""
    return F.coalesce(F.nullif(F.col("actual_downtime_hours"), F.lit(0.0)), F.col("estimated_downtime_hours"))


def is_active(status: str | Column = "current_status") -> Column:
    return F.coalesce(col(status) != "RESTORED", F.lit(True))
