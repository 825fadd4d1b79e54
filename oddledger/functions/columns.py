"""Column expressions used by ingest, validation and the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.schema import ANY_ISO, LISTED_ISO, SLASHED, SLASHED_MINUTES

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MICROS_PER_HOUR = 3_600_000_000.0
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; NULL for anything that is not a plain number."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_amount(df: DataFrame, name: str) -> DataFrame:
    """Amount text with currency signs and separators to double.

    A final comma with one or two digits marks the European form
    (``1.234,56``); every other comma is a thousands separator.  The steps are
    columns of their own, so that no pattern is applied twice to a value.
    """
    european = F.translate("_bare", ",.", ".")  # comma to dot, dots removed
    plain = F.replace(F.col("_bare"), F.lit(","), F.lit(""))
    return (
        df.withColumn("_bare", F.regexp_replace(F.col(name).cast("string"), r"[€$£¥₹\s\u00a0]", ""))
        .withColumn("_plain", F.when(F.col("_bare").rlike(r",\d{1,2}$"), european).otherwise(plain))
        .withColumn(name, to_number("_plain"))
        .drop("_bare", "_plain")
    )


def _iso(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), text.try_cast("timestamp"))


def _slashed(text: Column, pattern: str, seconds: str = "") -> Column:
    """Day/month/year, or month/day/year where that is no date."""
    matches = text.rlike(pattern)
    day_first = F.concat(F.regexp_replace(text, pattern, "$3-$2-$1$4"), F.lit(seconds))
    month_first = F.concat(F.regexp_replace(text, pattern, "$3-$1-$2$4"), F.lit(seconds))
    return F.when(
        matches, F.coalesce(day_first.try_cast("timestamp"), month_first.try_cast("timestamp"))
    )


def parse_listed_timestamp(c: str | Column) -> Column:
    """Timestamp in one of the listed forms only."""
    text = col(c)
    return F.coalesce(_iso(text, LISTED_ISO), _slashed(text, SLASHED))


def _usual_form(text: Column) -> Column:
    """Year first with slashes or without signs, day first with dots or dashes: as ISO or slashed."""
    for pattern, form in (
        (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=[ T]|$)", "$1-$2-$3"),
        (r"^(\d{4})(\d{2})(\d{2})(?=[ T]|$)", "$1-$2-$3"),
        (r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4})(?= |$)", "$1/$2/$3"),
    ):
        text = F.regexp_replace(text, pattern, form)
    return text


def _named_month(text: Column) -> Column:
    """``Jan 5, 2024`` and ``5 January 2024``, with or without a time."""
    pattern = r"^(?:([A-Za-z]{3})[a-z]*\.? (\d{1,2}),?|(\d{1,2})\.? ([A-Za-z]{3})[a-z]*\.?,?) (\d{4})( \d{1,2}:\d{2}(?::\d{2})?)?$"
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 7)]
    name = F.initcap(F.concat(part[0], part[3]))
    at = F.call_function("locate", name, F.lit(MONTHS))
    date = F.concat_ws("-", part[4], ((at + 2) / 3).cast("int"), F.concat(part[1], part[2]))
    known = text.rlike(pattern) & (at > 0) & ((at - 1) % 3 == 0)
    return F.when(known, F.concat(date, part[5]).try_cast("timestamp"))


def parse_timestamp(c: str | Column) -> Column:
    """Timestamp in any ISO form, a listed form, day/month/year hour:minute, or another usual
    form of a date; where day and month could be either, the day comes first."""
    text = _usual_form(F.trim(col(c)))
    return F.coalesce(
        _iso(text, ANY_ISO),
        _slashed(text, SLASHED),
        _slashed(text, SLASHED_MINUTES, ":00"),
        _named_month(text),
    )


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_HOUR)


def amount_category(c: str | Column) -> Column:
    """Size class of the absolute amount; every class includes its upper edge."""
    size = F.abs(col(c))
    return (
        F.when(size <= 100, "micro")
        .when(size <= 1000, "small")
        .when(size <= 10000, "medium")
        .when(size <= 100000, "large")
        .when(size.isNotNull(), "huge")
    )


def messages(*items: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    texts = [
        F.when(condition, F.lit(text) if isinstance(text, str) else text)
        for condition, text in items
    ]
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def sample_skewness(c: str | Column) -> Column:
    """Skewness with the small-sample correction; NULL below three values."""
    n = F.count(c).cast("double")
    spread = F.stddev_pop(c)
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when((n > 2) & (spread > 0), F.skewness(c) * factor).when(
        (n > 2) & (spread == 0), F.lit(0.0)
    )


def sample_kurtosis(c: str | Column) -> Column:
    """Excess kurtosis with the small-sample correction; NULL below four values."""
    n = F.count(c).cast("double")
    scale = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = (n - 1) / scale * ((n + 1) * F.kurtosis(c) + 6)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), corrected)


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is NULL, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
