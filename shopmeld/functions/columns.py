"""Column-returning building blocks shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmeld import config

# Numbers that enter a percentage are held at this width: 16 digits before the point, eight after,
# so the quotient keeps ten exact digits behind the point before it is rounded.
_RATIO_TYPE = "decimal(24,8)"


def case(branches: Iterable[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """Searched CASE from (condition, value) pairs; without pairs only the default remains."""
    column = None
    for condition, value in branches:
        column = F.when(condition, value) if column is None else column.when(condition, value)
    return otherwise if column is None else column.otherwise(otherwise)


def null_of(sql_type: str) -> Column:
    """A typed NULL."""
    return F.lit(None).cast(sql_type)


def ntz(moment: dt.datetime) -> Column:
    """A zone-less timestamp literal; comparing raw timestamps with it stays pushable."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: dt.date) -> Column:
    """A date literal."""
    return F.lit(value.isoformat()).cast("date")


def epoch_seconds(moment: dt.datetime) -> int:
    """Seconds since 1970 of a zone-less moment."""
    return int((moment - dt.datetime(1970, 1, 1)).total_seconds())


def ntz_from_epoch(seconds: Column) -> Column:
    """Epoch seconds to a zone-less timestamp, whatever the session time zone is."""
    return ntz(dt.datetime(1970, 1, 1)) + F.make_dt_interval(secs=seconds)


def exact_avg(value: Column) -> Column:
    """Average as exact sum over count; Spark's decimal average would cut it to a few digits."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL for a zero or NULL denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def rounded_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient at two digits, in decimal arithmetic; NULL for a zero denominator."""
    return F.round(
        numerator.cast(_RATIO_TYPE) / F.nullif(denominator.cast(_RATIO_TYPE), F.lit(Decimal(0))), 2
    )


def percent(part: Column, whole: Column, rounding=F.round) -> Column:
    """100 * part / whole in decimal arithmetic at two digits, NULL for a zero denominator."""
    numerator = part.cast(_RATIO_TYPE) * F.lit(Decimal(100))
    return rounding(numerator / F.nullif(whole.cast(_RATIO_TYPE), F.lit(Decimal(0))), 2)


def growth_percent(current: Column, base: Column, rounding=F.round) -> Column:
    """Growth over a base at two digits; 0 when the base is missing or not positive."""
    return F.when(base > 0, percent(current - base, base, rounding)).otherwise(
        F.lit(Decimal(0)).cast("decimal(38,2)")
    )


def convert_to_usd(
    amount: Column, currency: Column, rates: Mapping[str, Decimal] = config.USD_RATES
) -> Column:
    """Amount in US dollars; a currency without a rate is taken as USD."""
    return case(
        ((currency == code, amount * F.lit(rate)) for code, rate in rates.items()), amount
    )


def date_dimensions(moment: Column) -> dict[str, Column]:
    """Date of a timestamp and the first day of its week (Monday), month, quarter and year."""
    date = F.to_date(moment)
    return {
        "order_date": date,
        "order_week": F.trunc(date, "week"),
        "order_month": F.trunc(date, "month"),
        "order_quarter": F.trunc(date, "quarter"),
        "order_year": F.trunc(date, "year"),
    }


def time_dimensions(moment: Column) -> dict[str, Column]:
    """Hour, and day of week counted from Sunday = 0."""
    return {"order_hour": F.hour(moment), "order_day_of_week": F.dayofweek(moment) - 1}


def status_flags(payment: Column, fulfillment: Column, cancelled_at: Column) -> dict[str, Column]:
    """Paid / fulfilled / cancelled; a missing status counts as false."""
    return {
        "is_paid": F.coalesce(payment.isin(*config.PAID_STATUSES), F.lit(False)),
        "is_fulfilled": F.coalesce(fulfillment.isin(*config.FULFILLED_STATUSES), F.lit(False)),
        "is_cancelled": cancelled_at.isNotNull(),
    }


def standardize_status(platform: str | Column, status: Column) -> Column:
    """Map a platform's status word to the common one; words without a mapping stay."""
    if isinstance(platform, str):
        return _map_status(config.STANDARD_STATUS.get(platform, {}), status)
    return case(
        (
            (platform == name, _map_status(words, status))
            for name, words in config.STANDARD_STATUS.items()
        ),
        status,
    )


def _map_status(words: Mapping[str, str], status: Column) -> Column:
    return case(((status == word, standard) for word, standard in words.items()), status)


def joined_name(first: Column, last: Column) -> Column:
    """First and last name with a blank between; a missing part is left out, the blank stays."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def or_default(value: Column, default: str) -> Column:
    """Replace NULL and the empty string."""
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def zero_if_null(value: Column) -> Column:
    """NULL to 0, keeping the column's type."""
    return F.coalesce(value, F.lit(0))


def currency_text(value: Column) -> Column:
    """US dollars without cents, rounded half away from zero: $1,235 or -$1,235."""
    sign = F.when(value < 0, "-").otherwise("")
    whole = F.abs(F.round(value, 0)).cast("decimal(38,0)")
    return F.when(value.isNotNull(), F.concat(sign, F.lit("$"), F.format_number(whole, 0)))


def percent_text(value: Column) -> Column:
    """Signed percentage with one digit: +12.3% or -0.5%."""
    sign = F.when(value >= 0, "+").otherwise("-")
    digits = F.abs(F.round(value, 1)).cast("decimal(38,1)").cast("string")
    return F.when(value.isNotNull(), F.concat(sign, digits, F.lit("%")))


def compact_text(value: Column) -> Column:
    """Large numbers as 1.2M or 3.4K, others as they are."""

    def scaled(unit: int) -> Column:
        return F.round(value / F.lit(Decimal(unit)), 1).cast("decimal(38,1)").cast("string")

    return (
        F.when(value >= 1_000_000, F.concat(scaled(1_000_000), F.lit("M")))
        .when(value >= 1_000, F.concat(scaled(1_000), F.lit("K")))
        .otherwise(value.cast("string"))
    )


def text_of(value: Column, type_name: str) -> Column:
    """Any value as text: booleans capitalised, timestamps with their fraction only if they have one.

    Amounts out of JSON payloads have no declared scale; they are held with six digits and print
    those they need, two at least.
    """
    if type_name == "boolean":
        return F.initcap(value.cast("string"))
    if type_name in ("timestamp", "timestamp_ntz"):
        text = value.cast("string")
        return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    if type_name.startswith("decimal") and type_name.endswith(f",{config.PAYLOAD_DIGITS})"):
        return F.regexp_replace(value.cast("string"), r"(\.\d\d\d*?)0+$", "$1")
    return value.cast("string")
