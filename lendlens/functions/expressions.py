"""Column helpers shared by the plans. Everything here stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "flag", "ratio", "ratio_or_zero", "round_half_away", "percent", "micros", "seconds_between",
    "trunc_ts", "weekday", "concat_skip_null", "chi2_sf_even", "normal_two_sided_p", "coerced",
    "rounded",
]


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else NULL."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def round_half_away(value: Column, digits: int) -> Column:
    """Round the scaled double, as SQL engines on doubles do.

    ``F.round`` on a double goes through its decimal text, so 1.005 becomes
    1.01; scaling first gives 1.0, which is what the expected results hold.
    """
    scale = 10.0 ** digits
    return F.round(value.cast("double") * F.lit(scale), 0) / F.lit(scale)


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """100 * numerator / denominator rounded; NULL on an empty denominator."""
    return round_half_away(
        F.when(denominator != 0, F.lit(100.0) * numerator / denominator), digits
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def trunc_ts(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def concat_skip_null(*parts: Column) -> Column:
    return F.concat_ws("", *parts)


def chi2_sf_even(statistic: Column, half_dof: Column) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom.

    With 2h degrees of freedom the tail is exp(-x/2) * sum_{i<h} (x/2)^i / i!.
    Three arms always give (rows - 1) * 2 degrees, so the closed form is enough.
    """
    half = statistic / F.lit(2.0)
    state = F.aggregate(
        F.sequence(F.lit(1), F.greatest(half_dof.cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * half / i).alias("term"),
            (acc["total"] + acc["term"] * half / i).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    total = F.when(half_dof <= 1, F.lit(1.0)).otherwise(state)
    return F.exp(-half) * total


def normal_two_sided_p(z: float) -> float:
    import math

    return math.erfc(abs(z) / math.sqrt(2.0))


def coerced(name: str, data_type) -> Column:
    """Cast a text column to the contract type; blank text means NULL.

    Two timestamp spellings occur (``T`` or blank between date and time, with or
    without a fraction); Spark's cast reads both. Text that does not fit the type
    is an error, as a table is loaded whole or not at all.
    """
    text = F.trim(F.col(name).cast("string"))
    return F.when(text != "", text).cast(data_type).alias(name)


def rounded(df, digits: int = 6):
    """Round every double column; used where two engines' sums are compared.

    Means of money often lie exactly halfway between two rounded values, where
    the last bit of a sum would decide. A nudge far below the kept digits
    settles those the same way everywhere.
    """
    nudge = 0.00123 * 10.0 ** -digits
    return df.select(
        *[
            round_half_away(F.col(f.name) + F.lit(nudge), digits).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
