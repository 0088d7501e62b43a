"""Scalar functions on columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrelens.config import ATTRIBUTES, INVALID, LAYERS


def try_float(x: Column) -> Column:
    """Text as a number, null where it is none."""
    return x.try_cast("double")


def try_int(x: Column) -> Column:
    """Text as an integer; a decimal is rounded half to even; null where it is no number."""
    return F.coalesce(x.try_cast("int"), F.bround(finite(x.try_cast("double"))).try_cast("int"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def attribute(variable: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for v in chain(*ATTRIBUTES.items())]), variable)


def column_name(attr: Column, stat: Column, month: Column) -> Column:
    return F.concat(attr, stat, month.cast("string"))


def parse_sample(text: Column) -> Column:
    """"1 2.5 x" as an array of numbers, null for what is none."""
    return F.transform(F.split(text, " "), lambda x: x.try_cast("double"))


def format_sample(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


def delta(value: Column, base: Column) -> Column:
    """Relative change, not below -1; null for a zero base."""
    return F.greatest(F.lit(-1.0), F.try_divide(value - base, base))


def stretch(x: Column, inverse: bool = False) -> Column:
    return F.sinh(x) if inverse else F.asinh(x)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, INVALID for a null or NaN value or a zero or null std."""
    bad = value.isNull() | F.isnan(value) | std.isNull() | (std == 0)
    return F.when(bad, F.lit(INVALID)).otherwise(F.coalesce(F.nanvl(F.try_divide(value - mean, std), F.lit(INVALID)), F.lit(INVALID)))


def from_z_score(z: Column, mean: Column, std: Column) -> Column:
    return F.when(z != INVALID, z * std + mean)


def bin_of(x: Column, step: int = 5) -> Column:
    """Percent of a change held to [-1, 1], to the nearest multiple of step, half to even."""
    return (F.bround(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 100 / step) * step).cast("int")


def percent(x: Column) -> Column:
    """"12.3\\%", with the backslash that typesetting needs."""
    return F.concat(F.format_string("%.1f", x * 100), F.lit("\\%"))


def rounded_percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("\\%"))


def severity_percent(loss: Column, threshold: float = 0.25) -> Column:
    """Severity beyond the threshold of a (negative) loss."""
    return percent(-loss - threshold)


def quantised(x: Column) -> Column:
    """Numbers as group keys."""
    return F.format_string("%.4f", x)


def covered_loss(actual: Column, expected: Column, coverage: Column) -> Column:
    return F.greatest(coverage * expected - actual, F.lit(0.0))


def is_loss(actual: Column, expected: Column, coverage: Column) -> Column:
    return F.try_divide(actual - expected, expected) < coverage - 1


def severity(actual: Column, expected: Column, coverage: Column) -> Column:
    return F.greatest(-F.try_divide(actual - expected, expected) - (1 - coverage), F.lit(0.0))


def price(aph: Column, unit_price: Column, rate: Column, coverage: Column, subsidy: Column, perspective: Column) -> Column:
    """Yearly price of a policy as the grower or the subsidising government sees it, or whole."""
    share = F.when(perspective == "grower", 1 - subsidy).when(perspective == "government", subsidy).otherwise(F.lit(1.0))
    return aph * unit_price * rate * coverage * share


def change_category(change: Column, p: Column, limit: Column, up: str = "increase", down: str = "decrease") -> Column:
    return F.when(p.isNull() | change.isNull(), "unknown").when(p >= limit, "no significant change").when(change > 0, up).otherwise(down)


def county_label(county: Column, state: Column) -> Column:
    return F.concat(county, F.lit(", "), state)


def layers_text(n: Column) -> Column:
    """The last n layer sizes, as "64, 32, 8"."""
    sizes = F.array(*[F.lit(v) for v in LAYERS])
    return F.array_join(F.transform(F.slice(sizes, len(LAYERS) + 1 - n, n), lambda x: x.cast("string")), ", ")


def loss_label(threshold: Column) -> Column:
    return F.concat(F.bround(threshold * 100).cast("int").cast("string"), F.lit("% loss"))


def near(a: Column, b, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) < tolerance


def series_year(series: Column) -> Column:
    """The year of "2030_counterfactual"; 2010 for the historic series."""
    return F.coalesce(F.split(series, "_")[0].try_cast("int"), F.lit(2010))


def is_counterfactual(series: Column) -> Column:
    return F.contains(series, F.lit("_counterfactual"))


def series_condition(series: Column) -> Column:
    return F.when(series_year(series) == 2010, "historic").otherwise(F.concat(series_year(series).cast("string"), F.lit("_SSP245")))


def hash_int(*parts) -> Column:
    """32 bits of the md5 of the parts joined by "|": the same in any engine and any partitioning."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
