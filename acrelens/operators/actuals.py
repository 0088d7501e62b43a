"""Actual insurance records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.config import ACRES_TO_PIXELS
from acrelens.functions.scalar import county_label
from acrelens.operators.gates import GateError

CROPS, PROGRAMS = ("corn", "sweet corn"), ("yp", "rp", "aph")


def read_scope(business: DataFrame) -> DataFrame:
    """year, county, program, units, indemnified, lossRatio of summary-of-business rows in scope."""
    rows = business.where(F.lower("commodityName").isin(*CROPS) & F.lower("insurancePlanAbbreviation").isin(*PROGRAMS))
    rows = rows.select(F.col("commodityYear").try_cast("int").alias("year"), county_label(F.col("countyName"), F.col("stateAbbreviation")).alias("county"), F.col("insurancePlanAbbreviation").alias("program"), F.col("unitsReportingPrem").try_cast("double").alias("units"), F.col("indemnifiedUnits").try_cast("double").alias("indemnified"), F.col("lossRatio").try_cast("double").alias("lossRatio"))
    return rows.where("units > 0")


def by_county(rows: DataFrame, keys: tuple = ("year", "county", "program")) -> DataFrame:
    """Units, indemnified units and the units-weighted loss ratio."""
    return rows.where("units > 0").groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("indemnified").alias("indemnified"), F.try_divide(F.sum(F.col("lossRatio") * F.col("units")), F.sum("units")).alias("lossRatio"))


def by_year(counties: DataFrame) -> DataFrame:
    """The same by year, with claimsRate."""
    return by_county(counties, ("year",)).withColumn("claimsRate", F.try_divide("indemnified", "units"))


def require_years(yearly: DataFrame, years: list[int]) -> DataFrame:
    """Raise GateError for a year without records."""
    missing = set(years) - {r["year"] for r in yearly.where(F.col("year").isin(*years)).select("year").distinct().collect()}
    if missing:
        raise GateError(f"no records for {sorted(missing)}")
    return yearly


def unit_sizes(raw: DataFrame, acres: str = "acres") -> DataFrame:
    """crop, policyType, unitType, coverageAcres, coveragePixels of corn under yield and revenue protection with any coverage."""
    rows = raw.where(F.col("crop").isin("Corn") & F.col("policyType").isin("YP", "RP")).withColumn("coverageAcres", F.col(acres).try_cast("double"))
    return rows.where("coverageAcres > 0").select("crop", "policyType", "unitType", "coverageAcres", (F.col("coverageAcres") * ACRES_TO_PIXELS).alias("coveragePixels"))
