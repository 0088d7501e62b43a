"""Fixed values of the domain, and the columns of its tables."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Climate variables and the attribute names that the training frame has for them.
ATTRIBUTES = {
    "RHx": "rhx",
    "RHn": "rhn",
    "Tmax": "tmax",
    "Tmin": "tmin",
    "chirps-v2": "chirps",
    "svp": "svp",
    "vpd": "vpd",
    "wbgtmax": "wbgtmax",
}
CONDITIONS = ("observations", "2030_SSP245", "2050_SSP245")
YEARS = range(1999, 2017)
MONTHS = range(1, 13)
THRESHOLDS = (0.25, 0.15)
CELL_SIZES = (4, 5)
STD_MULTIPLIERS = (1.0,)
OFFSETS = ("always", "never")
PIXELS_PER_ROW = 1111.0
SUBUNITS = 32
INVALID = -999.0
LEVELS = tuple(round(0.15 + 0.05 * i, 2) for i in range(8))
MEAN_WEIGHT, STD_WEIGHT = 1.0, 0.25
ACRES_TO_PIXELS = 17564481 / 3906250
LAYERS = (512, 256, 128, 64, 32, 8)
BINS = tuple(range(-100, 101, 5))

_double = lambda *names: [StructField(n, DoubleType()) for n in names]
CLIMATE = StructType(
    [StructField("geohash", StringType()), StructField("year", IntegerType()), StructField("month", IntegerType()), StructField("var", StringType()), StructField("condition", StringType()), *_double("mean", "std", "min", "max"), StructField("count", LongType()), *_double("skew", "kurtosis")]
)
YIELD = StructType([StructField("year", IntegerType()), StructField("geohash", StringType()), *_double("mean", "std"), StructField("count", LongType()), *_double("skew", "kurtosis")])
#: Positional names of the headerless summary-of-business files.
BUSINESS_FIELDS = (
    "commodityYear stateCode stateAbbreviation countyCode countyName commodityCode commodityName insurancePlanCode insurancePlanAbbreviation coverageCategory deliveryType covLevel policyCount policyPremCount policyIndemnifiedCount unitsReportingPrem indemnifiedUnits quantityType quantity companionAcres liabilities premium subsidy statePrivateSubsidy additionalSubsidy efaDiscount indemnity lossRatio"
).split()
BUSINESS = StructType([StructField(n, StringType()) for n in BUSINESS_FIELDS])
