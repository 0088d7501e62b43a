"""Queries from pixels to the normalised training frame."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acrelens.config import ATTRIBUTES, BUSINESS_FIELDS, MONTHS
from acrelens.functions import geo, scalar
from acrelens.operators import actuals, distributions, explore, frame, gates, sampling, tasks
from acrelens.plans.standins import PIXELS, POINTS, YIELD_PIXELS, duck, given, view
from acrelens.sources import tables

Q: dict = {}


def query(columns: str, sql: str | None):
    def register(f):
        Q[f.__name__] = (f, columns, sql)
        return f

    return register


def _cell_sql(p: int, lon: str = "lon", lat: str = "lat") -> str:
    n, m = -(-5 * p // 2), 5 * p // 2
    x = f"least(greatest(CAST(floor(({lon} + 180) / 360e0 * {1 << n}) AS BIGINT), 0), {(1 << n) - 1})"
    y = f"least(greatest(CAST(floor(({lat} + 90) / 180e0 * {1 << m}) AS BIGINT), 0), {(1 << m) - 1})"
    bit = f"((CASE WHEN (5*i+j) % 2 = 0 THEN {x} >> CAST({n - 1} - (5*i+j)//2 AS BIGINT) ELSE {y} >> CAST({m - 1} - (5*i+j)//2 AS BIGINT) END) & 1)"
    return f"array_to_string(list_transform(range({p}), lambda i: substr('{geo.ALPHABET}', CAST(1 + list_sum(list_transform(range(5), lambda j: {bit} * (16 // CAST(pow(2, j) AS BIGINT)))) AS INTEGER), 1)), '')"


@query(
    "k cell4 cell5 region lng! lat! west! north!",
    f"""WITH p AS ({duck(POINTS)}) SELECT * FROM (SELECT k, {_cell_sql(4)} AS cell4, {_cell_sql(5)} AS cell5, substr({_cell_sql(4)}, 1, 3) AS region,
    (floor((lon + 180) / 360e0 * 1024) + 0.5) * (360e0 / 1024) - 180 AS lng, (floor((lat + 90) / 180e0 * 1024) + 0.5) * (180e0 / 1024) - 90 AS lat,
    floor((lon + 180) / 360e0 * 1024) * (360e0 / 1024) - 180 AS west, (floor((lat + 90) / 180e0 * 1024) + 1) * (180e0 / 1024) - 90 AS north FROM p)""",
)
def geohash_cells(spark, d):
    """Cells of points, and back."""
    df = view(spark, d, POINTS).withColumn("cell4", geo.encode(F.col("lon"), F.col("lat"), 4)).withColumn("cell5", geo.encode(F.col("lon"), F.col("lat"), 5))
    box, mid = geo.bounds(F.col("cell4")), geo.center(F.col("cell4"))
    return df.select("k", "cell4", "cell5", geo.region(F.col("cell4")).alias("region"), mid["lng"].alias("lng"), mid["lat"].alias("lat"), box["west"].alias("west"), box["north"].alias("north"))


_SUMMARY = "avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) AS count, CASE WHEN stddev_pop(value) > 0 THEN (avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*power(avg(value), 3)) / power(stddev_pop(value), 3) END AS skew, CASE WHEN stddev_pop(value) > 0 THEN (avg(value*value*value*value) - 4*avg(value)*avg(value*value*value) + 6*avg(value)*avg(value)*avg(value*value) - 3*power(avg(value), 4)) / power(var_pop(value), 2) - 3 END AS kurtosis"
_DAILY = f"SELECT geohash, attr, condition, date, {_SUMMARY} FROM px WHERE value >= 0 GROUP BY ALL"
_POOL = """sum(mean * count) / sum(count) AS mean, CASE WHEN count(*) = 2 AND sum(count) = 2 THEN stddev_samp(mean) WHEN sum(count) > count(*) THEN sqrt(sum((count - 1) * std * std) / (sum(count) - count(*))) END AS std,
    min(min) AS min, max(max) AS max, CAST(sum(count) AS BIGINT) AS count"""
_MONTHLY = f"SELECT geohash, attr, condition, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {_POOL} FROM daily GROUP BY ALL"


def daily(spark, d):
    return distributions.summarize(view(spark, d, PIXELS).where("value >= 0"), ["geohash", "attr", "condition", "date"])


def monthly(spark, d):
    rows = daily(spark, d).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    return distributions.pool(rows, ["geohash", "attr", "condition", "year", "month"], shape=False)


@query("geohash attr condition date mean! std! min! max! count skew! kurtosis!", f"WITH px AS ({duck(PIXELS)})\n--\n{_DAILY}")
def daily_summary(spark, d):
    """A10, B4, D1."""
    return daily(spark, d)


@query("geohash attr condition year month mean! std! min! max! count", f"WITH px AS ({duck(PIXELS)}), daily AS ({_DAILY})\n--\n{_MONTHLY}")
def monthly_pool(spark, d):
    """D5."""
    return monthly(spark, d)


@query("geohash mean! std! count", f"WITH px AS ({duck(PIXELS)} WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) SELECT * FROM (SELECT geohash, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS count FROM px GROUP BY geohash)")
def restricted_cells(spark, d):
    """Only cells of a list."""
    cells = given(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("geohash"))
    return distributions.summarize(frame.restrict(view(spark, d, PIXELS), cells), ["geohash"], with_range=False)


_YEARLY = "SELECT geohash, year, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS count FROM yp WHERE value > 0 GROUP BY geohash, year"


def yearly(spark, d):
    return distributions.summarize(view(spark, d, YIELD_PIXELS).where("value > 0"), ["geohash", "year"], with_range=False)


@query(
    "geohash year mean! std! count",
    f"WITH yp AS ({duck(YIELD_PIXELS)}), s AS (SELECT geohash, year, part, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS count FROM yp WHERE value > 0 GROUP BY ALL)\n--\nSELECT geohash, year, sum(mean * count) / sum(count) AS mean, CASE WHEN count(*) = 2 AND sum(count) = 2 THEN stddev_samp(mean) WHEN sum(count) > count(*) THEN sqrt(sum((count - 1) * std * std) / (sum(count) - count(*))) END AS std, CAST(sum(count) AS BIGINT) AS count FROM s GROUP BY ALL",
)
def pooled_yields(spark, d):
    """Partial summaries of a cell-year pooled."""
    parts = distributions.summarize(view(spark, d, YIELD_PIXELS).where("value > 0"), ["geohash", "year", "part"], with_range=False)
    return distributions.pool(parts, ["geohash", "year"], with_range=False, shape=False)


@query(
    "geohash year count a! b! loc! scale!",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), s AS (SELECT geohash, year, count(*) AS count, avg(value) AS m, var_pop(value) AS v, min(value) AS lo, max(value) - min(value) AS scale FROM yp GROUP BY ALL),
    t AS (SELECT *, (m - lo) / nullif(scale, 0) AS x, v / nullif(scale * scale, 0) AS y FROM s)
--
SELECT geohash, year, count, CASE WHEN scale > 0 THEN x * (x * (1 - x) / y - 1) END AS a, CASE WHEN scale > 0 THEN (1 - x) * (x * (1 - x) / y - 1) END AS b, CASE WHEN scale > 0 THEN lo END AS loc, CASE WHEN scale > 0 THEN scale END AS scale FROM t""",
)
def beta_shapes(spark, d):
    """D7."""
    return distributions.beta_shape(view(spark, d, YIELD_PIXELS), ["geohash", "year"])


@query(
    "geohash year draw value!",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), n AS (SELECT geohash, year, value, row_number() OVER (PARTITION BY geohash, year ORDER BY ('0x' || substr(md5('part|' || id), 1, 8))::BIGINT % 64, id, value) AS at FROM yp), c AS (SELECT geohash, year, count(*) AS n FROM yp GROUP BY ALL),
    w AS (SELECT geohash, year, CAST(draw AS INT) AS draw, ('0x' || substr(md5('draw|' || geohash || '|' || year || '|' || draw), 1, 8))::BIGINT % n + 1 AS at FROM c, range(1, 21) r(draw))
--
SELECT w.geohash, w.year, w.draw, n.value FROM w JOIN n ON w.geohash = n.geohash AND w.year = n.year AND w.at = n.at""",
)
def yield_draws(spark, d):
    """The first 20 draws of yield_draws_all, which the SQL has."""
    return sampling.draw_values(view(spark, d, YIELD_PIXELS), ["geohash", "year"], "value", ["id", "value"], draws=20)


@query(
    "geohash year draw value!",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), n AS (SELECT geohash, year, value, row_number() OVER (PARTITION BY geohash, year ORDER BY ('0x' || substr(md5('part|' || id), 1, 8))::BIGINT % 64, id, value) AS at FROM yp), c AS (SELECT geohash, year, count(*) AS n FROM yp GROUP BY ALL),
    w AS (SELECT geohash, year, CAST(draw AS INT) AS draw, ('0x' || substr(md5('draw|' || geohash || '|' || year || '|' || draw), 1, 8))::BIGINT % n + 1 AS at FROM c, range(1, 1001) r(draw))
--
SELECT w.geohash, w.year, w.draw, n.value FROM w JOIN n ON w.geohash = n.geohash AND w.year = n.year AND w.at = n.at""",
)
def yield_draws_all(spark, d):
    """All 1,000 draws with replacement for each cell-year."""
    return sampling.draw_values(view(spark, d, YIELD_PIXELS), ["geohash", "year"], "value", ["id", "value"])


_VARIABLES = ", ".join(f"('{v}')" for v in ATTRIBUTES)


@query(
    "variable condition date name",
    f"""WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year FROM lineitem), v(variable) AS (VALUES {_VARIABLES}), c(condition) AS (VALUES ('2030_SSP245'), ('2050_SSP245'), ('observations'))
--
SELECT variable, condition, CAST(make_date(year, 1, 1) + CAST(g AS INT) AS DATE) AS date, CASE WHEN condition = 'observations' THEN '' ELSE condition || '.' END || CASE WHEN variable <> 'chirps-v2' THEN variable WHEN condition = 'observations' THEN 'chirps-v2.0' ELSE 'CHIRPS' END || '.' || strftime(make_date(year, 1, 1) + CAST(g AS INT), '%Y.%m.%d') || '.tif' AS name
FROM y, v, c, range(0, 366) r(g) WHERE year(make_date(year, 1, 1) + CAST(g AS INT)) = year""",
)
def raster_manifest(spark, d):
    """Which rasters to read for the years of the pixels: all variables, conditions and days."""
    years = view(spark, d, PIXELS).select("year").distinct()
    out = tables.manifest(years, list(ATTRIBUTES), ("2030_SSP245", "2050_SSP245", "observations"))
    return out.withColumn("name", tables.raster_name(F.col("variable"), F.col("condition"), F.col("date")))


@query(
    "path year",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), k AS (SELECT DISTINCT geohash, year FROM yp)
--
SELECT 'store/cells/' || geohash || '/yields_' || year || '.tif' AS path, year FROM k""",
)
def found_inputs(spark, d):
    """Of all paths in a store, side files and files without a year too, those of inputs, and their years."""
    k, tail = view(spark, d, YIELD_PIXELS).select("geohash", "year").distinct(), F.array(F.lit(".tif"), F.lit(".tif.aux.xml"), F.lit(".md"))
    path = F.when(F.col("tail") == ".md", F.concat(F.lit("store/2001/"), "geohash", F.lit("/readme.md"))).otherwise(F.concat(F.lit("store/cells/"), "geohash", F.lit("/yields_"), "year", "tail"))
    return tables.find_inputs(k.withColumn("tail", F.explode(tail)).select(path.alias("path")))


@query(
    "geohash year mean! count",
    f"WITH yp AS ({duck(YIELD_PIXELS)})\n--\nSELECT geohash, year, avg(value) AS mean, count(*) AS count FROM yp GROUP BY ALL",
)
def csv_tables(spark, d):
    """A1-A3: yearly summaries written as CSV, a folder for each year, with more columns in another order, and read back by header."""
    rows = distributions.summarize(view(spark, d, YIELD_PIXELS), ["geohash", "year"], with_range=False)
    path = tables.scratch(spark, "yearly")
    tables.write_table(rows.withColumn("part", F.col("year")), path, ["std", "geohash", "count", "mean", "year", "part"], "csv", ("part",))
    return tables.read_csv(spark, path, "geohash string, year int, mean double, count long")


@query("value n", "SELECT c_mktsegment || ' ' || c_nationkey AS value, count(*) AS n FROM customer GROUP BY ALL")
def line_lists(spark, d):
    """A4: a list written as lines, some blank and padded, and read back."""
    path = tables.scratch(spark, "lines")
    own = F.concat(F.lit("  "), "c_mktsegment", F.lit(" "), "c_nationkey", F.lit(" "))
    tables.write_lines(given(spark, d, "customer").select(F.explode(F.array(own, F.lit("   "), F.lit("")))), path)
    return tables.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "year county program units! indemnified! lossRatio!",
    """WITH b AS (SELECT CAST(year(o_orderdate) AS INT) AS year, 'county ' || o_custkey % 40 || ', IA' AS county, CASE o_orderkey % 3 WHEN 0 THEN 'RP' WHEN 1 THEN 'YP' ELSE 'XX' END AS program, CAST(o_orderkey % 50 AS DOUBLE) AS units, CAST(o_orderkey % 7 AS DOUBLE) AS ind, (o_orderkey % 9) / 4e0 AS lr, o_orderkey FROM orders)
--
SELECT year, county, program, sum(units) AS units, sum(ind) AS indemnified, sum(lr * units) / sum(units) AS "lossRatio" FROM b WHERE program <> 'XX' AND units > 0 AND o_orderkey % 5 <> 0 GROUP BY ALL""",
)
def business_files(spark, d):
    """Headerless files with | between 28 padded fields, written from the orders, read and summed in scope."""
    named = {
        "commodityYear": F.year("o_orderdate"), "countyName": F.concat(F.lit("county "), F.col("o_custkey") % 40), "stateAbbreviation": F.lit("IA"), "commodityName": F.when(F.col("o_orderkey") % 5 == 0, "WHEAT").otherwise("CORN"),
        "insurancePlanAbbreviation": F.element_at(F.array(F.lit("RP"), F.lit("YP"), F.lit("XX")), (F.col("o_orderkey") % 3 + 1).cast("int")), "unitsReportingPrem": F.col("o_orderkey") % 50, "indemnifiedUnits": F.col("o_orderkey") % 7,
        "lossRatio": F.col("o_orderkey") % 9 / 4,
    }
    line = F.concat_ws("|", *[F.concat(F.lit(" "), named.get(c, F.lit("0")).cast("string"), F.lit("  ")) for c in BUSINESS_FIELDS])
    path = tables.scratch(spark, "business")
    tables.write_lines(given(spark, d, "orders").select(line), path)
    return actuals.by_county(actuals.read_scope(tables.read_business(spark, path)))


_BASE = "SELECT *, sum(mean * count) OVER w / sum(count) OVER w AS bm, sum(std * count) OVER w / sum(count) OVER w AS bs FROM ys WINDOW w AS (PARTITION BY geohash)"
_CTE = f"WITH px AS ({duck(PIXELS)}), yp AS ({duck(YIELD_PIXELS)}), daily AS ({_DAILY}), mo AS (SELECT * FROM ({_MONTHLY}) WHERE condition = 'observations'), ys AS ({_YEARLY}), base AS ({_BASE}), fr AS (SELECT b.geohash, b.year, bm, bs, b.mean AS ym, b.std AS sd, b.count AS obs, m.month, m.attr, m.mean AS v, m.max AS mx, count(m.attr) OVER (PARTITION BY b.geohash, b.year) AS cc FROM base b LEFT JOIN mo m ON b.geohash = m.geohash AND b.year = m.year)"


def long_frame(spark, d):
    return frame.combine(yearly(spark, d), monthly(spark, d).where("condition = 'observations'"))


@query(
    "geohash year baselineYieldMean! baselineYieldStd! yieldMean! yieldStd! yieldObservations climateCounts month attr c_mean! c_max!",
    f"{_CTE}\n--\nSELECT geohash, year, bm AS \"baselineYieldMean\", bs AS \"baselineYieldStd\", ym AS \"yieldMean\", sd AS \"yieldStd\", obs AS \"yieldObservations\", cc AS \"climateCounts\", month, attr, v AS c_mean, mx AS c_max FROM fr",
)
def frame_long(spark, d):
    """J1, D9, D10, W4, S5."""
    return long_frame(spark, d)


_STATS = {"Mean": "v", "Std": "msd", "Min": "mn", "Max": "mx", "Count": "mc"}
_WIDE = [(f"{a}{s}{m}", f"max(CASE WHEN attr = '{a}' AND month = {m} THEN {c} END)") for a in ATTRIBUTES.values() for m in MONTHS for s, c in _STATS.items()]


@query(
    "geohash year yieldObservations climateCounts " + " ".join(n if "Count" in n else f"{n}!" for n, _ in _WIDE),
    _CTE.replace("m.max AS mx", "m.std AS msd, m.min AS mn, m.max AS mx, m.count AS mc") + "\n--\nSELECT geohash, year, obs AS \"yieldObservations\", cc AS \"climateCounts\", " + ", ".join(f'{c} AS "{n}"' for n, c in _WIDE) + " FROM fr GROUP BY geohash, year, obs, cc",
)
def frame_wide(spark, d):
    """All 480 columns."""
    return frame.widen(long_frame(spark, d))


@query(
    "geohash year yieldMean baselineYieldStd yieldObservations climateCounts " + " ".join(n if "Count" in n else f"{n}!" for n, _ in _WIDE),
    f"WITH px AS ({duck(PIXELS)}), daily AS ({_DAILY}), fr AS (SELECT geohash, year, attr, month, mean AS v, std AS msd, min AS mn, max AS mx, count AS mc, count(*) OVER (PARTITION BY geohash, year) AS cc FROM ({_MONTHLY}) WHERE condition <> 'observations')\n--\n"
    + "SELECT geohash, year, -1e0 AS \"yieldMean\", -1e0 AS \"baselineYieldStd\", CAST(-1 AS BIGINT) AS \"yieldObservations\", cc AS \"climateCounts\", " + ", ".join(f'{c} AS "{n}"' for n, c in _WIDE) + " FROM fr GROUP BY geohash, year, cc",
)
def future_frame(spark, d):
    """The frame of a future condition, climate alone."""
    return frame.future_frame(monthly(spark, d).where("condition <> 'observations'"))


_YIELDS, _COUNTS = ("yieldMean", "yieldStd", "baselineYieldMean", "baselineYieldStd"), ("climateCounts", "yieldObservations")
_SLICE = [f"{a}Mean{m}" for a in ("rhx", "tmax") for m in range(1, 7)] + ["yieldMean"]  # what the SQL of the four queries covers


def _fields(spark, d, also: tuple = ()):
    """All 484 fields of the frame as rows (geohash, year, field, value), long from the start: 8 attributes, 12 months, 5 statistics, 4 of yields."""
    own = Window.partitionBy("geohash", "year").orderBy("attr", "month")  # as the frame is already dealt
    long = long_frame(spark, d).withColumn("_first", F.row_number().over(own) == 1)
    entry = lambda name, value: F.struct(name.alias("field"), value.cast("double").alias("value"))
    none = F.array().cast("array<struct<field: string, value: double>>")
    stats = F.array(*[entry(F.concat("attr", F.lit(c.capitalize()), F.col("month").cast("string")), F.col(f"c_{c}")) for c in frame.STATS])
    rest = F.array(*[entry(F.lit(c), F.col(c)) for c in (*_YIELDS, *also)])
    known = F.col("attr").isin(*ATTRIBUTES.values()) & F.col("month").between(MONTHS[0], MONTHS[-1])
    fields = F.concat(F.when(known, stats).otherwise(none), F.when(F.col("_first"), rest).otherwise(none))
    return long.select("geohash", "year", F.explode(fields).alias("f")).select("geohash", "year", "f.*")


def _sliced(df):
    return df.where(F.col("field").isin(*_SLICE))


_KNOWN = ", ".join(f"'{a}'" for a in ATTRIBUTES.values())


def _every_field(also: tuple = ()) -> str:
    """SQL of all fields as rows: five statistics of each attribute and month, and those of the yields."""
    own = {"yieldMean": "ym", "yieldStd": "sd", "baselineYieldMean": "bm", "baselineYieldStd": "bs", "climateCounts": "cc", "yieldObservations": "obs"}
    stats, rest = ("Mean", "Std", "Min", "Max", "Count"), (*_YIELDS, *also)
    return (
        _CTE.replace("m.max AS mx", "m.std AS msd, m.min AS mn, m.max AS mx, m.count AS mc")
        + f", lf AS (SELECT geohash, year, unnest([{', '.join(f'attr || {chr(39)}{x}{chr(39)} || month' for x in stats)}]) AS field, unnest([v, msd, mn, mx, CAST(mc AS DOUBLE)]) AS value FROM fr WHERE attr IN ({_KNOWN}) AND month BETWEEN 1 AND 12 "
        + f"UNION ALL SELECT geohash, year, unnest([{', '.join(repr(x) for x in rest)}]), unnest([{', '.join(f'CAST({own[x]} AS DOUBLE)' for x in rest)}]) FROM (SELECT DISTINCT geohash, year, ym, sd, bm, bs, cc, obs FROM fr))"
    )


_LONG = _CTE + ", lf AS (SELECT geohash, year, attr || 'Mean' || month AS field, v AS value FROM fr WHERE attr IN ('rhx', 'tmax') AND month <= 6 UNION ALL SELECT DISTINCT geohash, year, 'yieldMean', ym FROM fr)"


@query("geohash field mean!", _LONG + "\n--\nSELECT geohash, field, avg(value) AS mean FROM lf WHERE value IS NOT NULL GROUP BY ALL")
def historic_averages(spark, d):
    """The fields of the SQL, out of historic_averages_all."""
    return _sliced(historic_averages_all(spark, d))


@query("geohash field mean!", _every_field(_COUNTS) + "\n--\nSELECT geohash, field, avg(value) AS mean FROM lf WHERE value IS NOT NULL GROUP BY ALL")
def historic_averages_all(spark, d):
    """All fields, counts too."""
    return frame.averages(_fields(spark, d, _COUNTS))


@query(
    "geohash year field value!",
    _LONG + ", av AS (SELECT geohash, field, avg(value) AS mean FROM lf GROUP BY ALL)\n--\nSELECT l.geohash, l.year, l.field, l.value - a.mean AS value FROM lf l JOIN av a ON l.geohash = a.geohash AND l.field = a.field WHERE l.value IS NOT NULL",
)
def field_deltas(spark, d):
    """The fields of the SQL."""
    return _sliced(_deltas(spark, d))


@query("geohash year field value!", _every_field() + ", av AS (SELECT geohash, field, avg(value) AS mean FROM lf GROUP BY ALL)\n--\nSELECT l.geohash, l.year, l.field, l.value - a.mean AS value FROM lf l JOIN av a ON l.geohash = a.geohash AND l.field = a.field WHERE l.value IS NOT NULL AND NOT contains(lower(l.field), 'count') AND l.field NOT IN " + repr(_YIELDS))
def field_deltas_all(spark, d):
    """All fields that deltas are taken of, as neither counts nor yields are."""
    return _deltas(spark, d).where(~F.col("field").isin(*_YIELDS) & ~F.lower("field").contains("count"))


def _deltas(spark, d):
    return frame.own_deltas(_fields(spark, d)).where("value is not null")


@query("field mean! std!", _LONG + "\n--\nSELECT field, avg(value) AS mean, stddev_samp(value) AS std FROM lf WHERE value IS NOT NULL GROUP BY field")
def field_distributions(spark, d):
    """The fields of the SQL, out of field_distributions_all."""
    return _sliced(field_distributions_all(spark, d))


@query("field mean! std!", _every_field() + "\n--\nSELECT field, avg(value) AS mean, stddev_samp(value) AS std FROM lf WHERE value IS NOT NULL GROUP BY field")
def field_distributions_all(spark, d):
    """All 484 fields."""
    return frame.field_distributions(_fields(spark, d))


@query(
    "geohash year field z!",
    _LONG + ", di AS (SELECT field, avg(value) AS mean, stddev_samp(value) AS std FROM lf GROUP BY field)\n--\nSELECT l.geohash, l.year, l.field, (l.value - d.mean) / d.std AS z FROM lf l JOIN di d ON l.field = d.field WHERE l.value IS NOT NULL",
)
def z_scores(spark, d):
    """The fields of the SQL, out of z_scores_all, without sentinels."""
    return _sliced(z_scores_all(spark, d)).where("z <> -999")


@query("geohash year field z!", _every_field() + ", di AS (SELECT field, avg(value) AS mean, stddev_samp(value) AS std FROM lf GROUP BY field)\n--\nSELECT l.geohash, l.year, l.field, CASE WHEN l.value IS NULL OR coalesce(d.std, 0) = 0 THEN -999e0 ELSE (l.value - d.mean) / d.std END AS z FROM lf l LEFT JOIN di d ON l.field = d.field")
def z_scores_all(spark, d):
    """All 484 fields, with the sentinel for nulls and for fields that don't vary."""
    long = _fields(spark, d)
    return frame.z_scores(long, frame.field_distributions(long))


@query(
    "geohash year mean! std! skew! kurtosis! complete",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), b AS (SELECT geohash, avg(value) AS base FROM yp GROUP BY geohash), px AS (SELECT yp.geohash, year, greatest(-1e0, (value - base) / base) AS value FROM yp JOIN b ON yp.geohash = b.geohash)
--
SELECT geohash, year, mean, std, skew, kurtosis, skew IS NOT NULL AS complete FROM (SELECT geohash, year, {_SUMMARY} FROM px GROUP BY geohash, year)""",
)
def responses(spark, d):
    """Moments of each cell-year's deltas against the cell's baseline, without gathering a group."""
    rows = view(spark, d, YIELD_PIXELS)
    base = rows.groupBy("geohash").agg(F.avg("value").alias("base"))
    deltas = rows.join(base, "geohash").select("geohash", "year", scalar.delta(F.col("value"), F.col("base")).alias("value"))
    return distributions.summarize(deltas, ["geohash", "year"]).withColumn("complete", F.col("skew").isNotNull())


@query(
    "rows invalid! complete! normal! missing! repeated",
    _every_field() + f""", av AS (SELECT geohash, field, avg(value) AS mean FROM lf WHERE value IS NOT NULL GROUP BY ALL), va AS (SELECT l.geohash, l.year, bool_and(a.mean IS NOT NULL) AS valid FROM lf l LEFT JOIN av a ON l.geohash = a.geohash AND l.field = a.field GROUP BY ALL),
    sp AS (SELECT geohash, year, part, {_SUMMARY} FROM yp WHERE value > 0 GROUP BY ALL), s AS (SELECT sp.*, coalesce(valid, false) AS valid FROM sp LEFT JOIN va ON sp.geohash = va.geohash AND sp.year = va.year)
--
SELECT count(*) AS rows, avg(CASE WHEN valid THEN 0e0 ELSE 1e0 END) AS invalid, avg(CASE WHEN skew IS NOT NULL THEN 1e0 ELSE 0e0 END) AS complete, avg(CASE WHEN abs(skew) <= 2 AND abs(kurtosis) <= 7 THEN 1e0 ELSE 0e0 END) AS normal, avg(CASE WHEN skew IS NULL THEN 1e0 ELSE 0e0 END) AS missing, (SELECT count(*) FROM (SELECT geohash, year FROM s GROUP BY ALL HAVING count(*) > 1)) AS repeated FROM s""",
)
def frame_gates(spark, d):
    """One report of the quality gates on partial summaries, whose cell-years repeat, and on the deltas' valid flag."""
    long = _fields(spark, d)
    valid = frame.own_deltas(long).groupBy("geohash", "year").agg(F.bool_and("valid").alias("valid"))
    parts = distributions.summarize(view(spark, d, YIELD_PIXELS).where("value > 0"), ["geohash", "year", "part"])
    rows = parts.join(valid, ["geohash", "year"], "left").withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("complete", F.col("skew").isNotNull())
    return gates.report(rows, ["geohash", "year"])


@query(
    "geohash year sweep temporal climate retrain random region effective",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), k AS (SELECT DISTINCT geohash, year FROM yp)
--
SELECT geohash, year, CASE WHEN year < 2013 - 15 THEN 'train' WHEN year % 2 = 1 THEN 'test' ELSE 'valid' END AS sweep, CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS temporal, CASE WHEN year = 1997 THEN 'test' ELSE 'train' END AS climate, CASE WHEN year IN (1998, 2000) THEN 'test' ELSE 'train' END AS retrain,
CASE WHEN ('0x' || substr(md5('row|' || geohash || '|' || year), 1, 8))::BIGINT % 4 = 0 THEN 'test' ELSE 'train' END AS random, CASE WHEN ('0x' || substr(md5('region|' || substr(geohash, 1, 1)), 1, 8))::BIGINT % 4 = 0 THEN 'test' ELSE 'train' END AS region, year + 15 - 2007 AS effective FROM k""",
)
def split_assignments(spark, d):
    """Years are those of the stand-in less 15."""
    year, k = F.col("year") + 15, view(spark, d, YIELD_PIXELS).select("geohash", "year").distinct()
    return k.select(
        "geohash", "year", sampling.sweep_split(year).alias("sweep"), sampling.temporal_split(year).alias("temporal"), sampling.year_split(year, (2012,)).alias("climate"), sampling.year_split(year, (2013, 2015)).alias("retrain"),
        sampling.random_split(F.col("geohash"), F.col("year")).alias("random"), sampling.random_split(geo.region(F.col("geohash"), 1), salt="region").alias("region"), tasks.effective_year(year).alias("effective"),
    )


@query(
    "geohash year mean! before yearBefore",
    f"WITH yp AS ({duck(YIELD_PIXELS)}), ys AS ({_YEARLY})\n--\nSELECT * FROM (SELECT geohash, year, mean, round(lag(mean) OVER w, 5) AS before, lag(year) OVER w AS \"yearBefore\" FROM ys WINDOW w AS (PARTITION BY geohash ORDER BY year)) WHERE before IS NOT NULL ORDER BY year, geohash",
)
def year_sequences(spark, d):
    """Pairs of consecutive rows of a cell, in order."""
    out = explore.year_pairs(yearly(spark, d).select("geohash", "year", "mean"), "geohash", "year", ["mean"])
    return out.select("geohash", "year", "mean", F.round("meanBefore", 5).alias("before"), "yearBefore").orderBy("year", "geohash")


@query(
    "geohash year value! latest!",
    f"WITH yp AS ({duck(YIELD_PIXELS)})\n--\nSELECT geohash, year, arg_min(value, ROW(id, value)) AS value, arg_max(value, ROW(id, value)) AS latest FROM yp GROUP BY geohash, year",
)
def first_and_last(spark, d):
    """First and last rows of each key by an explicit order."""
    rows = view(spark, d, YIELD_PIXELS).select("geohash", "year", "value", "id")
    first, last = tasks.pick_one(rows, ["geohash", "year"], ["id", "value"]), tasks.pick_one(rows, ["geohash", "year"], ["id", "value"], last=True)
    return first.join(last.select("geohash", "year", F.col("value").alias("latest")), ["geohash", "year"])


@query(
    "name parsed rounded lenient sample joined",
    """WITH c AS (SELECT c_name AS name, CAST(c_acctbal AS VARCHAR) AS t FROM customer)
--
SELECT name, TRY_CAST(t AS DOUBLE) AS parsed, CAST(round_even(TRY_CAST(t AS DOUBLE), 0) AS INT) AS rounded, TRY_CAST(name AS DOUBLE) AS lenient, TRY_CAST(t AS DOUBLE) + 1 AS sample, 'tmaxMean' || length(name) AS joined FROM c""",
)
def lenient_parse(spark, d):
    """B1-B3, S5, S6."""
    t = F.col("c_acctbal").cast("string")
    return given(spark, d, "customer").select(
        F.col("c_name").alias("name"), scalar.try_float(t).alias("parsed"), scalar.try_int(t).alias("rounded"), scalar.try_float(F.col("c_name")).alias("lenient"),
        (scalar.parse_sample(F.concat_ws(" ", t, F.lit("x")))[0] + 1).alias("sample"), scalar.column_name(F.lit("tmax"), F.lit("Mean"), F.length("c_name")).alias("joined"),
    )


def flagship(spark, sf_dir):
    """Weighted monthly mean of each attribute and condition over all cells: daily summaries, pooled to months, weighted."""
    out = monthly(spark, sf_dir)
    return out.groupBy("attr", "condition", "year", "month").agg((F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"), F.sum("count").alias("count"), F.countDistinct("geohash").alias("cells"))


