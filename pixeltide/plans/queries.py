"""Registered queries of the time-series operators, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import dates, digests, masks, scores as S
from pixeltide.operators import baseline as B, composite as C, evaluate as E, regions as R, states as T, thresholds as H
from pixeltide.plans import cube as P, verbs as V
from pixeltide.plans.shared import settled
from pixeltide.sources import scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = (), into: tuple[dict, dict] | None = None):
    """Registers a query, in this module's tables or in those given; days and times are given as text on both sides, whatever types the readers have for them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        found, oracle = into or (QUERIES, ORACLE_SQL)
        found[f.__name__] = run
        if sql:
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            oracle[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def as_sql_rounds(x: Column, digits: int = 6) -> Column:
    """DuckDB's round of a double: the scaled number is rounded half away from zero, while Spark rounds the decimal digits."""
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL side rounds them, without negative zeros."""
    return df.select(*[(as_sql_rounds(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ---- shared SQL

RAW = """raw AS (
  SELECT l_suppkey AS pixel_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS acq_date,
         l_quantity / 50.0 AS x1, l_extendedprice / 105000.0 AS x2, l_discount * 9.0 AS x3, l_tax * 10.0 AS x4 FROM lineitem)"""
CUBE = RAW + """, cube0 AS (
  SELECT pixel_id, acq_date, """ + ", ".join(f"median(x{i}) FILTER (WHERE x{i} > 0 AND x{i} <= 1) AS b{i}" for i in range(1, 5)) + """ FROM raw GROUP BY ALL
), cube AS (
  SELECT *, b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL AS valid FROM cube0)"""
DENSE = CUBE + """, frames AS (
  SELECT acq_date, CAST(row_number() OVER (ORDER BY acq_date) - 1 AS INTEGER) AS frame_id, date_diff('day', lag(acq_date) OVER (ORDER BY acq_date), acq_date) AS gap
  FROM (SELECT DISTINCT acq_date FROM cube)
), ref AS (SELECT median(gap) AS reference_days FROM frames), dense AS (
  SELECT p.pixel_id, f.frame_id, f.acq_date, f.gap, c.b1, c.b2, c.b3, c.b4, coalesce(c.valid, false) AS valid
  FROM (SELECT DISTINCT pixel_id FROM cube) p CROSS JOIN frames f LEFT JOIN cube c ON c.pixel_id = p.pixel_id AND c.acq_date = f.acq_date)"""
CHANGE = DENSE + """, change AS (
  SELECT d.*, CASE WHEN frame_id = 0 THEN 0.0 WHEN valid AND lag(valid) OVER w THEN
    (abs(b1 - lag(b1) OVER w) + abs(b2 - lag(b2) OVER w) + abs(b3 - lag(b3) OVER w) + abs(b4 - lag(b4) OVER w)) / 4 / gap * reference_days END AS change
  FROM dense d CROSS JOIN ref WINDOW w AS (PARTITION BY pixel_id ORDER BY frame_id))"""
LIMIT = CHANGE + """, centre AS (
  SELECT *, median(CASE WHEN frame_id > 0 THEN change END) OVER (PARTITION BY pixel_id) AS c0, count(CASE WHEN frame_id > 0 THEN change END) OVER (PARTITION BY pixel_id) AS n0 FROM change
), spread AS (
  SELECT *, median(CASE WHEN frame_id > 0 THEN abs(change - c0) END) OVER (PARTITION BY pixel_id) AS mad0 FROM centre
), limits AS (
  SELECT *, CASE WHEN n0 >= 2 THEN c0 + 3.0 * greatest(1.4826 * mad0, 0.0001) END AS threshold FROM spread)"""
STABLE = LIMIT + """, moved AS (
  SELECT *, coalesce(change > threshold, false) AS transition FROM limits
), lasts AS (
  SELECT *, coalesce(max(CASE WHEN transition THEN frame_id END) OVER (PARTITION BY pixel_id), -1) AS last_transition FROM moved
), suffix AS (
  SELECT *, valid AND frame_id >= CASE WHEN last_transition >= 0 THEN last_transition + 1 ELSE 0 END AND NOT transition AS inside FROM lasts
), stable AS (
  SELECT *, inside AND count(CASE WHEN inside THEN 1 END) OVER (PARTITION BY pixel_id) >= 3
    AND coalesce(date_diff('day', min(CASE WHEN inside THEN acq_date END) OVER (PARTITION BY pixel_id), max(CASE WHEN inside THEN acq_date END) OVER (PARTITION BY pixel_id)) >= 30, false) AS stable FROM suffix)"""
MEANS = ", ".join(f"avg(b{i}) AS m{i}, stddev_pop(b{i}) AS s{i}" for i in range(1, 5))
D2_SQL = " + ".join(f"pow((b{i} - m{i}) / (s{i} + 0.005), 2)" for i in range(1, 5))
SAM_SQL = "acos(greatest(-1.0, least(1.0, (" + " + ".join(f"b{i} * m{i}" for i in range(1, 5)) + ") / (sqrt(" + " + ".join(f"b{i} * b{i}" for i in range(1, 5)) + ") * sqrt(" + " + ".join(f"m{i} * m{i}" for i in range(1, 5)) + ") + 1e-9))))"
SCORED = f""", moments AS (SELECT pixel_id, {MEANS} FROM cube WHERE valid GROUP BY pixel_id
), scored AS (
  SELECT c.*, CAST(c.pixel_id // 10 AS INTEGER) AS row, CAST(c.pixel_id % 10 AS INTEGER) AS col, CASE WHEN valid THEN {D2_SQL} END AS d2, CASE WHEN valid THEN {SAM_SQL} END AS sam
  FROM cube c LEFT JOIN moments m USING (pixel_id))"""


def ring_sql(scales) -> str:
    parts = []
    for outer, inner in ((o // 2, i // 2) for o, i in scales):
        n = sum(inner**2 < x * x + y * y <= outer**2 for x in range(-outer, outer + 1) for y in range(-outer, outer + 1))
        hit = f"(b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col) BETWEEN {inner**2 + 1} AND {outer**2}"
        parts.append(f"any_value(a.d2) - (coalesce(sum(b.d2) FILTER (WHERE {hit}), 0) + any_value(a.fill) * ({n} - count(b.d2) FILTER (WHERE {hit}))) / {n}.0")
    reach = max(o // 2 for o, _ in scales)
    return f""", filled AS (SELECT s.*, median(d2) OVER (PARTITION BY acq_date) AS fill FROM scored s WHERE valid
), rings AS (
  SELECT a.pixel_id, a.acq_date, greatest(0.0, {', '.join(parts)}) AS cfar FROM filled a
  JOIN filled b ON a.acq_date = b.acq_date AND b.row BETWEEN a.row - {reach} AND a.row + {reach} GROUP BY a.pixel_id, a.acq_date)"""


#: Rings small enough for the ten-column grid; the default scales are in ``cfar_multiscale``.
SMALL_SCALES = ((5, 3),)

# ---- ingest


@query(f"WITH {CUBE} SELECT pixel_id, acq_date, {', '.join(f'round(b{i}, 6) AS b{i}' for i in range(1, 5))} FROM cube", dates=("acq_date",))
def daily_composite_median(spark, sf_dir):
    return rounded(P.cube(spark, sf_dir).drop("valid"))


@query("""WITH """ + RAW + """ SELECT acq_date, count(*) AS n, count_if(coalesce(x1 > 0 AND x1 <= 1 AND x2 > 0 AND x2 <= 1 AND x3 > 0 AND x3 <= 1 AND x4 > 0 AND x4 <= 1, false))::BIGINT AS valid_cells,
  count_if(x3 = 0 AND x4 = 0)::BIGINT AS nodata_cells, count_if(x1 > 0 AND x2 > 0 AND x3 > 0 AND x4 > 0)::BIGINT AS trainable_cells FROM raw GROUP BY acq_date""", dates=("acq_date",))
def valid_mask_counts(spark, sf_dir):
    bands = [F.col(b) for b in P.BANDS]
    return P.raw(spark, sf_dir).groupBy("acq_date").agg(F.count("*").alias("n"), F.count_if(masks.valid_observation(bands)).alias("valid_cells"), F.count_if(masks.nodata(bands[2:])).alias("nodata_cells"), F.count_if(masks.trainable(bands)).alias("trainable_cells"))


@query("""WITH p AS (SELECT DISTINCT 'S2_' || strftime(l_shipdate, '%Y-%m-%d') || '_' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.tif' AS path, CAST(l_shipdate AS DATE) AS d FROM lineitem)
  SELECT d AS acq_date, count(*) AS n_paths, min(path) AS first_path, sha256(string_agg(path, ',' ORDER BY path)) AS paths_sha256 FROM p GROUP BY d""", dates=("acq_date",))
def acquisition_groups(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("S2_"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(".tif"))
    paths = items.select(path.alias("path")).distinct()
    groups = C.group_by_day(paths.withColumn("acq_ts", dates.acquisition_time(F.col("path"))))
    return groups.select("acq_date", F.size("paths").cast("bigint").alias("n_paths"), F.element_at("paths", 1).alias("first_path"), F.sha2(F.array_join("paths", ","), 256).alias("paths_sha256"))


NAMES_SQL = """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS dashed, strftime(ts, '%Y%m%d') AS compact FROM events), n AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'S2_' || dashed || '_1030.tif' WHEN 1 THEN dashed || '.tif' WHEN 2 THEN 'N36E113_' || compact || '.tif' WHEN 3 THEN 'scene' || compact || 'x.tif' WHEN 4 THEN '_20229913.tif' ELSE 'undated ' || CAST(event_id AS VARCHAR) || ' .tif' END AS name FROM e)
"""


@query(NAMES_SQL + """SELECT event_id, name, CAST(coalesce(
    try_strptime(nullif(coalesce(nullif(regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})_', 1), ''), regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})', 1)), ''), '%Y-%m-%d'),
    CASE WHEN NOT regexp_matches(name, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(nullif(coalesce(nullif(regexp_extract(name, '_(\\d{8})(?:\\.|_|$)', 1), ''), regexp_extract(name, '(?:^|\\D)((?:19|20)\\d{6})(?:\\D|$)', 1)), ''), '%Y%m%d') END) AS DATE) AS acq_date FROM n""", dates=("acq_date",))
def filename_dates(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("dashed"), F.date_format("ts", "yyyyMMdd").alias("compact"))
    kind = F.col("event_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("S2_"), "dashed", F.lit("_1030.tif"))).when(kind == 1, F.concat("dashed", F.lit(".tif"))).when(kind == 2, F.concat(F.lit("N36E113_"), "compact", F.lit(".tif")))
        .when(kind == 3, F.concat(F.lit("scene"), "compact", F.lit("x.tif"))).when(kind == 4, F.lit("_20229913.tif")).otherwise(F.concat(F.lit("undated "), F.col("event_id").cast("string"), F.lit(" .tif")))
    )
    return e.select("event_id", name.alias("name")).withColumn("acq_date", dates.acquisition_date(F.col("name")))


@query("""WITH RECURSIVE days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), opens AS (
  SELECT min(d) AS s FROM days UNION ALL SELECT (SELECT min(d) FROM days WHERE d >= o.s + 45) FROM opens o WHERE EXISTS (SELECT 1 FROM days WHERE d >= o.s + 45)
) SELECT d.d AS day, max(o.s) AS bin_start, CASE WHEN max(o.s) = (SELECT max(s) FROM opens) THEN CAST(max(o.s) AS TIMESTAMP) ELSE CAST(max(o.s) AS TIMESTAMP) + INTERVAL 540 HOUR END AS bin_date
FROM days d JOIN opens o ON o.s <= d.d GROUP BY d.d""", dates=("day", "bin_start", "bin_date",))
def greedy_bins(spark, sf_dir):
    days = P.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return C.greedy_bins(days, 45)


@query(f"""WITH {CUBE}, lim AS (SELECT quantile_cont(x, 0.999) AS q FROM (SELECT unnest([b1, b2, b3, b4]) AS x FROM cube))
  SELECT pixel_id, acq_date, {', '.join(f'round(CASE WHEN b{i} <= q THEN b{i} END, 6) AS b{i}' for i in range(1, 5))} FROM cube CROSS JOIN lim""", dates=("acq_date",))
def p999_removal(spark, sf_dir):
    return rounded(C.drop_extremes(P.cube(spark, sf_dir, settle=True).drop("valid"), P.BANDS))


STRETCH = ", ".join(f"round(CASE WHEN b{i} IS NOT NULL THEN greatest(0.0, least(1.0, CASE WHEN h{i} > l{i} THEN (b{i} - l{i}) / (h{i} - l{i}) ELSE 0 END)) * 255 END, 4) AS b{i}_display" for i in range(1, 4))


@query(f"""WITH {CUBE}, lim AS (SELECT {', '.join(f'quantile_cont(b{i}, 0.02) FILTER (WHERE b{i} > 0) AS l{i}, quantile_cont(b{i}, 0.98) FILTER (WHERE b{i} > 0) AS h{i}' for i in range(1, 4))} FROM cube)
  SELECT pixel_id, acq_date, {STRETCH} FROM cube CROSS JOIN lim""", dates=("acq_date",))
def percentile_stretch(spark, sf_dir):
    made = C.percentile_stretch(P.cube(spark, sf_dir, settle=True).select("pixel_id", "acq_date", *P.BANDS[:3]), P.BANDS[:3])
    return rounded(made.drop(*P.BANDS), 4)


@query("""SELECT date_trunc('year', l_shipdate)::DATE AS year, count(*) AS n, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem WHERE l_suppkey // 10 BETWEEN 1 AND 6 AND l_suppkey % 10 BETWEEN 2 AND 7
  AND CAST(l_shipdate AS DATE) BETWEEN DATE '1993-02-01' AND DATE '1996-11-30' GROUP BY ALL""", dates=("year",))
def roi_filter(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    placed = items.withColumn("row", F.expr("l_suppkey div 10")).withColumn("col", F.col("l_suppkey") % 10)
    inside = scenes.roi(placed, 2, 1, 6, 6).where(dates.in_days(F.col("day"), "1993-02-01", "1996-11-30"))
    return inside.groupBy(F.trunc("day", "YEAR").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS first, round(l_tax, 6) AS second FROM lineitem""")
def band_select(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    picked = masks.select_bands(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"), [2, 4])
    return rounded(items.select("l_orderkey", "l_linenumber", picked.alias("x")).select("l_orderkey", "l_linenumber", F.element_at("x", 1).alias("first"), F.element_at("x", 2).alias("second")))


@query("""WITH m AS (SELECT l_orderkey % 100 AS scene, max(l_quantity) AS top FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN top > 49.5 THEN l_quantity * 0.0001 ELSE l_quantity END, 6) AS q FROM lineitem JOIN m ON m.scene = l_orderkey % 100""")
def auto_scale(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") % 100).alias("scene"))
    tops = items.groupBy("scene").agg(F.max("l_quantity").alias("top"))
    return rounded(items.join(tops, "scene").select("l_orderkey", "l_linenumber", masks.auto_scaled(F.col("l_quantity"), F.col("top"), above=49.5).alias("q")))


@query("""WITH g AS (SELECT CAST(l_shipdate AS DATE) AS d, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL)
  SELECT CAST(sum(n) AS BIGINT) AS source_file_count, count(*) AS day_count, CAST(count_if(n > 1) AS BIGINT) AS same_day_composite_count FROM g""")
def dataset_stats(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_shipdate").alias("acq_ts")).withColumn("path", F.concat("path", F.lit("_"), F.date_format("acq_ts", "yyyyMMdd"))).distinct()
    return C.dataset_stats(C.group_by_day(items))


# ---- model


@query("""WITH b AS (SELECT min(o_orderdate) AS s, max(o_orderdate) - INTERVAL 400 DAY AS e FROM orders)
  SELECT o_orderkey, round(greatest(date_diff('microsecond', s, o_orderdate) / 1e6 / (date_diff('microsecond', s, e) / 1e6), 0.0), 6) AS t FROM orders CROSS JOIN b""")
def normalize_time(spark, sf_dir):
    orders = P.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    ends = orders.agg(F.min("ts").alias("s"), (F.max("ts") - F.expr("INTERVAL 400 DAYS")).alias("e"))
    return rounded(orders.crossJoin(F.broadcast(ends)).select("o_orderkey", S.normalized_time(F.col("ts"), F.col("s"), F.col("e")).alias("t")))


@query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day, (o_custkey % 7) / 10.0 AS k FROM orders), p AS (SELECT *, day / 1826.25 AS t, 2 * pi() * 5.0 AS w FROM o)
  SELECT o_orderkey, round(0.1 + 0.5 + 0.2 * tanh(k) * least(t, 1.0) + (0.05 + 0.02 * tanh(k) * least(t, 1.0)) * cos(w * t) + (0.03 + 0.02 * tanh(-k) * least(t, 1.0)) * sin(w * t)
    + (0.02 + 0.02 * tanh(k / 2) * least(t, 1.0)) * cos(w * 2 * t) + (0.01 + 0.02 * tanh(k) * least(t, 1.0)) * sin(w * 2 * t), 6) AS mean FROM p""")
def harmonic_predict(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 1826.25).alias("t"), ((F.col("o_custkey") % 7) / 10.0).alias("k"))
    k = F.col("k")
    return rounded(o.select("o_orderkey", S.harmonic_curve(F.col("t"), 5.0, F.lit(0.1), k, [F.lit(0.05), F.lit(0.02)], [F.lit(0.03), F.lit(0.01)], [k, k / 2], [-k, k]).alias("mean")))


@query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day, o_custkey % 5 AS c FROM orders)
  SELECT o_orderkey, round(0.4 + 0.01 * c + 0.02 * cos(day * (2 * pi() / 365.25)) - 0.01 * c * sin(day * (2 * pi() / 365.25)) + 0.005 * cos(day * (4 * pi() / 365.25)) + 0.003 * sin(day * (4 * pi() / 365.25)) + 0.001 * c * cos(day * (6 * pi() / 365.25)) - 0.002 * sin(day * (6 * pi() / 365.25)), 6) AS mean FROM o""")
def linear_correction(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day"), (F.col("o_custkey") % 5).alias("c"))
    c = F.col("c")
    coef = [0.01 * c, F.lit(0.02), -0.01 * c, F.lit(0.005), F.lit(0.003), 0.001 * c, F.lit(-0.002)]
    return rounded(o.select("o_orderkey", (0.4 + S.linear_correction(F.col("day"), coef)).alias("mean")))


@query("""WITH o AS (SELECT o_orderkey, ln(o_totalprice / 100000.0) * 3 AS lv, (o_custkey % 11 - 5) / 5.0 AS slope, (o_custkey % 13) / 8.0 AS t FROM orders)
  SELECT o_orderkey, round(exp(0.5 * least(greatest(lv, -7.0), 5.0)), 6) AS std, round(lv + 2 * tanh(slope) * (least(greatest(t, 0.0), 1.0) - 1) + 2 * ln(1 + (4.9 * (1 / (1 + exp(-0.3::DOUBLE))) + 0.1) * greatest(t - 1, 0.0)), 6) AS lv_t FROM o""")
def logvar_std(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", (F.log(F.col("o_totalprice") / 100000.0) * 3).alias("lv"), ((F.col("o_custkey") % 11 - 5) / 5.0).alias("slope"), ((F.col("o_custkey") % 13) / 8.0).alias("t"))
    return rounded(o.select("o_orderkey", S.log_variance_to_std(F.col("lv")).alias("std"), S.log_variance_at(F.col("lv"), F.col("slope"), F.col("t"), F.lit(0.3)).alias("lv_t")))


@query("""WITH o AS (SELECT o_orderkey, (o_custkey % 101) / 80.0 AS t, (o_orderkey % 9) / 10.0 AS a FROM orders)
  SELECT o_orderkey, round((1 / (1 + exp(-((t - 0.3) / 0.02))) - 1 / (1 + exp(0.3 / 0.02::DOUBLE))) * a + (1 / (1 + exp(-((t - 0.7) / 0.02))) - 1 / (1 + exp(0.7 / 0.02::DOUBLE))) * -0.2, 6) + 0.0 AS state FROM o""")
def step_state(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 101) / 80.0).alias("t"), ((F.col("o_orderkey") % 9) / 10.0).alias("a"))
    return rounded(o.select("o_orderkey", S.step_state(F.col("t"), [(F.lit(0.3), F.col("a")), (F.lit(0.7), F.lit(-0.2))], 0.02).alias("state")))


START, END = "1992-01-01", "1998-12-01"
PHI = ["1.0", "least(t, 1.0)", "cos(day * (2 * pi() / 365.25))", "sin(day * (2 * pi() / 365.25))"]


@query(f"""WITH {CUBE}, long AS (SELECT pixel_id, CAST(u.band AS INTEGER) AS band, date_diff('day', DATE '{START}', acq_date) AS day, date_diff('day', DATE '{START}', acq_date) / date_diff('day', DATE '{START}', DATE '{END}')::DOUBLE AS t, u.y
    FROM (SELECT pixel_id, acq_date, unnest([{{'band': 0, 'y': b1}}, {{'band': 1, 'y': b2}}, {{'band': 2, 'y': b3}}, {{'band': 3, 'y': b4}}]) AS u FROM cube) WHERE u.y IS NOT NULL)
  SELECT pixel_id, band, {', '.join(f'round(sum({PHI[i]} * {PHI[j]}), 6) AS g_{i}_{j}' for i in range(4) for j in range(i, 4))}, {', '.join(f'round(sum({PHI[i]} * y), 6) AS v_{i}' for i in range(4))}, round(sum(y * y), 6) AS yy, count(*) AS n FROM long GROUP BY ALL""")
def gram_sums(spark, sf_dir):
    rows = B.long_form(P.cube(spark, sf_dir), P.BANDS, START, END)
    return rounded(B.gram_sums(rows, B.design(F.col("day"), F.col("t"), 1)).drop("ww"), 6)


@query(f"""WITH {CUBE}, long AS (SELECT pixel_id, date_diff('day', DATE '{START}', acq_date) / date_diff('day', DATE '{START}', DATE '{END}')::DOUBLE AS t, b1 AS y FROM cube WHERE b1 IS NOT NULL)
  SELECT pixel_id, round(regr_intercept(y, t), 6) AS intercept, round(regr_slope(y, t), 6) AS slope FROM long GROUP BY pixel_id""")
def trend_fit(spark, sf_dir):
    rows = B.long_form(P.cube(spark, sf_dir), P.BANDS[:1], START, END)
    return rounded(rows.groupBy("pixel_id").agg(F.regr_intercept("y", "t").alias("intercept"), F.regr_slope("y", "t").alias("slope")))


@query()
def ridge_fit(spark, sf_dir):
    made = B.fit(P.cube(spark, sf_dir), P.BANDS, START, END, recency=0.1)
    return rounded(made.select("pixel_id", "band", F.element_at("beta", 1).alias("intercept"), F.element_at("beta", 2).alias("trend"), "log_var", "n"))


@query(dates=("acq_date",))
def baseline_predict(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True).drop("valid")
    made = B.predict(seen, B.fit(seen, P.BANDS, START, END), P.BANDS, START, END, horizon_decay=0.5)
    return rounded(B.score(made, P.BANDS).select("pixel_id", "acq_date", "valid", "d2", "sam"))


@query(f"""WITH {CUBE}{SCORED} SELECT c.pixel_id, {', '.join(f'round(stddev_pop(b{i} - m{i}), 6) AS b{i}_std' for i in range(1, 5))} FROM cube c JOIN moments USING (pixel_id) GROUP BY c.pixel_id""")
def residual_std(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    joined = seen.join(P.moments(seen), "pixel_id").select("pixel_id", *P.BANDS, *[f"{b}_mean" for b in P.BANDS])
    return rounded(B.residual_std(joined, P.BANDS, lambda b: F.col(b) - F.col(f"{b}_mean")))


@query(f"""WITH {CUBE}{SCORED} SELECT CAST(year(acq_date) AS INTEGER) AS year, round(avg(0.5 * exp(-least(greatest(2 * ln(s1 + 1e-6), -7.0), 5.0)) * pow(m1 - b1, 2) + 0.5 * least(greatest(2 * ln(s1 + 1e-6), -7.0), 5.0)), 6) AS nll,
  round(avg(exp(-0.2 * (1998 - year(acq_date)) * 0.5) + 0.5), 6) AS mean_weight FROM cube JOIN moments USING (pixel_id) WHERE b1 IS NOT NULL GROUP BY ALL""")
def nll_score(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    joined = seen.join(P.moments(seen), "pixel_id").where("b1 IS NOT NULL")
    one = S.nll(F.col("b1_mean"), F.col("b1"), 2 * F.log(F.col("b1_std") + 1e-6))
    weight = S.recency_weight(1998 - F.year("acq_date"), 0.2)
    return rounded(joined.groupBy(F.year("acq_date").alias("year")).agg(F.avg(one).alias("nll"), F.avg(weight).alias("mean_weight")))


@query(f"""WITH {CUBE}{SCORED} SELECT s.pixel_id, s.acq_date, {', '.join(f'CAST(least(greatest(round_even((b{i} - m{i}) * 10000, 0), -32768), 32767) AS SMALLINT) AS b{i}_q, round(m{i} + least(greatest(round_even((b{i} - m{i}) * 10000, 0), -32768), 32767) / 10000, 6) AS b{i}_rec' for i in range(1, 5))} FROM cube s JOIN moments USING (pixel_id)""", dates=("acq_date",))
def reconstruct(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    coded = B.residuals(seen.drop("valid").join(P.moments(seen), "pixel_id"), P.BANDS)
    made = B.reconstructed(coded, P.BANDS)
    return rounded(made.select("pixel_id", "acq_date", *[f"{b}_{x}" for b in P.BANDS for x in ("q", "rec")]))


# ---- scores


@query(f"WITH {CUBE}{SCORED} SELECT pixel_id, acq_date, round(d2, 5) AS d2 FROM scored", dates=("acq_date",))
def d2_score(spark, sf_dir):
    return rounded(P.scored(spark, sf_dir).select("pixel_id", "acq_date", "d2"), 5)


@query(f"WITH {CUBE}{SCORED} SELECT pixel_id, acq_date, round(sam, 5) AS sam FROM scored", dates=("acq_date",))
def sam_score(spark, sf_dir):
    return rounded(P.scored(spark, sf_dir).select("pixel_id", "acq_date", "sam"), 5)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL)
  SELECT vec_id, round(acos(greatest(-1.0, least(1.0, sum(CAST(x AS DOUBLE) * m) / (sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(sum(m * m)) + 1e-9)))), 5) AS angle FROM e JOIN c USING (label, i) GROUP BY vec_id""")
def sam_embeddings(spark, sf_dir):
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    joined = e.join(e.groupBy("label", "i").agg(F.avg("x").alias("m")), ["label", "i"])
    sums = joined.groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b"))
    cosine = F.col("d") / (F.sqrt("a") * F.sqrt("b") + 1e-9)
    return rounded(sums.select("vec_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle")), 5)


@query(f"WITH {CUBE}{SCORED}{ring_sql(SMALL_SCALES)} SELECT pixel_id, acq_date, round(cfar, 5) AS cfar FROM rings", dates=("acq_date",))
def cfar_single_ring(spark, sf_dir):
    made = P.with_cfar(spark, P.scored(spark, sf_dir), P.height(spark, sf_dir), SMALL_SCALES)
    return rounded(made.where("valid").select("pixel_id", "acq_date", "cfar"), 5)


@query(f"WITH {CUBE}{SCORED}{ring_sql(D.CFAR_SCALES)} SELECT pixel_id, acq_date, round(cfar, 5) AS cfar FROM rings", dates=("acq_date",))
def cfar_multiscale(spark, sf_dir):
    made = P.with_cfar(spark, P.scored(spark, sf_dir), P.height(spark, sf_dir))
    return rounded(made.where("valid").select("pixel_id", "acq_date", "cfar"), 5)


# ---- states


@query(f"WITH {CHANGE} SELECT pixel_id, frame_id, valid, round(change, 6) AS change FROM change")
def state_change(spark, sf_dir):
    return rounded(T.state_change(P.dense_cube(spark, sf_dir), P.BANDS).select("pixel_id", "frame_id", "valid", "change"))


@query(f"WITH {LIMIT} SELECT DISTINCT pixel_id, round(threshold, 6) AS threshold FROM limits")
def transition_threshold(spark, sf_dir):
    step = T.transition_threshold(T.state_change(P.dense_cube(spark, sf_dir), P.BANDS))
    return rounded(step.groupBy("pixel_id").agg(F.max("threshold").alias("threshold")))


@query(f"WITH {STABLE} SELECT pixel_id, frame_id, transition, last_transition, stable FROM stable")
def stable_suffix(spark, sf_dir):
    return T.stable_states(P.dense_cube(spark, sf_dir), P.BANDS).select("pixel_id", "frame_id", "transition", "last_transition", "stable")


@query(f"""WITH {STABLE}, px AS (SELECT pixel_id, max(last_transition) AS l, count_if(stable) AS n, max(threshold) AS th FROM stable GROUP BY pixel_id)
  SELECT count(*) AS pixel_count, CAST(count_if(l >= 0) AS BIGINT) AS transition_pixels, CAST(count_if(n > 0) AS BIGINT) AS retained_pixels, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS retained_fraction, round(avg(CAST(l >= 0 AS DOUBLE)), 6) AS transition_fraction,
  CAST(sum(n) AS BIGINT) AS stable_samples, round(median(th), 6) AS median_threshold, round(median(CASE WHEN l >= 0 THEN l END), 6) AS median_last_transition FROM px""")
def state_audit(spark, sf_dir):
    return rounded(T.state_audit(T.stable_states(P.dense_cube(spark, sf_dir), P.BANDS)))


@query(f"""WITH {STABLE}, q AS (SELECT acq_date, count(*) AS pixel_count, CAST(count_if(valid) AS BIGINT) AS valid_pixels, CAST(count_if(stable) AS BIGINT) AS stable_pixels FROM stable GROUP BY acq_date)
  SELECT *, round(valid_pixels / pixel_count, 6) AS valid_fraction, valid_pixels / pixel_count >= 0.95 AND stable_pixels >= 60 AS accepted,
  concat_ws(',', CASE WHEN valid_pixels / pixel_count < 0.95 THEN 'low_valid_fraction' END, CASE WHEN stable_pixels < 60 THEN 'few_stable_pixels' END) AS reasons FROM q""", dates=("acq_date",))
def date_qc(spark, sf_dir):
    return rounded(H.date_quality(T.stable_states(P.dense_cube(spark, sf_dir), P.BANDS), min_stable=60))


@query(f"WITH {CUBE} SELECT acq_date, CASE WHEN (row_number() OVER (ORDER BY acq_date) - 1) % 3 = 2 THEN 'validation' ELSE 'calibration' END AS role FROM (SELECT DISTINCT acq_date FROM cube)", dates=("acq_date",))
def cal_val_split(spark, sf_dir):
    return H.split_frames(P.raw(spark, sf_dir))


SAMPLE = "SELECT *, row_number() OVER (PARTITION BY acq_date ORDER BY md5('42|' || CAST(acq_date AS VARCHAR) || '|' || CAST(pixel_id AS VARCHAR)), pixel_id) AS place FROM cube WHERE valid"


@query(f"WITH {CUBE}, s AS ({SAMPLE}) SELECT pixel_id, acq_date FROM s WHERE place <= 40", dates=("acq_date",))
def sampled_pixels(spark, sf_dir):
    return H.sample_per_frame(P.cube(spark, sf_dir).where("valid").select("pixel_id", "acq_date"), 40)


# ---- thresholds and decision


def _scores(spark, sf_dir) -> DataFrame:
    made = P.with_cfar(spark, P.scored(spark, sf_dir), P.height(spark, sf_dir), SMALL_SCALES)
    return settled(made.select("pixel_id", "acq_date", "row", "col", "valid", "d2", "cfar", "sam"), "scores")


ALL_SCORES = f"{CUBE}{SCORED}{ring_sql(SMALL_SCALES)}, sc AS (SELECT s.pixel_id, s.acq_date, s.row, s.col, s.valid, s.d2, r.cfar, s.sam FROM scored s LEFT JOIN rings r USING (pixel_id, acq_date))"


def levels_sql(trims: list[float], source: str = "sc") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {t!r}::DOUBLE AS trim, (SELECT count(*) FROM fine) AS sample_count, (SELECT median(d2) FROM fine) AS robust_scale, (SELECT quantile_cont(d2, {1 - t!r}) FROM fine) AS null_limit" for t in trims
    )
    return f""", fine AS (SELECT * FROM {source} WHERE d2 IS NOT NULL AND cfar IS NOT NULL AND sam IS NOT NULL), cuts AS ({rows}
), counted AS (SELECT c.*, (SELECT count(*) FROM fine f WHERE f.d2 <= c.null_limit) AS inside FROM cuts c
), used AS (SELECT c.trim, c.sample_count, c.robust_scale, c.null_limit, f.d2, f.cfar, f.sam FROM counted c JOIN fine f ON c.inside < 1000 OR f.d2 <= c.null_limit
), refs AS (SELECT trim, any_value(sample_count) AS sample_count, count(*) AS null_count, any_value(null_limit) AS null_limit, any_value(robust_scale) AS robust_scale,
  quantile_cont(d2, 0.95) AS d2_reference, quantile_cont(cfar, 0.95) AS cfar_reference, quantile_cont(sam, 0.95) AS sam_reference FROM used GROUP BY trim
), joint AS (SELECT u.trim, least(u.d2 / (r.d2_reference + 1e-12), greatest(u.cfar / (r.cfar_reference + 1e-12), u.sam / (r.sam_reference + 1e-12))) AS j FROM used u JOIN refs r USING (trim))"""


def thresholds_sql(alphas, source: str = "sc") -> str:
    trims = {a: H.trim_for(a) for a in alphas}
    rows = " UNION ALL ".join(f"SELECT {a!r}::DOUBLE AS alpha, r.*, (SELECT quantile_cont(j, {1 - a!r}) FROM joint WHERE trim = {trims[a]!r}::DOUBLE) AS fusion_threshold FROM refs r WHERE trim = {trims[a]!r}::DOUBLE" for a in alphas)
    return levels_sql(sorted(set(trims.values())), source) + f", th AS ({rows})"


THRESHOLD_COLUMNS = "alpha, trim, sample_count, null_count, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("null_limit", "robust_scale", "d2_reference", "cfar_reference", "sam_reference", "fusion_threshold"))


@query(f"WITH {ALL_SCORES}{thresholds_sql([0.01, 0.005, 0.001])} SELECT {THRESHOLD_COLUMNS} FROM th")
def null_thresholds(spark, sf_dir):
    made = H.null_thresholds(_scores(spark, sf_dir), [0.01, 0.005, 0.001], check=False)
    return rounded(made, 5).withColumns({"alpha": F.col("alpha"), "trim": F.col("trim")})


@query("""WITH r AS (SELECT o_orderpriority AS grp, o_totalprice AS v, CAST(o_custkey % 17 AS DOUBLE) AS w FROM orders WHERE o_custkey % 17 > 0), c AS (
  SELECT grp, v, (sum(w) OVER (PARTITION BY grp ORDER BY v, w ROWS UNBOUNDED PRECEDING) - 0.5 * w) / sum(w) OVER (PARTITION BY grp) AS c FROM r
), l AS (SELECT *, lead(c) OVER (PARTITION BY grp ORDER BY c, v) AS c2, lead(v) OVER (PARTITION BY grp ORDER BY c, v) AS v2 FROM c)
  SELECT grp, round(coalesce(max(CASE WHEN c <= 0.9 AND c2 > 0.9 THEN v + (v2 - v) * ((0.9 - c) / (c2 - c)) END), CASE WHEN min(c) > 0.9 THEN arg_min(v, c) END, arg_max(v, c)), 4) AS quantile, count(*) AS sample_count FROM l GROUP BY grp""")
def weighted_quantile(spark, sf_dir):
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice", (F.col("o_custkey") % 17).cast("double").alias("w"))
    return rounded(H.weighted_quantile(rows, 0.9, "o_totalprice", "w", ["grp"]), 4)


RATIOS = ", ".join(f"CASE WHEN valid THEN greatest({c} / ({c}_reference + 1e-12), 0.0) END AS {c}_ratio" for c in ("d2", "cfar", "sam"))
DECIDED = f""", rt AS (SELECT sc.*, th.alpha, greatest(th.fusion_threshold, 1e-12) AS jt, {RATIOS} FROM sc CROSS JOIN th
), dc AS (SELECT *, CASE WHEN valid THEN least(d2_ratio, greatest(cfar_ratio, sam_ratio)) / jt END AS score, coalesce(d2_ratio > jt AND (cfar_ratio > jt OR sam_ratio > jt), false) AS mask FROM rt)"""


@query(f"WITH {ALL_SCORES}{thresholds_sql([0.01])}{DECIDED} SELECT pixel_id, acq_date, round(score, 5) AS score, mask FROM dc", dates=("acq_date",))
def decision_mask(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    made = H.decide(sc, H.null_thresholds(sc, [0.01], check=False))
    return rounded(made.select("pixel_id", "acq_date", "score", "mask"), 5)


FAR = ", far AS (SELECT alpha, acq_date, CAST(count_if(valid) AS BIGINT) AS valid_pixels, CAST(count_if(mask) AS BIGINT) AS anomaly_pixels, CASE WHEN count_if(valid) > 0 THEN count_if(mask) / count_if(valid) END AS far FROM dc GROUP BY ALL)"


@query(f"WITH {ALL_SCORES}{thresholds_sql([0.01, 0.001])}{DECIDED}{FAR} SELECT alpha, acq_date, valid_pixels, anomaly_pixels, round(far, 6) AS far FROM far", dates=("acq_date",))
def date_far(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    made = H.false_alarm_rates(H.decide(sc, H.null_thresholds(sc, [0.01, 0.001], check=False)))
    return rounded(made.select("alpha", "acq_date", "valid_pixels", "anomaly_pixels", "far"))


@query(f"""WITH {ALL_SCORES}, roles AS (SELECT acq_date, (row_number() OVER (ORDER BY acq_date) - 1) % 3 = 2 AS held FROM (SELECT DISTINCT acq_date FROM cube)
), cal AS (SELECT sc.* FROM sc JOIN roles USING (acq_date) WHERE NOT held){thresholds_sql(sorted(D.ALPHA_CANDIDATES, reverse=True), 'cal')}{DECIDED.replace('FROM sc CROSS', 'FROM (SELECT sc.* FROM sc JOIN roles USING (acq_date) WHERE held) sc CROSS')}{FAR}
, by_alpha AS (SELECT alpha, avg(far) AS mean_far, quantile_cont(far, 0.95) AS selection_far FROM far GROUP BY alpha)
SELECT alpha, round(mean_far, 6) AS mean_far, round(selection_far, 6) AS selection_far, alpha = coalesce((SELECT max(alpha) FROM by_alpha WHERE selection_far <= 0.01), (SELECT min(alpha) FROM by_alpha)) AS selected FROM by_alpha""")
def alpha_selection(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    roles = H.split_frames(sc)
    parts = [sc.join(roles.where(F.col("role") == r).select("acq_date"), "acq_date", "left_semi") for r in ("calibration", "validation")]
    made = H.evaluate_alphas(*parts, check=False)
    return made.select("alpha", F.round("mean_far", 6).alias("mean_far"), F.round("selection_far", 6).alias("selection_far"), "selected")


@query(f"""WITH {ALL_SCORES}{thresholds_sql([0.01])}{DECIDED} SELECT acq_date, CAST(count_if(valid) AS BIGINT) AS valid_pixels, CAST(count_if(mask) AS BIGINT) AS anomaly_pixels, round(count_if(mask) * 400.0 / 1e6, 6) AS area_km2, round(max(score), 5) AS top_score FROM dc GROUP BY acq_date""", dates=("acq_date",))
def area_summary(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    made = H.decide(sc, H.null_thresholds(sc, [0.01], check=False))
    by = V.summarised(settled(made, "decided"), V.Config(tuple(P.BANDS), 0, P.WIDTH))
    return by.select("acq_date", "valid_pixels", "anomaly_pixels", F.round("area_km2", 6).alias("area_km2"), F.round("top_score", 5).alias("top_score"))


GRID_MASK = ", g AS (SELECT acq_date, row, col FROM scored WHERE valid AND d2 > 5)"


def _grid_mask(spark, sf_dir) -> DataFrame:
    return P.scored(spark, sf_dir).select("acq_date", "row", "col", (F.col("valid") & (F.col("d2") > 5)).alias("mask"))


def labels_sql(eight: bool) -> str:
    near = "abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1" if eight else "abs(n.row - r.row) + abs(n.col - r.col) = 1"
    return f"""{CUBE}{SCORED}{GRID_MASK}, reach(acq_date, row, col, label) AS (
  SELECT acq_date, row, col, row * 10 + col FROM g UNION SELECT n.acq_date, n.row, n.col, r.label FROM reach r JOIN g n ON n.acq_date = r.acq_date AND {near} AND n.row * 10 + n.col > r.label
), lab AS (SELECT acq_date, row, col, min(label) AS label FROM reach GROUP BY ALL), lab2 AS (SELECT * FROM lab)"""


@query(f"""WITH RECURSIVE {labels_sql(False)}, seeds AS (SELECT DISTINCT acq_date, label FROM lab), num AS (SELECT acq_date, label, row_number() OVER (PARTITION BY acq_date ORDER BY label) AS region_id FROM seeds)
  SELECT acq_date, region_id, count(*) AS n_pixels, round(count(*) * 400.0, 4) AS area_m2, round(avg(col + 0.5), 4) AS x, round(avg(row + 0.5), 4) AS y, CAST(min(col) AS DOUBLE) AS x0, CAST(max(row) + 1 AS DOUBLE) AS y1 FROM lab JOIN num USING (acq_date, label) GROUP BY ALL""", dates=("acq_date",))
def connected_regions(spark, sf_dir):
    made = R.region_table(_grid_mask(spark, sf_dir), frame="acq_date")
    return made.select("acq_date", "region_id", "n_pixels", F.round("area_m2", 4).alias("area_m2"), F.round(F.element_at("centroid", 1), 4).alias("x"), F.round(F.element_at("centroid", 2), 4).alias("y"), F.element_at("bounds", 1).alias("x0"), F.element_at("bounds", 4).alias("y1"))


@query(f"WITH RECURSIVE {labels_sql(True)}, sizes AS (SELECT acq_date, label FROM lab GROUP BY ALL HAVING count(*) >= 3) SELECT acq_date, row, col FROM lab JOIN sizes USING (acq_date, label)", dates=("acq_date",))
def drop_small_regions(spark, sf_dir):
    return R.drop_small(_grid_mask(spark, sf_dir), 3, "acq_date").select("acq_date", "row", "col")


@query(f"""WITH {CUBE}{SCORED}{GRID_MASK}, dims AS (SELECT max(pixel_id) // 10 + 1 AS h, 10 AS w FROM raw), pad AS (
  SELECT DISTINCT g.acq_date, r.x AS row, c.x AS col FROM g CROSS JOIN dims, unnest([CAST(g.row AS BIGINT), CASE WHEN g.row = 0 THEN -1 END, CASE WHEN g.row = h - 1 THEN h END]) AS r(x), unnest([CAST(g.col AS BIGINT), CASE WHEN g.col = 0 THEN -1 END, CASE WHEN g.col = 9 THEN 10 END]) AS c(x) WHERE r.x IS NOT NULL AND c.x IS NOT NULL
), cross5 AS (SELECT unnest([0, 0, 0, 1, -1]) AS dr, unnest([0, 1, -1, 0, 0]) AS dc
), grown AS (SELECT DISTINCT acq_date, row + dr AS row, col + dc AS col FROM pad CROSS JOIN cross5), inside AS (SELECT grown.* FROM grown CROSS JOIN dims WHERE row BETWEEN -1 AND h AND col BETWEEN -1 AND w
), votes AS (SELECT acq_date, row + dr AS row, col + dc AS col, count(*) AS n FROM inside CROSS JOIN cross5 GROUP BY ALL)
  SELECT acq_date, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM votes CROSS JOIN dims WHERE n = 5 AND row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1""", dates=("acq_date",))
def closing(spark, sf_dir):
    return R.closed(_grid_mask(spark, sf_dir), P.height(spark, sf_dir), P.WIDTH, "acq_date").select("acq_date", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


# ---- evaluation and audit


@query("""WITH c AS (SELECT count(*) AS n, CAST(count_if(quality = 0 AND toxic = 0) AS BIGINT) AS tn, CAST(count_if(quality = 0 AND toxic = 1) AS BIGINT) AS fp, CAST(count_if(quality = 1 AND toxic = 0) AS BIGINT) AS fn, CAST(count_if(quality = 1 AND toxic = 1) AS BIGINT) AS tp FROM labels)
  SELECT *, round((tn + tp) / greatest(n, 1), 6) AS accuracy, round(tp / greatest(tp + fn, 1), 6) AS recall, round(tp / greatest(tp + fp, 1), 6) AS precision, round(fp / greatest(fp + tn, 1), 6) AS false_alarm, round(tn / greatest(fp + tn, 1), 6) AS specificity, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    return rounded(E.confusion_metrics(P.table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic")))


@query(f"""WITH {CUBE}{SCORED}, r AS (SELECT year(acq_date) AS year, unnest([{', '.join(f'b{i} - m{i}' for i in range(1, 5))}]) AS r FROM cube JOIN moments USING (pixel_id))
  SELECT CAST(year AS INTEGER) AS year, round(sqrt(avg(r * r)), 6) AS rmse, count(r) AS n FROM r WHERE r IS NOT NULL GROUP BY year""")
def pooled_rmse(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    joined = seen.join(P.moments(seen), "pixel_id").withColumn("year", F.year("acq_date"))
    return rounded(E.pooled_rmse(joined, [F.col(b) - F.col(f"{b}_mean") for b in P.BANDS], ["year"]))


@query("""WITH s AS (SELECT toxic AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
  SELECT round((sum(rk) FILTER (WHERE label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    joined = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")
    return rounded(E.roc_auc(joined.select(F.col("toxic").alias("label"), "score"), "label", "score"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 97.0 AS x, 12.0 - (c_custkey * 53 % 1300) / 100.0 AS y FROM customer), q AS (SELECT *, CAST(floor((y - 12.0) / -1.0) AS INTEGER) AS row, CAST(floor((x - 0.5) / 1.0) AS INTEGER) AS col FROM p WHERE x >= 0.5)
  SELECT row, col, count(*) AS n, min(c_custkey) AS first_key FROM q WHERE row BETWEEN 0 AND 9 AND col BETWEEN 0 AND 8 GROUP BY ALL""")
def label_grid_join(spark, sf_dir):
    points = P.table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 1000) / 97.0).alias("x"), (12.0 - (F.col("c_custkey") * 53 % 1300) / 100.0).alias("y"))
    placed = E.labels_on_grid(points, (1.0, 0, 0.5, 0, -1.0, 12.0), 10, 9)
    return placed.groupBy("row", "col").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query(f"""WITH {CUBE}, support AS (SELECT acq_date, count(*) >= 1 AS support FROM cube GROUP BY acq_date)
  SELECT acq_date, CAST(count_if(valid AND support) AS BIGINT) AS supported_pixels FROM cube JOIN support USING (acq_date) GROUP BY acq_date""", dates=("acq_date",))
def fixed_support_join(spark, sf_dir):
    seen = P.cube(spark, sf_dir)
    support = seen.groupBy("acq_date").agg((F.count("*") >= 1).alias("support"))
    return E.covered(seen, support, ["acq_date"]).groupBy("acq_date").agg(F.count_if(F.col("valid") & F.col("support")).alias("supported_pixels"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right,
  (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS shared""")
def same_keys(spark, sf_dir):
    return E.same_keys(P.table(spark, sf_dir, "documents"), P.table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH f AS (SELECT doc_id AS path, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents), d AS (SELECT doc_id AS path, sha256(trim(text, ' ')) AS h FROM documents JOIN labels USING (doc_id) UNION ALL SELECT page_id + 10000000, sha256(html) FROM pages)
  SELECT coalesce(f.path, d.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'untracked' ELSE 'modified' END AS status FROM f FULL JOIN d ON f.path = d.path WHERE f.path IS NULL OR d.path IS NULL OR f.h <> d.h""")
def manifest_diff(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("path"), digests.text_digest(F.col("text")).alias("sha256"))
    declared = docs.join(P.table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.sha2(F.trim("text"), 256).alias("sha256"))
    pages = P.table(spark, sf_dir, "pages").select((F.col("page_id") + 10000000).alias("path"), digests.text_digest(F.col("html")).alias("sha256"))
    return E.manifest_diff(declared.unionByName(pages), found)


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", dates=("day",))
def scene_stream(spark, sf_dir):
    from pixeltide.streaming.arrivals import daily_totals

    return rounded(daily_totals(spark, sf_dir), 4)
