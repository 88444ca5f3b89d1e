"""Registered queries that hold single functions, files and verbs against SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.functions import dates, digests, masks, planning, scores as S
from pixeltide.operators import baseline as B, evaluate as E, regions as R, thresholds as H
from pixeltide.plans import cube as P, queries as Q, verbs as V
from pixeltide.plans.queries import rounded
from pixeltide.plans.shared import folder, settled
from pixeltide.sources import models as M, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, dates: tuple[str, ...] = ()):
    return Q.query(sql, dates, (QUERIES, ORACLE_SQL))


# ---- functions


@query(f"WITH {Q.CUBE} SELECT pixel_id, acq_date, CAST(pixel_id // 10 - 1 AS INTEGER) AS row, CAST(pixel_id % 10 - 2 AS INTEGER) AS col FROM cube WHERE pixel_id // 10 BETWEEN 1 AND 6 AND pixel_id % 10 BETWEEN 2 AND 7", dates=("acq_date",))
def roi_window(spark, sf_dir):
    return scenes.roi(P.with_grid(P.cube(spark, sf_dir)), 2, 1, 6, 6).select("pixel_id", "acq_date", "row", "col")


@query(f"WITH {Q.RAW} SELECT pixel_id, round(sum(CASE WHEN x3 > 0 AND x3 <= 1 THEN x3 ELSE 0 END), 4) AS third, round(sum(CASE WHEN x4 > 0 AND x4 <= 1 THEN x4 ELSE 0 END), 4) AS fourth FROM raw GROUP BY pixel_id")
def zero_filled(spark, sf_dir):
    raw = P.raw(spark, sf_dir)
    return rounded(raw.groupBy("pixel_id").agg(F.sum(masks.range_mask_zero(F.col("b3"))).alias("third"), F.sum(masks.range_mask_zero(F.col("b4"))).alias("fourth")), 4)


@query("""WITH p AS (SELECT o_orderkey, o_totalprice / 1e5 AS x, (o_custkey % 7) / 10.0 AS lo, 1.0 + (o_custkey % 5) AS hi FROM orders)
  SELECT o_orderkey, round(ln(1 + x), 9) AS inside, round(x, 9) AS back, round(x * (hi - lo) + lo, 9) AS mean, round(0.1 * (hi - lo), 9) AS std FROM p""")
def log_and_range(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"), ((F.col("o_custkey") % 7) / 10.0).alias("lo"), (1.0 + F.col("o_custkey") % 5).alias("hi"))
    inside = S.log_in(F.col("x"))
    mean, std = S.denormalized(S.log_out(inside), F.lit(0.1), F.col("lo"), F.col("hi"))
    return rounded(o.select("o_orderkey", inside.alias("inside"), S.log_out(inside).alias("back"), mean.alias("mean"), std.alias("std")), 9)


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
  SELECT event_id, ts AS iso, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN ts END AS configured FROM e""", dates=("iso", "configured"))
def parsed_times(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    kind = F.col("event_id") % 3
    given = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a day")
    return e.select("event_id", dates.parsed_iso(iso).alias("iso"), dates.parsed_config(given).alias("configured"))


@query("""SELECT n_regionkey AS region, sha256('1|' || count(*) || '|uint8|' || string_agg(CAST(n_nationkey % 2 AS VARCHAR), '' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY n_regionkey""")
def mask_digests(spark, sf_dir):
    nations = P.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    bits = F.transform("keys", lambda k: (k % 2).cast("int"))
    return nations.select("region", digests.mask_digest(F.lit(1), F.size("keys"), bits).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'empty image' WHEN 2 + event_id % 2 <> 3 THEN 'image must have three dimensions' WHEN event_id % 5 <> 3 THEN 'expected 3 bands' WHEN event_id % 11 < 6 THEN 'missing acquisition date' END AS message FROM events""")
def input_messages(spark, sf_dir):
    e, i = P.table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", masks.input_message(i % 7, 2 + i % 2, i % 5, 3, F.when(i % 11 >= 6, F.col("ts"))).alias("message"))


@query("""WITH d AS (SELECT doc_id, doc_id % 256 AS place, sha256(coalesce(text, '')) AS h FROM documents)
  SELECT doc_id, (CAST('0x' || substr(h, CAST(2 * (place // 8) + 1 AS BIGINT), 2) AS INTEGER) >> CAST(7 - place % 8 AS INTEGER)) & 1 = 1 AS bit FROM d""")
def packed_bits(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.base64(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("packed"))
    return d.select("doc_id", planning.packed_bit(F.col("packed"), F.col("doc_id") % 256).alias("bit"))


@query(f"""WITH {Q.CUBE}, s AS (SELECT CAST(max(pixel_id) // 10 + 1 AS INTEGER) AS h, CAST(count(DISTINCT acq_date) AS INTEGER) AS n, min(acq_date) AS first FROM cube)
  SELECT least(greatest(17, CAST(ceil(log2(10 * h)) AS INTEGER) + 2), 22) AS spatial_log2, greatest(16, CAST(ceil(log2(10 * n)) AS INTEGER)) AS temporal_log2, round(pow(1.5 * greatest(10, h) / 32, 1.0 / 15), 4) AS per_level_scale,
    CAST(first + CAST(floor(32 * pow(1.5, 4)) AS INTEGER) AS VARCHAR) AS last_day FROM s""")
def grid_capacity(spark, sf_dir):
    facts = P.cube(spark, sf_dir).agg(F.max("pixel_id").alias("top"), F.count_distinct("acq_date").alias("n"), F.min("acq_date").alias("first")).first()
    advice = planning.grid_advice(P.WIDTH, int(facts["top"]) // P.WIDTH + 1, facts["n"])
    row = (advice["spatial_log2"], advice["temporal_log2"], advice["per_level_scale"], planning.capacity_end(str(facts["first"]), 32, 5, 1.5))
    return spark.createDataFrame([row], "spatial_log2 int, temporal_log2 int, per_level_scale double, last_day string")


@query("""WITH m AS (SELECT o_custkey, max(abs(o_totalprice / 1e5 - 2)) AS top FROM orders GROUP BY o_custkey), w AS (SELECT o_orderkey, o_totalprice / 1e5 - 2 AS w, top FROM orders JOIN m USING (o_custkey))
  SELECT o_orderkey, CAST(least(greatest(round_even(w * (128.0 / CASE WHEN top > 0 THEN top ELSE 1 END), 0), -128), 127) AS INTEGER) AS code, round(128.0 / CASE WHEN top > 0 THEN top ELSE 1 END, 6) AS scale FROM w""")
def weight_codes(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1e5 - 2).alias("w"))
    joined = o.join(o.groupBy("o_custkey").agg(F.max(F.abs("w")).alias("top")), "o_custkey")
    code, scale = S.quantized_weights(F.col("w"), F.col("top"), 8)
    return rounded(joined.select("o_orderkey", code.alias("code"), scale.alias("scale")))


# ---- joins, samples, sets


SEASON = "0.01 * (pixel_id % 5) + 0.02 * cos(w) - 0.01 * sin(w) + 0.005 * cos(2 * w) + 0.003 * sin(2 * w) + 0.001 * (pixel_id % 3) * cos(3 * w) - 0.002 * sin(3 * w)"


@query(f"""WITH {Q.CUBE}{Q.SCORED}, d AS (SELECT *, date_diff('day', DATE '1992-01-01', acq_date) * (2 * pi() / 365.25) AS w FROM cube JOIN moments USING (pixel_id))
  SELECT pixel_id, acq_date, round(m1 + {SEASON}, 6) AS mean, round(0.1 + (pixel_id % 4) / 10.0, 6) AS std FROM d""", dates=("acq_date",))
def corrected_prediction(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    predicted = seen.join(P.moments(seen), "pixel_id").select("pixel_id", "acq_date", "b1_mean", "b1_std")
    p = F.col("pixel_id")
    terms = [0.01 * (p % 5), F.lit(0.02), F.lit(-0.01), F.lit(0.005), F.lit(0.003), 0.001 * (p % 3), F.lit(-0.002)]
    correction = seen.select("pixel_id").distinct().select("pixel_id", F.array(*[F.array(t.cast("double")) for t in terms]).alias("coef"), F.array(0.1 + (p % 4) / 10.0).alias("scale"))
    made = B.corrected(predicted, correction, ["b1"], F.datediff("acq_date", F.lit("1992-01-01").cast("date")))
    return rounded(made.select("pixel_id", "acq_date", F.col("b1_mean").alias("mean"), F.col("b1_std").alias("std")))


@query(f"""WITH {Q.CUBE}, s AS (SELECT pixel_id, acq_date, row_number() OVER (PARTITION BY acq_date ORDER BY md5('7|' || CAST(acq_date AS VARCHAR) || '|' || CAST(pixel_id AS VARCHAR)), pixel_id) AS place FROM cube WHERE valid AND pixel_id % 3 <> 0)
  SELECT pixel_id, acq_date FROM s WHERE place <= 20""", dates=("acq_date",))
def fixed_support_samples(spark, sf_dir):
    seen = P.cube(spark, sf_dir, settle=True)
    support = seen.select("acq_date", "pixel_id", (F.col("pixel_id") % 3 != 0).alias("support"))
    return H.fixed_support_sample(seen.select("pixel_id", "acq_date", "valid"), support, 20, 7).select("pixel_id", "acq_date")


@query(f"WITH {Q.CUBE} SELECT CAST(min(acq_date) AS VARCHAR) AS first, CAST(max(acq_date) AS VARCHAR) AS last FROM cube WHERE acq_date BETWEEN DATE '1993-02-15' AND DATE '1997-10-10'")
def time_domain(spark, sf_dir):
    found = V.time_domain(P.cube(spark, sf_dir), V.Config(tuple(P.BANDS), 0, P.WIDTH, "1993-02-15", "1997-10-10"))
    return spark.createDataFrame([found], "first string, last string")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT page_id AS doc_id FROM pages")
def key_union(spark, sf_dir):
    docs, labels, pages = (P.table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return E.distinct_union(E.distinct_union(docs, labels, ["doc_id"]), pages.select(F.col("page_id").alias("doc_id")), ["doc_id"])


@query(f"""WITH p AS ({Q.ORACLE_SQL['manifest_diff']}), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS place FROM p)
  SELECT status, count(*) AS n, string_agg(CAST(path AS VARCHAR), ',' ORDER BY path) FILTER (WHERE place <= 5) AS first FROM r GROUP BY status""")
def first_problems(spark, sf_dir):
    found = E.first_errors(settled(Q.QUERIES["manifest_diff"](spark, sf_dir), "problems"))
    return found.select("status", "n", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"))


@query("SELECT p_partkey, 'a' || p_partkey || '.tif' AS path FROM part UNION ALL SELECT p_partkey, 'b' || p_partkey || '.tif' FROM part WHERE p_partkey % 3 = 0")
def listed_sources(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    one, two = F.concat(F.lit("a"), key, F.lit(".tif")), F.concat(F.lit("b"), key, F.lit(".tif"))
    records = P.table(spark, sf_dir, "part").select("p_partkey", one.alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array(one, two))).alias("source_paths"))
    return M.source_paths(records).select("p_partkey", F.explode("paths").alias("path"))


# ---- files


@query("SELECT round((c_custkey * 37 % 1000) / 97.0, 6) AS x, round(12.0 - (c_custkey * 53 % 1300) / 100.0, 6) AS y, CAST(c_custkey % 2 AS INTEGER) AS label FROM customer")
def label_file(spark, sf_dir):
    key, path = F.col("c_custkey"), f"{folder(spark)}/labels-{spark.sparkContext.applicationId}"
    points = P.table(spark, sf_dir, "customer").select(key.alias("FID"), (key % 2).alias("GT_Label"), ((key * 37 % 1000) / 97.0).alias("LON"), (12.0 - (key * 53 % 1300) / 100.0).alias("Lat"))
    points.write.mode("overwrite").option("header", True).csv(path)
    return rounded(M.read_labels(spark, path))


@query(f"SELECT CAST(n AS VARCHAR) AS n, CAST(tp AS VARCHAR) AS tp, round(recall, 5) AS recall, round(f1, 5) AS f1 FROM ({Q.ORACLE_SQL['confusion_metrics']})")
def metrics_file(spark, sf_dir):
    path = f"{folder(spark)}/metrics-{spark.sparkContext.applicationId}"
    M.write_metrics(Q.QUERIES["confusion_metrics"](spark, sf_dir), path)
    back = M.read_manifest(spark, path)
    return back.select("n", "tp", F.round(F.col("recall").cast("double"), 5).alias("recall"), F.round(F.col("f1").cast("double"), 5).alias("f1"))


# ---- verbs


SUMMARY = f"""{Q.labels_sql(False)}, counts AS (SELECT acq_date, count(DISTINCT label) AS regions FROM lab GROUP BY acq_date
), by_day AS (SELECT acq_date, CAST(count_if(valid) AS BIGINT) AS valid_pixels, CAST(count_if(valid AND d2 > 5) AS BIGINT) AS anomaly_pixels, max(d2) AS top_score FROM scored GROUP BY acq_date
), summary AS (SELECT acq_date, valid_pixels, anomaly_pixels, round(top_score, 4) AS top_score, coalesce(regions, 0) AS regions, round(anomaly_pixels * 400.0 / 1e6, 6) AS area_km2 FROM by_day LEFT JOIN counts USING (acq_date))"""


def _summary(spark, sf_dir) -> DataFrame:
    sc = P.scored(spark, sf_dir).select("acq_date", "row", "col", "valid", F.col("d2").alias("score"), F.coalesce(F.col("valid") & (F.col("d2") > 5), F.lit(False)).alias("mask"))
    made = V.summarised(settled(sc, "decided"), V.Config(tuple(P.BANDS), 0, P.WIDTH))
    return made.withColumns({"top_score": F.round("top_score", 4), "area_km2": F.round("area_km2", 6)})


@query(f"WITH RECURSIVE {SUMMARY} SELECT * FROM summary", dates=("acq_date",))
def frame_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("acq_date", "valid_pixels", "anomaly_pixels", "top_score", "regions", "area_km2")


@query(f"WITH RECURSIVE {SUMMARY} SELECT count(*) AS scenes, CAST(count_if(anomaly_pixels > 0) AS BIGINT) AS with_anomaly, round(sum(area_km2), 4) AS area_km2 FROM summary")
def batch_totals(spark, sf_dir):
    return rounded(M.batch_summary(_summary(spark, sf_dir)), 4)


@query(f"""WITH RECURSIVE {SUMMARY} SELECT acq_date, CASE WHEN anomaly_pixels > 0 THEN 'anomaly' ELSE 'no_anomaly' END AS kind, CASE WHEN anomaly_pixels > 0 THEN CAST(regions AS VARCHAR) END AS regions,
  round(CASE WHEN anomaly_pixels > 0 THEN round(area_km2, 4) ELSE 0 END, 4) AS area_km2 FROM summary""", dates=("acq_date",))
def alert_documents(spark, sf_dir):
    made = M.alerts(_summary(spark, sf_dir), "2024-01-01T00:00:00")
    field = lambda name: F.get_json_object("alert", f"$.{name}")
    return rounded(made.select("acq_date", field("type").alias("kind"), field("regions").alias("regions"), field("area_km2").cast("double").alias("area_km2")), 4)


@query(f"""WITH RECURSIVE {Q.labels_sql(True)}, sizes AS (SELECT acq_date, label FROM lab GROUP BY ALL HAVING count(*) >= 3), kept AS (SELECT acq_date, row, col FROM lab JOIN sizes USING (acq_date, label)
), dims AS (SELECT max(pixel_id) // 10 + 1 AS h, 10 AS w FROM raw), pad AS (
  SELECT DISTINCT g.acq_date, r.x AS row, c.x AS col FROM kept g CROSS JOIN dims, unnest([CAST(g.row AS BIGINT), CASE WHEN g.row = 0 THEN -1 END, CASE WHEN g.row = h - 1 THEN h END]) AS r(x), unnest([CAST(g.col AS BIGINT), CASE WHEN g.col = 0 THEN -1 END, CASE WHEN g.col = 9 THEN 10 END]) AS c(x) WHERE r.x IS NOT NULL AND c.x IS NOT NULL
), cross5 AS (SELECT unnest([0, 0, 0, 1, -1]) AS dr, unnest([0, 1, -1, 0, 0]) AS dc
), grown AS (SELECT DISTINCT acq_date, row + dr AS row, col + dc AS col FROM pad CROSS JOIN cross5), inside AS (SELECT grown.* FROM grown CROSS JOIN dims WHERE row BETWEEN -1 AND h AND col BETWEEN -1 AND w
), votes AS (SELECT acq_date, row + dr AS row, col + dc AS col, count(*) AS n FROM inside CROSS JOIN cross5 GROUP BY ALL)
  SELECT acq_date, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM votes CROSS JOIN dims WHERE n = 5 AND row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1""", dates=("acq_date",))
def cleaned_mask(spark, sf_dir):
    mask = settled(Q._grid_mask(spark, sf_dir), "mask")
    made = R.cleaned(mask, P.height(spark, sf_dir), P.WIDTH, 3, "acq_date")
    return made.select("acq_date", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


@query(f"""WITH {Q.ALL_SCORES}{Q.thresholds_sql([0.01])}{Q.DECIDED} SELECT acq_date, CAST(count_if(valid) AS BIGINT) AS valid_pixels, CAST(count_if(coalesce(d2_ratio > jt, false)) AS BIGINT) AS d2_exceedances, CAST(count_if(coalesce(cfar_ratio > jt, false)) AS BIGINT) AS cfar_exceedances,
  CAST(count_if(coalesce(sam_ratio > jt, false)) AS BIGINT) AS sam_exceedances, CAST(count_if(mask) AS BIGINT) AS anomaly_pixels FROM dc GROUP BY acq_date""", dates=("acq_date",))
def decision_diagnostics(spark, sf_dir):
    sc = Q._scores(spark, sf_dir)
    return H.diagnostics(H.decide(sc, H.null_thresholds(sc, [0.01], check=False)), ["acq_date"])
