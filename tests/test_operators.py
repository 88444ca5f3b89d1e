"""Operators against NumPy versions written for the tests."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixeltide.functions import dates, masks, scores as S
from pixeltide.operators import composite as C, evaluate as E, regions as R, states as T, thresholds as H
from pixeltide.operators.cfar import cfar, disc_sum, radii, ring_contrast


def slow_ring(grid, fill, scales):
    best = np.zeros_like(grid)
    for outer, inner in radii(scales):
        p = np.pad(grid, outer, constant_values=fill)
        y, x = np.ogrid[-outer : outer + 1, -outer : outer + 1]
        ring = (x * x + y * y <= outer * outer) & (x * x + y * y > inner * inner)
        mean = np.array([[p[r : r + 2 * outer + 1, c : c + 2 * outer + 1][ring].mean() for c in range(grid.shape[1])] for r in range(grid.shape[0])])
        best = np.maximum(best, grid - mean)
    return best


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=20, deadline=None)
def test_ring_matches_brute_force(h, w, seed):
    grid = np.random.default_rng(seed).gamma(3, 1, (h, w))
    scales = ((11, 3), (25, 9), (51, 21))
    assert np.allclose(ring_contrast(grid, 1.5, scales), slow_ring(grid, 1.5, scales))


def test_ring_sizes():
    counts = [disc_sum(np.ones((1, 1)), o, 1.0)[0, 0] - disc_sum(np.ones((1, 1)), i, 1.0)[0, 0] for o, i in radii()]
    assert counts == [76, 392, 1644]


def test_cfar_tiles_agree(spark):
    rng = np.random.default_rng(3)
    grid = rng.gamma(3, 1, (40, 12))
    rows = [(0, r, c, float(grid[r, c]), bool((r * 7 + c) % 11)) for r in range(40) for c in range(12)]
    df = spark.createDataFrame(rows, "frame_id int, row int, col int, d2 double, valid boolean")
    filled = np.array([v if ok else np.nan for *_, v, ok in rows]).reshape(40, 12)
    fill = np.nanmedian(filled)
    want = ring_contrast(np.where(np.isnan(filled), fill, filled), fill)
    for tile in (512, 7):
        got = {(r["row"], r["col"]): r["cfar"] for r in cfar(df, 40, 12, tile_rows=tile).collect()}
        assert len(got) == np.isfinite(filled).sum()
        assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def slow_states(states, valid, days):
    t = len(days)
    change = np.full(states.shape[:2], np.nan)
    change[0] = 0
    elapsed = np.diff(days)
    ref = np.median(elapsed)
    for i in range(1, t):
        both = valid[i] & valid[i - 1]
        change[i] = np.where(both, np.abs(states[i] - states[i - 1]).mean(-1) / elapsed[i - 1] * ref, np.nan)
    out = np.zeros_like(valid)
    for p in range(states.shape[1]):
        h = change[1:, p][np.isfinite(change[1:, p])]
        limit = np.nan
        if len(h) >= 2:
            limit = np.median(h) + 3 * max(1.4826 * np.median(np.abs(h - np.median(h))), 1e-4)
        moved = np.isfinite(change[:, p]) & (change[:, p] > limit if np.isfinite(limit) else False)
        last = max(np.flatnonzero(moved), default=-1)
        stable = valid[:, p] & (np.arange(t) >= (last + 1 if last >= 0 else 0)) & ~moved
        at = np.flatnonzero(stable)
        if len(at) >= 3 and days[at[-1]] - days[at[0]] >= 30:
            out[:, p] = stable
    return out


def test_stable_suffix_matches_numpy(spark):
    rng = np.random.default_rng(5)
    t, n = 14, 12
    days = np.cumsum(rng.integers(5, 40, t))
    states = rng.normal(0.4, 0.002, (t, n, 2)) + (np.arange(t)[:, None, None] >= rng.integers(0, t + 4, n)[None, :, None]) * 0.2
    valid = rng.random((t, n)) > 0.15
    valid[:, 0] = False
    valid[::2, 1] = False
    states[:, 2] = 0.5
    rows = [(p, i, int(days[i]), float(states[i, p, 0]), float(states[i, p, 1]), bool(valid[i, p])) for i in range(t) for p in range(n)]
    df = spark.createDataFrame(rows, "pixel_id int, frame_id int, d int, b1 double, b2 double, valid boolean").withColumn("acq_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    got = {(r["frame_id"], r["pixel_id"]): r["stable"] for r in T.stable_states(df, ["b1", "b2"]).collect()}
    want = slow_states(states, valid, days)
    assert got == {(i, p): bool(want[i, p]) for i in range(t) for p in range(n)}


def test_states_share_one_exchange(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("pixel_id"), (F.col("id") / 4).cast("int").alias("frame_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("acq_date"), F.rand(1).alias("b1"), F.lit(True).alias("valid"))
    plan = T.stable_suffix(T.transition_threshold(df.withColumn("change", F.rand(2))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pixel_id") == 1


@pytest.mark.parametrize("bad", [{"multiplier": 0}, {"guard_frames": -1}, {"min_observations": 1}, {"min_days": -1}])
def test_state_settings_are_checked(bad):
    with pytest.raises(ValueError):
        T.StateSettings(**bad)


def test_fewer_than_four_frames_are_rejected(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), ("2020-01-03",)], "d string").select(F.to_date("d").alias("acq_date"))
    with pytest.raises(ValueError, match="four"):
        T.check_frames(df)


def test_decision_by_hand(spark):
    rows = [(0, 3.0, 4.0, 0.1, True), (1, 3.0, 1.0, 0.3, True), (2, 1.0, 4.0, 0.3, True), (3, 3.0, 4.0, 0.3, False), (4, 2.0, 4.0, 0.3, True)]
    sc = spark.createDataFrame(rows, "k int, d2 double, cfar double, sam double, valid boolean")
    th = spark.createDataFrame([(0.01, 2.0, 3.0, 0.2, 1.0)], "alpha double, d2_reference double, cfar_reference double, sam_reference double, fusion_threshold double")
    got = {r["k"]: (r["mask"], r["score"]) for r in H.decide(sc, th).collect()}
    assert [got[i][0] for i in range(5)] == [True, True, False, False, False]
    assert all((got[i][1] > 1) == got[i][0] for i in (0, 1, 2, 4)) and got[3][1] is None


def test_thresholds_match_numpy(spark):
    rng = np.random.default_rng(42)
    d2, cf, sam = rng.gamma(3, 1, 6000), rng.gamma(2, 0.5, 6000), rng.beta(2, 12, 6000)
    df = spark.createDataFrame(list(zip(d2.tolist(), cf.tolist(), sam.tolist(), strict=True)), "d2 double, cfar double, sam double")
    got = H.null_thresholds(df, [0.01, 0.0005]).orderBy(F.desc("alpha")).collect()
    for row, alpha in zip(got, (0.01, 0.0005), strict=True):
        trim = min(0.001, alpha / 2)
        keep = d2 <= np.quantile(d2, 1 - trim)
        refs = [np.quantile(x[keep], 0.95) for x in (d2, cf, sam)]
        joint = np.minimum(d2[keep] / (refs[0] + 1e-12), np.maximum(cf[keep] / (refs[1] + 1e-12), sam[keep] / (refs[2] + 1e-12)))
        assert row["null_count"] == keep.sum()
        assert np.allclose([row["d2_reference"], row["cfar_reference"], row["sam_reference"], row["fusion_threshold"]], [*refs, np.quantile(joint, 1 - alpha)])


@pytest.mark.parametrize("options", [{"alphas": [0.6]}, {"alphas": [0.01], "trim": 0.02}, {"alphas": [0.01], "q": 0.4}])
def test_threshold_domains(spark, options):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "d2 double, cfar double, sam double")
    with pytest.raises(ValueError):
        H.null_thresholds(df, options.pop("alphas"), **options)


def test_too_few_samples(spark):
    with pytest.raises(ValueError, match="1000"):
        H.null_thresholds(spark.createDataFrame([(1.0, 1.0, 1.0)], "d2 double, cfar double, sam double"))


def test_log_variance_and_golden_metrics(spark):
    row = spark.range(1).select(S.log_variance_to_std(F.lit(0.0)).alias("a"), S.log_variance_to_std(F.lit(2.0)).alias("b")).first()
    assert row["a"] == 1 and row["b"] == pytest.approx(np.e)
    cells = [(1, 1)] * 46 + [(1, 0)] * 24 + [(0, 1)] * 2 + [(0, 0)] * 130
    m = E.confusion_metrics(spark.createDataFrame(cells, "t int, p int"), F.col("t"), F.col("p")).first()
    got = [round(m[k], 5) for k in ("accuracy", "recall", "precision", "false_alarm", "f1", "specificity")]
    assert got == [0.87129, 0.65714, 0.95833, 0.01515, 0.77966, 0.98485]


def test_masks_with_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 0.0, -0.0, 1.0001, nan, inf, -inf, None)], "x double")
    got = [tuple(r) for r in df.select(masks.range_mask(F.col("x")), masks.range_mask_zero(F.col("x")), masks.valid_observation([F.col("x")]), masks.clean(F.col("x")).isNull(), masks.nodata([F.col("x")])).collect()]
    assert [g[0] for g in got] == [0.5, 1.0] + [None] * 7
    assert [g[1] for g in got] == [0.5, 1.0] + [0.0] * 7
    assert [g[2] for g in got] == [True, True] + [False] * 7
    assert [g[3] for g in got] == [False] * 5 + [True] * 4
    assert [g[4] for g in got] == [False, False, True, True] + [False] * 5


def test_band_selection_is_checked():
    with pytest.raises(ValueError, match="source_band_indices"):
        masks.select_bands(F.array(), [1, 1])


def test_date_spellings(spark):
    names = ["S2_2022-07-13_1030.tif", "x2022-07-13.tif", "N36E113_20240102.tif", "a20240102b", "_20229913.", "none.tif", "1899123120"]
    got = [str(r[0]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(dates.acquisition_date(F.col("n"))).collect()]
    assert got == ["2022-07-13", "2022-07-13", "2024-01-02", "2024-01-02", "None", "None", "None"]
    with pytest.raises(Exception, match="2022-99-13|CANNOT_PARSE"):
        spark.createDataFrame([("2022-99-13_",)], "n string").select(dates.acquisition_date(F.col("n"))).collect()


def slow_bins(days, width):
    out, start = [], days[0]
    for d in days:
        if d >= start + width:
            start = d
        out.append(start)
    return out


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_greedy_bins(spark, width):
    days = sorted(set(np.random.default_rng(width).integers(0, 200, 40).tolist()))
    df = spark.createDataFrame([(d,) for d in days], "d int").select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"))
    got = [r for r in C.greedy_bins(df, width).orderBy("day").collect()]
    starts = slow_bins(days, width)
    assert [(r["bin_start"] - got[0]["day"]).days + days[0] for r in got] == starts
    assert all((r["bin_date"].date() == r["bin_start"]) for r in got if r["bin_start"] == got[-1]["bin_start"])


def slow_labels(cells, eight):
    cells, seen, out = set(cells), {}, []
    for start in sorted(cells):
        if start in seen:
            continue
        stack, seen[start] = [start], start
        while stack:
            r, c = stack.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    q = (r + dr, c + dc)
                    if q in cells and q not in seen and (eight or dr == 0 or dc == 0):
                        seen[q] = start
                        stack.append(q)
    return seen


@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=40), st.booleans())
@settings(max_examples=60, deadline=None)
def test_labels(cells, eight):
    rows = list(cells)
    lab = R.label(np.array([r for r, _ in rows]), np.array([c for _, c in rows]), eight)
    want, first = slow_labels(cells, eight), sorted(cells)
    assert [first[x] for x in lab] == [want[c] for c in rows]


@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_outline_encloses_the_cells(cells):
    rings = R.outline(np.array([r for r, _ in cells]), np.array([c for _, c in cells]))
    area = sum(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False)) for r in rings) / 2
    assert abs(area) == len(cells) and all(r[0] == r[-1] for r in rings)


def slow_closing(m):
    h, w = m.shape
    p = np.pad(np.pad(m, 1, mode="edge"), 1)
    d = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    q = np.pad(d, 1)
    e = q[1:-1, 1:-1] & q[:-2, 1:-1] & q[2:, 1:-1] & q[1:-1, :-2] & q[1:-1, 2:]
    return e[1:-1, 1:-1]


def test_closing_and_small_regions(spark):
    m = np.random.default_rng(9).random((9, 8)) > 0.45
    df = spark.createDataFrame([(0, r, c, bool(m[r, c])) for r in range(9) for c in range(8)], "frame_id int, row int, col int, mask boolean")
    got = {(r["row"], r["col"]) for r in R.closed(df, 9, 8).collect()}
    assert got == {tuple(x) for x in np.argwhere(slow_closing(m)).tolist()}
    sizes = {}
    for c, s in (lab := slow_labels([tuple(x) for x in np.argwhere(m).tolist()], True)).items():
        sizes[s] = sizes.get(s, 0) + 1
    assert {(r["row"], r["col"]) for r in R.drop_small(df, 4).collect()} == {c for c, s in lab.items() if sizes[s] >= 4}


def test_components_of_19_20_and_diagonal(spark):
    cells = [(0, c) for c in range(19)] + [(2 + i, i) for i in range(20)]
    df = spark.createDataFrame([(0, r, c, True) for r, c in cells], "frame_id int, row int, col int, mask boolean")
    assert {(r["row"], r["col"]) for r in R.drop_small(df).collect()} == set(cells[19:])


def slow_weighted(v, w, q):
    keep = np.isfinite(v) & (w > 0)
    v, w = v[keep], w[keep]
    o = np.argsort(v)
    c = (np.cumsum(w[o]) - 0.5 * w[o]) / w.sum()
    return np.interp(q, c, v[o])


@pytest.mark.parametrize("q", [0.0001, 0.3, 0.5, 0.9, 0.9999])
def test_weighted_quantile(spark, q):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=60), rng.integers(0, 4, 60).astype(float)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(v, w, strict=True)], "g string, v double, w double")
    assert H.weighted_quantile(df, q, "v", "w", ["g"]).first()["quantile"] == pytest.approx(slow_weighted(v, w, q))


def test_alignment(spark):
    base = [2.0, 0.0, 1.0, 0.0, -2.0, 5.0]
    schema = "acq_date string, height int, width int, crs string, transform array<double>"
    fine = spark.createDataFrame([("d", 3, 4, "x", base), ("d", 3, 4, "x", [b + 1e-12 for b in base])], schema)
    assert C.aligned_or_fail(fine).count() == 2
    with pytest.raises(Exception, match="not aligned"):
        C.aligned_or_fail(spark.createDataFrame([("d", 3, 4, "x", base), ("d", 3, 5, "x", base)], schema)).collect()


def test_sample_is_capped_and_repeatable(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("acq_date"), "id").withColumnRenamed("id", "pixel_id")
    a, b = (sorted(map(tuple, H.sample_per_frame(df.repartition(n), 7).collect())) for n in (1, 5))
    assert a == b and len(a) == 14
    assert H.sample_per_frame(df, 1000).count() == 100


def test_planning(spark):
    import base64

    from pixeltide.functions import planning

    assert planning.capacity_end("2020-01-01", 32, 2, 2.0) == "2020-03-05"
    advice = planning.grid_advice(279, 279, 107)
    assert (advice["spatial_log2"], advice["temporal_log2"], advice["hidden"]) == (19, 16, 64)
    assert planning.grid_advice(5000, 5000, 10, memory_gb=8)["spatial_log2"] == 19
    bits = np.random.default_rng(0).integers(0, 2, 45)
    packed = base64.b64encode(np.packbits(bits).tobytes()).decode()
    got = spark.range(45).select(planning.packed_bit(F.lit(packed), F.col("id")).alias("b")).collect()
    assert [int(r["b"]) for r in got] == bits.tolist()


def test_fixed_support(spark):
    sc = spark.createDataFrame([(p, d, p % 2 == 0) for p in range(20) for d in (1, 2)], "pixel_id int, acq_date int, valid boolean")
    support = sc.select("pixel_id", "acq_date", (F.col("pixel_id") < 10).alias("support"))
    got = H.fixed_support_sample(sc, support, 3).collect()
    assert len(got) == 6 and all(r["pixel_id"] < 10 and r["pixel_id"] % 2 == 0 for r in got)
    with pytest.raises(Exception, match="without support"):
        H.fixed_support_sample(sc, support.where("acq_date = 1")).collect()


def test_correction_needs_coverage(spark):
    from pixeltide.operators import baseline as B

    base = spark.createDataFrame([(1, 0.4, 0.1), (2, 0.5, 0.1)], "pixel_id int, r_mean double, r_std double")
    coef = [[0.01]] + [[0.0]] * 6
    one = spark.createDataFrame([(1, coef, [0.02])], "pixel_id int, coef array<array<double>>, scale array<double>")
    row = B.corrected(base.where("pixel_id = 1"), one, ["r"], F.lit(10)).first()
    assert (row["r_mean"], row["r_std"]) == (pytest.approx(0.41), 0.02)
    with pytest.raises(Exception, match="without correction"):
        B.corrected(base, one, ["r"], F.lit(10)).collect()
