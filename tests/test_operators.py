"""Small fixtures with known answers, nulls, ties and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import numeric, text
from cadenza.functions.hashing import stable_fraction
from cadenza.operators import audit, dedupe, hierarchy, history, inference, intervals, origins, profiles, series, splits
from cadenza.sources import readers, writers
from cadenza.streaming.last_value import windowed_last


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_last_in_bin(spark):
    df = spark.createDataFrame([(1, 1.0, 100.0), (1, 9.0, 101.0), (1, 10.0, 102.0), (1, 11.0, 103.0)], "s int, t double, v double")
    got = {r.bin: r.value for r in series.last_in_bin(df, ["s"], "t", "v", 10.0).collect()}
    assert got == {1: 102.0, 2: 103.0}


def test_context_bin(spark):
    f = lambda t: one(spark, numeric.context_bin(F.lit(float(t)), F.lit(100.0), 300.0, 10.0))
    assert [f(t) for t in (100, 101, 110, 110.1, 400)] == [None, 0, 0, 1, 29]


def test_interpolation(spark):
    def at(points, t):
        sig = spark.createDataFrame([(1, float(a), float(b)) for a, b in points], "s int, t double, v double")
        probe = spark.createDataFrame([(1, float(t))], "s int, t double")
        r = series.interpolated(series.bracketed(sig, probe, ["s"], "t", "v"), "t", 30.0, 30.0, 240.0).first()
        return r.interpolated, r.span

    assert at([(0, 100), (20, 120)], 10) == (110.0, 20.0)
    assert at([(0, 100), (40, 120)], 10) == (None, None)
    assert at([(0, 100), (20, 120)], 20) == (120.0, 0.0)
    assert at([(0, 100), (20, 400)], 10) == (None, None)


def regular(spark, n=101):
    return spark.createDataFrame([(1, i, 10.0 * i, 100 + 0.1 * i) for i in range(n)], "s int, i int, t double, v double")


def test_origins_of_regular_signal(spark):
    rows = origins.origins(regular(spark), ["s"], "t", "v", "i", origins.TimeProfile()).collect()
    assert len(rows) == 7 and all(r.reason is None and r.bins == 30 for r in rows)
    first = min(rows, key=lambda r: r.origin)
    assert first.origin == 300.0 and first.evaluation and math.isclose(first.target_1, 103.6)


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        ([(1, 0, 0.0, 100.0)], "invalid_or_unaligned_arrays"),
        ([(1, 0, 0.0, 100.0), (1, 1, 0.0, 101.0)], "non_monotonic_timestamps"),
        ([(1, 0, 0.0, 100.0), (1, 1, 5.0, 500.0), (1, 2, 9.0, float("nan"))], "insufficient_valid_hr"),
        ([(1, 0, 0.0, 100.0), (1, 1, 5.0, 101.0)], "session_too_short_after_alignment"),
    ],
)
def test_session_reasons(spark, rows, reason):
    df = spark.createDataFrame(rows, "s int, i int, t double, v double")
    assert origins.session_reasons(df, ["s"], "t", "v", "i", origins.TimeProfile()).first().reason == reason


def test_empty_context_is_first_reason(spark):
    pts = [(1, i, 10.0 * i, 100.0) for i in range(3)] + [(1, 3, 2000.0, 100.0)]
    df = spark.createDataFrame(pts, "s int, i int, t double, v double")
    got = {r.origin: r.reason for r in origins.origins(df, ["s"], "t", "v", "i", origins.TimeProfile()).collect()}
    assert got[300.0] == "context_bin_coverage" and got[600.0] == "empty_context"


def test_profile_guards_against_brackets_before_the_origin():
    with pytest.raises(ValueError):
        origins.TimeProfile(horizons=(20.0,), max_span=30.0)


def test_ewma_and_trend(spark):
    assert one(spark, origins.ewma(F.array(F.lit(100.0), F.lit(140.0)), 0.25, 30, 240)) == 110.0
    p = origins.TimeProfile(horizons=(40.0, 180.0))
    ctx = spark.createDataFrame([(1, 0.0, 27, 100.0), (1, 0.0, 28, 110.0), (1, 0.0, 29, 120.0), (2, 0.0, 29, 90.0)], "s int, origin double, pos int, value double")
    got = {(r.s, r.horizon): r.trend for r in origins.forecasts(ctx, ["s"], p, 0.25).collect()}
    assert got == {(1, 40.0): 160.0, (1, 180.0): 240.0, (2, 40.0): 90.0, (2, 180.0): 90.0}


def test_distance_speed(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 0.1), (1, 20.0, 0.2), (1, 30.0, 0.1)], "s int, t double, km double")
    got = [r.speed for r in series.distance_speed(df, ["s"], "t", "km").orderBy("t").collect()]
    assert got[0] is None and [round(x, 9) for x in got[1:3]] == [36.0, 36.0] and got[3] is None


def test_strict_temporal(spark):
    df = spark.createDataFrame([(1, 0, 100, "train"), (1, 100, 200, "validation"), (1, 300, 400, "calibration")], "u int, a int, b int, partition string")
    got = [r.strict for r in splits.strict_temporal(df, "u", "a", "b").orderBy("a").collect()]
    assert got == ["excluded", "excluded", "calibration"]


def test_history_counts_completed_sessions_only(spark):
    rows = [(1, 1, "x", 0, 100, 1.0), (1, 2, "x", 50, 60, 3.0), (1, 3, "y", 100, 110, 5.0), (1, 4, "x", 100, 100, 7.0), (1, 5, "x", 101, 102, 9.0)]
    df = spark.createDataFrame(rows, "u int, k int, f string, a int, b int, v double")
    h = history.causal_history(df, "u", "k", "f", "a", "b", "v", "v", "v", "v", day=1.0)
    got = {r.k: r for r in h.collect()}
    assert [got[k].prior_count for k in (1, 2, 3, 4, 5)] == [0, 0, 2, 2, 3]
    assert got[3].value_mean == 2.0 and got[3].same_value_mean == 0.0 and not got[1].mask
    assert got[5].log_days_since == pytest.approx(math.log1p(1))


def test_temporal_split_uses_double_floor(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(90)], "u int, a int, k int")
    got = splits.temporal_split(df, "u", "a", "k").groupBy("partition").count().collect()
    assert {r["partition"]: r["count"] for r in got} == {"train": 62, "validation": 10, "calibration": 9, "test": 9}


def test_fraction_is_in_unit_interval(spark):
    x = spark.range(200).select(stable_fraction("ns", F.col("id")).alias("f")).agg(F.min("f").alias("a"), F.max("f").alias("b")).first()
    assert 0 <= x.a < 0.1 and 0.9 < x.b < 1


def test_point_metrics_weight_users_equally(spark):
    rows = [(1, 1, 0.0, 1.0)] * 9 + [(2, 2, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "user_key int, session_key int, target double, prediction double")
    r = hierarchy.point_metrics(df, []).first()
    assert (r.mae, r.users, r.sessions, r.origins) == (2.0, 2, 2, 10)
    w = hierarchy.origin_weights(df, []).agg(F.sum(F.col("weight") * F.col("n_origins")).alias("w")).first().w
    assert math.isclose(w, 1.0)


def test_quantile_rules_differ_by_one_order_statistic(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "g string, x double")
    assert intervals.split_conformal_radius(df, ["g"], F.col("x"), 0.9).first().radius == 19.0
    assert intervals.cqr_threshold(df, ["g"], F.col("x"), 0.9).first().threshold == 20.0
    assert intervals.cqr_threshold(df.withColumn("x", -F.col("x")), ["g"], F.col("x"), 0.9).first().threshold == 0.0
    assert hierarchy.weighted_quantile_higher(df.withColumn("w", F.lit(1.0)), ["g"], "x", "w", 0.5).first().quantile == 10.0


def test_wis_of_perfect_forecast_is_width_only(spark):
    y = F.lit(10.0)
    assert one(spark, intervals.weighted_interval_score(y, y, [(0.1, y - 1, y + 1)])) == pytest.approx((0.05 * 2) / 1.5)
    assert one(spark, intervals.pinball(F.lit(3.0), [(0.5, F.lit(1.0))])) == 1.0


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "g string, k int, p double")
    got = [round(r.adjusted, 9) for r in inference.holm(df, ["g"], "p", "k").orderBy("p").collect()]
    assert got == [0.03, 0.06, 0.06]


def test_wilcoxon_with_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, -1.0, 2.0, 3.0, 0.0)], "g string, d double")
    r = inference.wilcoxon(df, ["g"], "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (4, 8.5, 1.5)
    assert one(spark, inference.normal_p(F.lit(1.959963985))) == pytest.approx(0.05, abs=1e-6)


def test_resolution_policy(spark):
    rows = [(1, "a", "x", "f"), (2, "a", "y", "f"), (3, "b", "x", "f"), (4, "b", "x", "g"), (5, "c", "x", "f"), (6, "c", "x", "f"), (7, "d", "x", "f")]
    df = spark.createDataFrame(rows, "k int, text string, u string, f string")
    got = {r.k: r.action for r in dedupe.resolved(dedupe.exact_groups(df, "k", dedupe.fingerprint(F.col("text"))), "k", "u", "f").collect()}
    assert got == {1: "exclude", 2: "exclude", 3: "exclude", 4: "exclude", 5: "keep_canonical", 6: "exclude"}


def test_even_sample(spark):
    got = [r.id for r in dedupe.even_rows(spark.range(10), "id", 3).orderBy("id").collect()]
    assert got == [1, 5, 8]


def test_keyword_families(spark):
    cases = {"Trail Run": "running", "Indoor bike": "indoor_virtual_cycling", "Natación": "swimming", "tt": "outdoor_cycling", "<missing>": "other_unknown",
             "": "other_unknown", "chess": "other_unknown", None: "other_unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    assert {r.label: r.f for r in df.select("label", text.keyword_family(F.col("label")).alias("f")).collect()} == cases


def test_session_lines(spark):
    line = "{'userId': 7, 'sport': 'bike', 'timestamp': [1, 2, 3], 'heart_rate': [90, None, nan, 95.5, ]}"
    r = readers.session_lines(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert (r[0].user_id, r[0].sport, r[0].gender, r[0].timestamp, r[0].heart_rate, r[0].aligned) == ("7", "bike", "<missing>", [1.0, 2.0, 3.0], [90.0, 95.5], False)
    assert r[1].user_id == "<missing>" and not r[1].aligned


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("secs,hr\n1,90\n2,x\n3,inf\n")
    rows = readers.read_session_csv(spark, str(tmp_path / "a.csv"), ("secs", "hr")).orderBy("secs").collect()
    assert [(r.secs, r.hr) for r in rows] == [(1.0, 90.0), (2.0, None), (3.0, None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('{"ATHLETE": {"gender": "F"}, "RIDES": [{"date": "d", "sport": "run"}, {"date": "e"}]}')
    (tmp_path / "j/y.json").write_text("{broken")
    got = sorted((r.status, r.ride_index, r.sport) for r in readers.read_rides(spark, str(tmp_path / "j")).collect() if r.status == "ok")
    assert got == [("ok", 0, "run"), ("ok", 1, None)]
    assert readers.read_tree(spark, str(tmp_path / "j")).count() == 2
    out = str(tmp_path / "t")
    for _ in range(2):
        writers.append_unprocessed(spark, spark.range(3), out, ["id"])
    assert spark.read.parquet(out).count() == 3
    writers.write_table(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first().x is None


def test_profiles_and_draws(spark):
    assert one(spark, profiles.resampled(F.array(*[F.lit(float(x)) for x in (0, 10, 20)]), 5)) == [0.0, 5.0, 10.0, 15.0, 20.0]
    assert one(spark, profiles.resampled(F.array(F.lit(3.0)), 2)) == [3.0, 3.0]
    bins = spark.createDataFrame([(1, b, float(b % 3)) for b in (1, 2, 3, 9)], "s int, bin long, value double")
    assert profiles.eligibility(bins, ["s"], 5, 0.4, 2, 0.1).first().reason == "missing_run"
    rows = spark.createDataFrame([(u, s, r) for u in range(3) for s in range(2) for r in range(4)], "u int, s int, r int")
    got = inference.cluster_subsample(rows, "u", "s", "r", 7)
    assert got.count() == 3 == got.select("u").distinct().count()


def test_audits(spark):
    df = spark.createDataFrame([(1, 5), (1, 50), (2, None)], "k int, users int")
    assert audit.duplicate_keys(df, ["k"]).first().rows == 2
    assert audit.failures(df, big=F.col("users") > 10).first().big == 2
    assert audit.small_groups(df, ["users"], 10).count() == 1
    assert audit.unprocessed(df, df.where("k = 1"), ["k"]).count() == 1


def test_empty_tables(spark):
    empty = regular(spark, 0)
    p = origins.TimeProfile()
    assert origins.origins(empty, ["s"], "t", "v", "i", p).count() == 0
    assert series.gap_statistics(empty, ["s"], "t", "i", 60.0).count() == 0
    ev = spark.createDataFrame([], "user_key int, session_key int, target double, prediction double")
    assert hierarchy.point_metrics(ev, ["user_key"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, f"2026-01-01 {h:02d}:00:00", float(h), h) for u in (1, 2) for h in range(24)]
    df = spark.createDataFrame(rows, "u int, ts string, v double, i int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    batch = windowed_last(df, ["u"], "ts", "v", "i", "6 hours", "1 hour")
    stream = windowed_last(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["u"], "ts", "v", "i", "6 hours", "1 hour")
    q = stream.writeStream.format("memory").queryName("last_value").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.u, r.start)
    assert sorted(map(tuple, spark.table("last_value").collect())) == sorted(map(tuple, batch.collect()))
    assert key(batch.orderBy("u", "start").first())[0] == 1


def test_spearman_with_a_constant_side(spark):
    """A user whose values don't vary, or vary on one side only, has no correlation and doesn't fail the rest."""
    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 5.0), (2, 2.0, 6.0), (2, 3.0, 9.0), (3, 1.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 2.0), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "user_key int, x double, y double").withColumn("r", F.lit("a"))
    (got,) = hierarchy.mean_user_spearman(df, ["r"], "x", "y").collect()
    assert (got.users, round(got.spearman, 9)) == (1, 1.0)


def test_running_sums_and_quantiles(spark, monkeypatch):
    """Two levels give what one window would, with ties, nulls, skew and an empty table."""
    import numpy as np

    monkeypatch.setattr(hierarchy, "STRETCHES", 8)
    monkeypatch.setattr(hierarchy, "SAMPLED", 16)
    rng = np.random.default_rng(3)
    x = [*np.round(rng.lognormal(0, 3, 700), 2).tolist(), *[5.0] * 200, None]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", 1.0)], "g string, v double").repartition(5)
    known = np.sort([v for v in x if v is not None])
    for r in hierarchy.running(df.where("g = 'a'"), [], "v").collect():
        assert (r.before, r.w, r.total) == (int((known < r.v).sum()), int((known == r.v).sum()), len(known))
    got = {r.g: r for r in hierarchy.quantiles(df, ["g"], "v", {"low": 0.0, "q": 0.37, "p95": 0.95}).collect()}
    assert np.allclose([got["a"].low, got["a"].q, got["a"].p95], np.quantile(known, [0, 0.37, 0.95]))
    assert (got["b"].n, got["b"].low, got["b"].q) == (1, 1.0, 1.0)
    assert hierarchy.quantiles(df.where("false"), ["g"], "v", {"q": 0.5}).count() == 0


def test_privacy_rules_on_names_and_paths(spark):
    """Names are normalised first; the patterns find drive, share, home and mount paths and file addresses."""
    from cadenza.operators import audit

    names = {"User_ID": True, "\ufeffTimestamp": True, "session key": True, "my-activity-id": True, "Origin Time": True, "users": False, "mean": False, "": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.private for r in audit.private_columns(df, "n").collect()} == names
    paths = {"C:/data/x": "windows_path", "see d:\\a": "windows_path", "\\\\srv\\x\\y": "unc_path", "/mnt/a/b": "posix_home", "x /home/me/f": "posix_home",
             "FILE://a": "file_uri", "abC:/x": "", "/home/me": "", "a/home/me/f": "", "profile://x": "", None: None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.f for r in df.select("p", F.when(F.col("p").isNotNull(), F.array_join(text.private_paths(F.col("p")), ",")).alias("f")).collect()} == paths


def test_plain_text_is_full_decomposition(spark):
    values = {"Ště ﬁ ő ą": "ste fi o a", "ASCII Only": "ascii only", "Ａ①ǆ": "a1dz", "": "", None: None, "e\u0301": "e"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.p for r in df.select("v", text.plain_text(F.col("v")).alias("p")).collect()} == values


def test_poisson_draws_are_fair(spark):
    """Weights have mean and variance 1 and the interval is that of the normal approximation."""
    import numpy as np

    x = np.random.default_rng(1).gamma(2.0, 3.0, 400)
    df = spark.createDataFrame([(i + 1, float(v), None if i % 7 == 0 else float(v)) for i, v in enumerate(x)], "u long, x double, y double")
    r = inference.poisson_bootstrap(df, [], ["x", "y"], "u", 4000).first()
    sd = x.std() / 20
    assert abs(r.x_low - (x.mean() - 1.96 * sd)) < 0.2 * sd and abs(r.x_high - (x.mean() + 1.96 * sd)) < 0.2 * sd
    assert r.y_low < r.y < r.y_high and r.users == 400
    w = df.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("r"), "u").select(inference.replicate_weight(F.col("u"), F.col("r")).alias("w"))
    m = w.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(m.m - 1) < 0.02 and abs(m.v - 1) < 0.03
    assert inference.poisson_bootstrap(df.where("false").withColumn("g", F.lit(1)), ["g"], ["x"], "u", 10).count() == 0


def test_signal_digests(spark):
    """Shifts of the clock change nothing, shifts in the grid only the exact digest; a changed bin changes it."""
    base = [None, 100.0, 110.0, None, *[float(100 + i % 40) for i in range(80)], None]
    rows = [(1, base, [1.0] * len(base)), (2, base, [1.0] * len(base)), (3, [None, *base], [1.0] * (len(base) + 1)), (4, [100.0 if v == 110.0 else v for v in base], [1.0] * len(base)),
            (5, [None] * 5, [None] * 5), (6, [], []), (7, None, None)]
    got = {r.k: r for r in dedupe.signal_digests(spark.createDataFrame(rows, "k long, hr array<double>, speed array<double>"), "k", 10, ["hr", "speed"]).collect()}
    assert got[1].exact == got[2].exact != got[3].exact and got[1].trimmed == got[3].trimmed and got[1].profiles == got[3].profiles
    assert got[4].trimmed != got[1].trimmed and 1 <= len(got[1].profiles) <= 6
    assert all(got[k].trimmed is None and got[k].profiles == [] for k in (5, 6, 7)) and got[6].exact == got[7].exact


def test_sign_signatures_like_numpy(spark):
    import numpy as np

    planes = dedupe.projections(6, 2, 3)
    rows = [(1, [1.0, 2.0, 3.0, 5.0, 8.0, 1.0]), (2, [2.0, 4.0, 6.0, 10.0, 16.0, 2.0]), (3, [1.0] * 6), (4, None), (5, [1.0])]
    got = {(r.k, r.table): r.signature for r in dedupe.signatures(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", planes, 3).collect()}
    z = np.array(rows[0][1])
    z = (z - z.mean()) / z.std()
    want = [sum(int(planes[3 * t + b] @ z >= 0) << b for b in range(3)) for t in range(2)]
    assert got == {(k, t): want[t] for k in (1, 2) for t in range(2)}


def test_feature_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffsecs, hr ,km,alt,x\n0,100,0.0,5\nbad,101,0.1,5\n2,-,0.2,nan\n\n3,104\n")
    got = [(r.secs, r.hr, r.alt, r.km) for r in readers.read_features_csv(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [(0.0, 100.0, 5.0, 0.0), (2.0, None, None, 0.2), (3.0, 104.0, None, None)]
    strict = readers.read_features_csv(spark, str(tmp_path), channels=("hr",), strict=True)
    assert [r.hr for r in strict.orderBy("row").collect()] == [100.0, 104.0]
    (tmp_path / "b.csv").write_text("secs,hr\n0,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        readers.read_features_csv(spark, str(tmp_path))


def test_release_and_job_rules(spark):
    paths = {"data/x.csv": "location", "docs/Private/a.md": "folder", "docs/a.NPY": "type", "docs/a.md": None, "src/b.py": "not_allowed", None: "not_allowed"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = audit.blocked_paths(df, "p", ["data/"], ["private"], [".npy"], [r"^docs/"])
    assert {r.p: r.blocked for r in got.collect()} == paths
    record = {"status": audit.FROZEN, "external_outcomes_used_for_selection": False, "artifacts": {"m": {"sha256": "1"}}}
    assert audit.freeze_errors(record, {"m": "1"}) == [] and audit.freeze_errors(record | {"status": "x"}, {"m": "2", "n": "1"}) == ["status", "m", "n"]
    assert audit.freeze_errors({}, {}) == ["status", "external_outcomes_used_for_selection"]
    assert audit.json_keys({"a": {"b": 1, "c": [{"d": 2}, 3]}, "e": None}) == ["a", "a.b", "a.c", "a.c.d", "e"]
    result = {"all_assertions_pass": True, "rows": 3, "counts": {"users": 0}}
    assert audit.postcondition_errors(result, ["rows", "counts.users"], ["rows"]) == [] and audit.postcondition_errors(result, ["x.y"], ["counts.users"]) == ["x.y", "counts.users"]
    assert audit.row_alignment([1, 2]) != audit.row_alignment([2, 1])
    a, b = (spark.createDataFrame(x, "k long, v double") for x in ([(1, 1.0), (2, 2.0), (2, 2.0)], [(2, 2.5), (3, 1.0)]))
    assert tuple(audit.one_to_one(a, b, ["k"]).first()) == (1, 0, 1, 1)
    assert {r.k: r.status for r in audit.against_golden(a.distinct(), b, ["k"], "v", 0.1).collect()} == {1: "unreported", 2: "differs", 3: "missing"}
