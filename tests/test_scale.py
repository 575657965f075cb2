"""Results by brute force and shapes of plans, for queries that once failed on larger tables."""

import random

from pyspark.sql import functions as F

from cadenza.operators import dedupe
from cadenza.plans import duplicates


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_linkage_shuffles_rows_once(spark):
    from support import DATA

    plan = plan_of(duplicates.band_link(spark, DATA))
    assert plan.count("Exchange ") == 1 and "sequence(-840" not in plan


def linked(files, rides, minutes, step):
    times = [(u, t) for u, _, t in files]
    hits = {}
    for i, (u, r, t) in enumerate(rides):
        hits[i] = [(u, t + o) for o in range(-minutes, minutes + 1, step) if (u, t + o) in set(times)]
    count = {}
    for i, (u, r, _) in enumerate(rides):
        count[u, r] = count.get((u, r), 0) + len(hits[i])
    out = []
    for u, f, t in files:
        near = [(count[u, rides[i][1]], rides[i]) for i, h in hits.items() if (u, t) in h]
        single = [ride for n, ride in near if n == 1]
        status = ("duplicate_csv_timestamp" if times.count((u, t)) > 1 else "ambiguous_timestamp_match" if len(single) < len(near)
                  else "linked" if len(single) == 1 else "duplicate_metadata_match" if single else "unmatched_timestamp")
        out.append((u, f, status, *((single[0][1], t - single[0][2]) if status == "linked" else (None, None))))
    return sorted(out, key=str)


def test_linkage_matches_brute_force(spark):
    """Repeated files and rides, times off the grid, before 1970, and at the ends of the range of offsets."""
    draw = random.Random(3)
    seen = set()
    for minutes, step, most in ((840, 15, 20_000), (50, 15, 600), (30, 7, 1500), (0, 15, 300)):
        at = lambda: draw.randrange(-most, most) // 15 * 15 + draw.choice([0, 0, 0, 1])  # noqa: B023, E731
        files = [(draw.randrange(3), i, at()) for i in range(80)] + [(5, 900, 0), (5, 901, 2 * minutes)]
        rides = [(draw.randrange(4), f"r{draw.randrange(60)}", at()) for i in range(60)] + [(5, "end", minutes)]
        moment = lambda c: F.timestamp_micros(F.col(c) * 60_000_000).alias(c)
        f = spark.createDataFrame(files, "u long, f long, t long").select("u", "f", moment("t"))
        r = spark.createDataFrame(rides, "u long, r string, t long").select("u", "r", moment("t"))
        got = dedupe.linked_by_offset(f, r, "u", "f", "t", "r", "t", minutes, step)
        assert got.columns == ["u", "f", "status", "r", "offset"]
        want = linked(files, rides, minutes, step)
        assert sorted(map(tuple, got.collect()), key=str) == want
        seen |= {x[2] for x in want}
    assert len(seen) == 5
    null = spark.createDataFrame([(1, 1, None), (None, 2, 0)], "u long, f long, t long").select("u", "f", F.timestamp_micros("t").alias("t"))
    got = dedupe.linked_by_offset(null, r, "u", "f", "t", "r", "t")
    assert sorted(got.select("f", "status").collect()) == [(1, "unparsable_csv_timestamp"), (2, "unmatched_timestamp")]


def test_pairs_meet_their_signals_once(spark):
    from support import DATA

    plan = plan_of(duplicates.pair_verify(spark, DATA))
    assert plan.count("Join ") <= 3 and "zip_with(" not in plan and "aggregate(" not in plan


def test_agreements_by_hand(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    rows = []
    for i in range(1300):  # more than are compared at once
        x = draw.normal(size=(12, 9)[i % 3 == 0])
        y = x + draw.normal(size=len(x)) * 0.1
        rows.append((i, x.tolist(), y.tolist()))
    rows[5], rows[6], rows[7], rows[8] = (5, None, [1.0]), (6, [1.0, None], [1.0, 2.0]), (7, [0.1] * 12, [0.3] * 12), (8, [], [])
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>")
    got = {r.k: r for r in dedupe.agreements(df, [("a", "b", "", False), ("b", "a", "z_", True)], 10).collect()}
    assert len(got) == 1300 and list(got[0].asDict()) == ["k", "mae", "p95", "r", "z_mae", "z_p95", "z_r"]
    at = lambda v: np.interp(np.linspace(0, len(v) - 1, 10), np.arange(len(v)), v)
    for k, a, b in rows:
        if k in (5, 6, 8):
            assert got[k].mae is got[k].p95 is got[k].r is None
            continue
        a, b = at(a), at(b)
        assert np.allclose(got[k].mae, abs(a - b).mean()) and np.allclose(got[k].p95, np.quantile(abs(a - b), 0.95))
        assert np.allclose(got[k].z_mae, abs(a - np.median(a) - b + np.median(b)).mean())
        assert got[k].r is None if k == 7 else np.allclose(got[k].r, np.corrcoef(a, b)[0, 1])
    few = dedupe.agreements(df, [("a", "b", "", False)], 10, {"mae": 0.08, "p95": 0.2, "r": 0.99}, keep_signals=True).collect()
    assert {r.k for r in few} == {k for k, r in got.items() if r.mae is not None and r.r is not None and r.mae <= 0.08 and r.p95 <= 0.2 and r.r >= 0.99} and few[0].a == rows[few[0].k][1]


def test_verification_with_and_without_support(spark):
    flat, a = [1.0] * 8, [float(x) for x in (1, 5, 2, 8, 3, 9, 4, 7)]
    near, far = [x + 0.1 for x in a], [20 - x for x in a]
    rows = [(0, a, near, a, near, None, None), (1, a, near, None, None, a, [x + 50 for x in a]), (2, a, near, None, None, None, None), (3, a, near, flat, flat, a, far),
            (4, a, far, a, a, a, a), (5, flat, flat, a, a, a, a), (6, None, a, a, a, a, a)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} array<double>" for c in ("a", "b", "sa", "sb", "ta", "tb")))
    got = {r.k: r.status for r in dedupe.verified(df, duplicates.LIMITS).collect()}
    assert [got[k][:19] for k in range(7)] == ["near_candidate_hr_p"] * 2 + ["near_candidate_hr_o"] * 2 + ["screened_out_after_"] * 3


def test_hash_is_that_of_spark(spark):
    import numpy as np

    from cadenza.functions.hashing import xxhash64_chain

    rows = [(i, v, None if i % 5 == 0 else -v) for i, v in enumerate([0, 1, -1, 7, 2**31, -(2**31), 2**62 + 3, -(2**63) + 1, 123456789012, 42])]
    df = spark.createDataFrame(rows, "a int, b long, c long")
    want = [r[0] for r in df.orderBy("a").select(F.xxhash64("a", "c", "b")).collect()]
    some = np.ones(10, bool)
    a, b, c = (np.array([r[i] or 0 for r in rows], dtype=np.int64) for i in range(3))
    assert xxhash64_chain([(a, False, some), (c, True, np.array([r[2] is not None for r in rows])), (b, True, some)]).tolist() == want


def test_thresholds_and_coverage_by_replicate(spark, monkeypatch):
    """As by rows repeated for every replicate, in blocks of replicates, with null keys and scores."""
    from cadenza.operators import inference
    from cadenza.operators.hierarchy import running

    monkeypatch.setattr(inference, "CELLS", 500)
    draw = random.Random(6)
    rows = [(g, draw.randrange(90), draw.choice([None, 1, 2, 3, 4]), i, draw.choice([None, *[round(draw.random(), 2) for _ in range(9)]])) for g in (1, 2) for i in range(700)]
    df = spark.createDataFrame([*rows, (1, None, 1, 0, 0.5)], "g int, u long, s long, r int, x double")
    got = inference.sampled_thresholds(df, ["g"], "u", "s", "r", "x", 0.9, 30)
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(29))))
    pick = lambda *c: F.xxhash64("replicate", *c)
    users = each.groupBy("g", "replicate", "u", "s").agg(F.min_by("x", pick("r", "s")).alias("x")).groupBy("g", "replicate", "u").agg(F.min_by("x", pick("s", "u")).alias("x"))
    reached = running(users.withColumn("w", inference.replicate_weight(F.col("u"), F.col("replicate"))).where("w > 0"), ["g", "replicate"], "x", F.sum("w"))
    rank = F.least(F.col("total"), F.ceil((F.col("total") + 1) * 0.9))
    want = reached.where(F.col("before") + F.col("w") >= rank).groupBy("g", "replicate").agg(F.greatest(F.lit(0.0), F.min("x")).alias("threshold"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 60

    t = got.where("g = 1").select("replicate", "threshold")
    cover = {r.replicate: r.picp for r in inference.covered_by_replicate(df, "u", "s", "x", t, 7).collect()}
    inside = each.where("x is not null").join(t, "replicate").groupBy("replicate", "u", "s").agg(F.avg((F.col("x") <= F.col("threshold")).cast("double")).alias("c")).groupBy("replicate", "u").agg(
        F.avg("c").alias("c")).withColumn("w", inference.replicate_weight(F.col("u"), F.col("replicate"), 7))
    expected = {r.replicate: r.p for r in inside.groupBy("replicate").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("p")).collect()}
    assert cover.keys() == expected.keys() and all(abs(cover[k] - expected[k]) < 1e-12 for k in cover)


def test_replicates_are_drawn_where_users_lie(spark):
    from support import DATA

    from cadenza.plans import extended

    plan = plan_of(extended.replicate_matched(spark, DATA))
    assert "explode(" not in plan and plan.count("MapInArrow") >= 2


def test_bootstrap_draws_are_numpys_whatever_is_held(spark, monkeypatch):
    import zlib

    import numpy as np

    from cadenza.operators import inference

    draw = np.random.default_rng(8)
    x = draw.normal(size=(300, 2))
    df = spark.createDataFrame([("N", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "g string, u long, a double, b double")
    rng = np.random.default_rng((20260722 + zlib.crc32(b"N")) % 2**32)
    low, high = np.quantile(x[rng.integers(0, 300, size=(250, 300))].mean(axis=1), [0.025, 0.975], axis=0)
    got = inference.bootstrap(df, ["g"], ["a", "b"], "u", 250).orderBy("metric").collect()
    assert np.allclose([(r.estimate, r.low, r.high) for r in got], np.stack([x.mean(axis=0), low, high], axis=1), rtol=0, atol=1e-12)
    many = max(d.size for d in inference._stream(1, 400_000, 5, 1000))
    assert many <= inference.DRAWS
