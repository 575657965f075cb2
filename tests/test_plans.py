"""Every registered query of the library against its SQL twin, on the smallest tables."""

import pytest
from support import DATA, same

from cadenza import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    same(QUERIES[name](spark, DATA), db, SQL[name])


def test_bootstrap_brackets_estimate(spark):
    for r in QUERIES["boot_numpy"](spark, DATA).collect():
        assert r.low <= r.estimate <= r.high


def test_queries_without_sql(spark):
    variants = QUERIES["profile_variants"](spark, DATA)
    assert variants.count() >= variants.select("vec_id").distinct().count() == 500
    digests = QUERIES["signal_digest"](spark, DATA).collect()
    assert len(digests) == 500 and all(len(r.exact) == len(r.trimmed) == 64 and 1 <= len(r.profiles) <= 6 for r in digests)
    m = QUERIES["replicate_matched"](spark, DATA).first()
    assert 0 < m.low <= m.picp <= m.high <= 1
    fitted = QUERIES["linear_residual"](spark, DATA).collect()
    assert len(fitted) == 3 and all(r.mae > 0 for r in fitted)
    r = QUERIES["two_sample"](spark, DATA).first()
    assert r.low <= r.difference <= r.high and r.ratio_low <= r.ratio <= r.ratio_high


def test_entry_points_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)

def test_bootstraps_are_registered_with_their_defaults():
    """10,000 replicates are part of the definition."""
    import inspect

    from cadenza.operators import inference
    from cadenza.plans import metrics

    assert metrics.REPLICATES == 10_000
    for f in (inference.bootstrap, inference.poisson_bootstrap, inference.poisson_two_sample, inference.poisson_coverage_difference):
        assert inspect.signature(f).parameters["replicates"].default == 10_000
