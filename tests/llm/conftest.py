import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    """The cases with extra columns whose names clash with those the operators use inside."""
    from cases import cases

    rows = [(i, t, ("en", "de")[n % 2] if n % 5 else None, f"s{n % 3}" if n % 4 else None, len(t or ""), n, "x", 1) for n, (i, t) in enumerate(cases())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, label int").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
