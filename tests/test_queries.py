"""Every query of the library against its DuckDB SQL, on the smallest tables."""

import pytest

from tests.compare import same
from textloom import plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    same(plans.queries()[name](spark, sf_dir), duck.execute(plans.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
