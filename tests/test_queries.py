"""Every registered query of the core against an independent engine, on the same tables."""

import pytest

from ledgerloom import registry
from tests.compare import assert_same

QUERIES, ORACLE = registry.load()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3


def test_sketch_quantiles_are_close_in_rank(spark, sf_dir):
    from ledgerloom.plans.named import POINTS, priced
    from ledgerloom.sources.tables import relation

    values = sorted(r[0] for r in priced(relation(spark, sf_dir, "victims", ["amount_usd"])).collect())
    got = QUERIES["q5a_legacy_break_points"](spark, sf_dir).first()
    for name, p in POINTS.items():
        assert abs(values.index(got[name]) + 1 - float(p) * len(values)) <= 1 + len(values) / 1000
