"""Every registered query of the library proper against its DuckDB SQL on the smallest tables."""

import pytest

from framesieve.plans import registry
from tests.conftest import plain


def test_queries_have_sql():
    assert registry.QUERIES.keys() - registry.ORACLE_SQL.keys() == {"q_phase_shift", "q_one_to_one", "q_contributions", "q_stack_frames", "q_star_contributions", "q_star_stacks", "q_analyze_images", "q_detected_stars", "q_star_profiles"}
    assert len(registry.QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    ours = registry.QUERIES[name](spark, sf)
    assert len(set(ours.columns)) == len(ours.columns)
    assert plain(ours.toPandas()) == plain(duck.execute(registry.ORACLE_SQL[name]).df())


def test_labels_of_long_ids(spark, duck, tmp_path):
    ids = [7, 999_999, 1_000_000, 1_000_001, 5_999_999, 99_999_999, 100_000_002, 700_000_010, 10**18 + 2, 2**63 - 1, -4, -1_000_003, None]
    spark.createDataFrame([(i, "click") for i in ids], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    asked = registry.ORACLE_SQL["q_frame_labels"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    ours = {r.event_id: r.label for r in registry.QUERIES["q_frame_labels"](spark, str(tmp_path)).collect()}
    assert ours == dict(duck.execute(asked).fetchall()) and ours[1_000_000] == "1000000"
