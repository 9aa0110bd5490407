"""Every query with SQL against DuckDB; the others against direct computation."""

import math
import os

import duckdb
import numpy as np
import pytest

from quern.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql_or_a_test():
    tested = {"html_to_text", "bracket_tree_flatten", "semi_global_edit", "degenerate_runs", "event_merge_greedy", "dbscan_points", "paired_bootstrap_ci", "stream_cooldown", "sequence_readings", "whole_tables", "box_table_cells", "matched_ingredients", "ingredient_coverage", "edit_traces", "character_confusions", "sentences_found", "allergen_warnings", "label_regions", "merged_reports", "stream_early_stops"}
    assert set(queries.QUERIES) - set(queries.SQL) == tested


def test_cooldown_stream(spark):
    got = queries.QUERIES["stream_cooldown"](spark, SF).toPandas()
    for _, g in got.sort_values("s").groupby("user_id"):
        last = None
        for s, accepted in zip(g.s, g.accepted):
            assert accepted == (last is None or s - last >= 7 * 86400)
            last = s if accepted else last


@pytest.mark.parametrize("name", ["html_to_text", "bracket_tree_flatten", "degenerate_runs", "event_merge_greedy", "dbscan_points", "paired_bootstrap_ci", "semi_global_edit"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pushdown(spark):
    plan = queries.QUERIES["exists_semi"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
