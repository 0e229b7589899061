"""The tier matrix counts every pref of every user."""

import duckdb
import pytest

from dinesight.catalog import load


@pytest.fixture
def tables(spark, tmp_path):
    """Twelve users who each bought three dishes of each of four suppliers."""
    lines = [(user * 10 + s, 7 * user + 3 * s + n, s, n, 1.0, 0.05) for user in range(12) for s in range(1, 5) for n in range(1, 4)]
    rows = {
        "customer": ([(user,) for user in range(12)], "c_custkey bigint"), "supplier": ([(s,) for s in range(1, 5)], "s_suppkey bigint"),
        "orders": ([(user * 10 + s, user) for user in range(12) for s in range(1, 5)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double"),
        "conversations": ([(c, t, "text") for c in range(1, 9) for t in range(3)], "conv_id bigint, turn int, text string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_all_prefs_are_counted(spark, tables):
    from dinesight.plans import ranking as plan

    found = {r.allergen: r.avoid + r.caution + r.likely_ok for r in load()["tier_matrix"].run(spark, tables).collect()}
    assert found == {"nuts": 12 * 4, "milk": 4 * 4}  # nuts for all, milk for every third
    picked = plan.user_prefs(spark, tables).where("nut_types IS NOT NULL").count()
    assert picked == 3  # and some of the nut prefs are of two nuts only


def test_matrix_equals_its_sql(spark, tables):
    con = duckdb.connect()
    for name in ("customer", "supplier", "orders", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    entry = load()["tier_matrix"]
    assert sorted(tuple(r) for r in entry.run(spark, tables).collect()) == sorted(con.execute(entry.sql).fetchall())
