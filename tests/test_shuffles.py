"""Views that Spark reads by a text of its own have the rows of the SQL, and what grows with the tables is shuffled and staged once."""

import re

import duckdb
import pytest

from genocohort.operators import lineage, rules, staging
from genocohort.plans import fixtures, queries, registry


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Markers that repeat or have no key, samples whose parents are not there, orders and lines without keys or with equal ones."""
    at = tmp_path_factory.mktemp("odd")
    part = [(k, "b", "t", (k or 0) % 9) for k in [*range(40), 3, 3, 17, None, None, 12345678901]]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
    orders = [(o, None if o == 8 else 5 if o % 20 == 7 else o - 30) for o in range(120)] + [(None, 4), (11, 15)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{at}/orders.parquet")
    lines = spark.range(900).selectExpr("IF(id % 50 = 9, NULL, id % 125) AS l_orderkey", "IF(id % 70 = 3, NULL, id * 7 % 43) AS l_partkey", "id % 10 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber", "id % 50 + 1D AS l_quantity", "1D * (id % 3) AS l_extendedprice", "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax", "timestamp '2020-01-01' AS l_shipdate")
    lines.unionByName(lines.limit(30)).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["fx_truth", "fx_calls"])
def test_rows_are_those_of_the_sql(spark, odd, name):
    db = duckdb.connect()
    for table in ("part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    found = fixtures.view(spark, odd, name)
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({fixtures.as_ctes(f'SELECT * FROM {name}')})").fetchall()
    got = [tuple(r) for r in found.collect()]
    # rows that tie in all columns of the order share their numbers
    assert len(want) > 500 and sorted(got, key=str) == sorted(want, key=str)


def exchanges(df):
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\), (\w+)", plan)


def test_truth_and_calls_are_shuffled_once(spark, odd):
    assert not [k for k, why in exchanges(fixtures.view(spark, odd, "fx_truth")) if "marker_id" in k]
    queries.release()
    keys = [k for k, _ in exchanges(queries.Cohort(spark, odd).pooled())]
    queries.release()
    assert [k for k in keys if "rsid" in k] == ["sample_id, rsid"] and not [k for k in keys if "h1" in k or "CASE" in k]
    assert keys.count("l_orderkey") == 1 and keys.count("l_partkey") <= 1


def test_report_makes_one_closure(spark, monkeypatch):
    tree = spark.createDataFrame([("A", "", "", "", ""), ("B", "A", "rs1", "A", "C"), ("C", "B", "rs2", "G", "T")], "node string, parent string, rsid string, ancestral string, derived string")
    pooled = spark.createDataFrame([(1, "rs1", "C", "C"), (1, "rs2", "G", "G"), (2, "rs2", "N", "N")], "sample_id long, rsid string, allele1 string, allele2 string")
    made, whole, real = [], [], lineage.tree_closure
    monkeypatch.setattr(lineage, "tree_closure", lambda t: made.append(t) or real(t))
    monkeypatch.setattr(lineage, "staged", lambda df, name: whole.append(name) or staging.staged(df, name))
    got = {r.sample_id: (r.state, r.haplogroup, r.readable, r.in_tree, r.deepest_readable, r.tested, r.not_testable) for r in lineage.lineage_report(pooled, tree).collect()}
    assert got == {1: ("resolved", "B", 2, 2, "C", 2, 0), 2: ("no_data", None, 0, 2, None, 0, 2)}
    assert len(made) == 1 and whole.count("states") == 1


def test_inventory_holds_no_truth(spark, odd):
    queries.release()
    found = registry.queries()["ag41_panel_inventory"]
    assert found(spark, odd).count() == 1
    names = {name for *_, name in queries._held}
    queries.release()
    assert "fx_truth" not in names


def test_coverage_works_out_needs_once(spark, monkeypatch):
    # rule 1 needs one marker, rule 2 the same and another, rule 3 none
    nodes = [("R1", 1, 0, "geno", "rs1", "A", ""), ("R2", 1, 0, "and", "", None, ""), ("R2", 2, 1, "rule", "", None, "R1"), ("R2", 3, 1, "geno", "rs2", "C", ""), ("R3", 1, 0, "not", "", None, ""), ("R3", 2, 1, "rule", "", None, "R9")]
    nodes = spark.createDataFrame([(*n[:4], 0, *n[4:]) for n in nodes], "rule_id string, node_id int, parent_id int, op string, n int, rsid string, alleles string, ref_rule string")
    pooled = spark.createDataFrame([(1, "rs1", "A", "G"), (1, "rs2", "N", "N"), (2, "rs1", "A", "A"), (2, "rs2", "C", "T")], "sample_id long, rsid string, allele1 string, allele2 string")
    names = []
    monkeypatch.setattr(rules, "staged", lambda df, name: names.append(name) or staging.staged(df, name))
    got = {(r.sample_id, r.rule_id): (r.matched, r.required, r.coverage, r.bucket, r.partial_coverage) for r in rules.rule_coverage(pooled, nodes).collect()}
    full, half = (True, 1, 1.0, "matched", False), (False, 2, 0.5, "incomplete", False)
    assert got == {(1, "R1"): full, (2, "R1"): full, (1, "R2"): half, (2, "R2"): (True, 2, 1.0, "matched", False), (1, "R3"): (True, 0, 1.0, "matched", False), (2, "R3"): (True, 0, 1.0, "matched", False)}
    assert names.count("need") == 1
