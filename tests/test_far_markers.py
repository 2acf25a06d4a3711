"""Tables with markers far from the first ones, as large tables have them, against the SQL; and text files of many blocks."""

import random

import duckdb
import pytest

import __spark_entry__ as entry

# markers of the fixed defs, those of the tree and star alleles that small tables lack, and those named like blood group tags
NEAR, FAR = range(60), [998997, 998998, 998999, 504922, 585178, 589787, 8175719]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("far"), random.Random(7)
    keys = [*NEAR, *FAR]
    part = [(k, f"Brand#{k % 5}", f"TYPE {k % 4}", k % 50 + 1) for k in keys]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.range(200).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{at}/orders.parquet")
    items = [(o, k, rng.randrange(10), n, float(rng.randint(1, 50)), 1000.0 + n, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, "1995-01-01") for o in range(200) for n, k in enumerate(rng.sample(keys, 9))]
    lines = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string")
    lines.selectExpr("* except (l_shipdate)", "CAST(l_shipdate AS timestamp) AS l_shipdate").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def by_sql(folder, name):
    db = duckdb.connect()
    for table in ("part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = db.execute(entry.oracle_sql()[name])
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("name", ["ru6_blood_group", "wn16_compare_lineage_calls", "wn11_assign_slots", "wn12_phenotype", "wn13_lineage_walk"])
def test_far_markers_equal_the_sql(spark, far, name):
    columns, want = by_sql(far, name)
    got = [tuple(r) for r in entry.queries()[name](spark, far).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_far_markers_are_read(spark, far):
    walks = {r.haplogroup for r in entry.queries()["wn13_lineage_walk"](spark, far).collect()}
    slots = "/".join(r.diplotype or "" for r in entry.queries()["wn11_assign_slots"](spark, far).collect())
    assert "B1" in walks and "*5" in slots


def test_chain_file_of_many_blocks(spark, tmp_path):
    from genocohort.plans.queries_sources import write_files

    spark.range(600_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()["src10_read_chain_blocks"](spark, str(tmp_path)).count() == spark.range(600_000).selectExpr("id % 22", "floor((floor(id / 22) + 1) / 10)").distinct().count()
    # one file a value, however the rows lay before
    rows = spark.range(40_000).selectExpr("id % 5 AS by", "id AS k", "string(id) AS value")
    head = rows.groupBy("by").agg({"k": "min"}).selectExpr("by", "-1L AS k", "'head' AS value")
    path = write_files(head.unionByName(rows.repartition(7, "by")), ["by"], f"{tmp_path}/files")
    assert spark.read.text(path, wholetext=True).where("value like 'head%'").count() == 5 == spark.read.text(path, wholetext=True).count()


def test_one_decimal_as_in_the_sql(spark):
    from genocohort.functions.caveats import attach_imputation_caveats, attach_score_caveats

    shares = [0.0, 0.2625, 0.0635, 0.1235, 0.0005, 0.00049, 0.9995, 0.99949, 1.0, 1 / 3, 0.2635, 0.9375] + [k / 10_000 for k in range(0, 10_000, 37)]
    said = [r.caveats[-1] for r in attach_score_caveats(spark.createDataFrame([(i, c) for i, c in enumerate(shares)], "i int, coverage double")).orderBy("i").collect()]
    assert said == [f"This score used {c * 100:.1f} percent of its variants." for c in shares]
    counts = [(168, 640), (1, 16), (3, 16), (0, 0), (7, 7), (1, 2000), (3, 2000), (1113, 2000)]
    said = [r.caveats[-1] for r in attach_imputation_caveats(spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(counts)], "i int, above long, imputed long")).orderBy("i").collect()]
    assert said == [f"{a} of {n} imputed variants ({100 * a / n if n else 0:.1f} percent) have a quality of 0.80 or more." for a, n in counts]
