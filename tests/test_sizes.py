"""What grows with the tables lies in many tasks, and is not sent to all of them."""

from genocohort.plans import fixtures, queries
from genocohort.plans.scan import rescore
from genocohort.sources import stores


def test_haplotypes_are_dealt_by_marker(spark, tmp_path, monkeypatch):
    spark.range(1_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fixtures, "PART_MARKERS", 100)
    haps = fixtures.view(spark, str(tmp_path), "fx_haps")
    most = max(haps.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    assert haps.count() == 40_000 and most < 10_000
    assert fixtures.view(spark, str(tmp_path), "fx_truth").count() == 20_000


def test_stored_tables_are_merged(spark, tmp_path):
    store = stores.ReferenceStore(spark, str(tmp_path / "reference"))
    store.write("calls", spark.range(1_000).selectExpr("concat('rs', id) AS rsid", "id AS sample_id"), buckets=4)
    store.write("frequencies", spark.range(10).selectExpr("concat('rs', id) AS rsid", "0.5D AS freq"), buckets=4)
    both = store.table("calls").join(store.table("frequencies").select("rsid", "freq"), "rsid")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Exchange" not in plan and both.count() == 10


def test_mix_query_draws_all_blocks(spark):
    from genocohort.llm import mixing, queries

    # each of about 4,096 blocks gives a piece at least
    pieces = queries.op5_source_mix(spark, "/root/testdata/sf0.01").where("taken > 0").selectExpr("explode(split(pieces, ','))")
    assert pieces.count() >= mixing.BLOCKS


def test_markers_and_orders_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 9 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = spark.range(200).selectExpr("id % 40 AS l_orderkey", "id % 50 AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "id % 50 + 1D AS l_quantity", "1D AS l_extendedprice", "0.1D AS l_discount", "0.08D AS l_tax", "timestamp '2020-01-01' AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("fx_truth", "fx_calls", "fx_snapshot_entries", "fx_allele_defs", "fx_tree"):
        plan = fixtures.view(spark, str(tmp_path), name)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
    assert fixtures.view(spark, str(tmp_path), "fx_calls").count() == 200

    queries.release()
    cohort = queries.Cohort(spark, str(tmp_path))
    rescored = rescore(cohort.scan()["findings"], cohort.view("fx_allele_freq"), "POP3").select("sample_id", "rsid", "freq")
    assert {name for *_, name in queries._held} == {"pooled", "fx_ref_variants", "fx_allele_freq"}  # no calls of kits, no findings
    assert rescored.count() == cohort.scan()["findings"].count() > 0
    queries.release()


def test_search_works_out_scores_once(spark):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["fl3_search_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG10(" in plan and not any("LOG10(" in f for f in re.findall(r"Filter (.*)", plan))  # a part of the score


def test_segments_are_found_once(spark):
    from genocohort.operators import family

    # places 30 and 60 differ: runs of 30, 29 and 39 markers, of which the second is too short
    ibs = spark.range(1, 101).selectExpr("1L AS a", "2L AS b", "1 AS chrom_no", "id - 1 AS k", "concat('rs', id) AS rsid", "(id - 1) * 1000000 AS position").selectExpr("*", "IF(k IN (30, 60), 0, 2) AS ibs").drop("k")
    found = family.ibd_segments(ibs, spark.sql("SELECT 1 AS chrom_no, 0L AS bp, 0D AS cm UNION ALL SELECT 1, 100000000L, 100D"), min_snps=30, min_cm=1.0, max_oh=0)
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.start_bp, r.end_bp, r.snps, r.cm) for r in found.collect()) == [(0, 29_000_000, 30, 29.0), (61_000_000, 99_000_000, 39, 38.0)]
