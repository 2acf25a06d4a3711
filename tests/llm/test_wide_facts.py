"""Facts that hold whole vectors are not sent to the driver."""

import random
import re

from genocohort.llm import hnsw


def test_vectors_are_not_broadcast(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, v, i % 2) for i, v in enumerate(base)] + [(100 + i, [x * 2 for x in v], i % 2) for i, v in enumerate(base[:10])] + [(200, base[0], 0), (201, None, 0)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
        got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"(\w+Join) \[label, .*?(Inner|LeftOuter)", plan)
    assert ("SortMergeJoin", "Inner") in joins and ("BroadcastHashJoin", "Inner") not in joins, plan
    assert len(got) == len(rows) and got[201] == (0, 201) and got[200][1] == 0 and got[200][0] >= 2 and all(got[100 + i][1] <= i for i in range(10))
