"""Operators 2, 8, 9, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np

from genocohort.llm import hnsw, line_dedup, minhash_forest
from genocohort.llm.common import components, meet


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def brute_lines(rows):
    order = sorted({(i if i is not None else -1, t) for i, t, *_ in rows if t is not None}, key=lambda r: r[0])
    occ = [(i, k, line) for i, t in order for k, line in enumerate(t.split("\n")) if line.strip(" ")]
    first = {}
    for i, k, line in sorted(occ, key=lambda o: o[:2]):
        first.setdefault(line, (i, k))
    lines = sorted(first, key=first.get)
    near = {line for x, line in enumerate(lines) if any(within_one(e, line) and first[e] < first[line] for e in lines[:x])}
    out = {}
    for i, t in order:
        kept, seen = [], set()
        for k, line in enumerate(t.split("\n")):
            if not line.strip(" "):
                kept.append(line)
            elif line not in seen and first[line][0] >= i and not (line in near and first[line] == (i, k)):
                kept.append(line)
            seen.add(line)
        out[i, t] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(docs, rows):
    want = brute_lines(rows)
    out = line_dedup.dedup_lines(docs)
    got = out.collect()
    assert len(got) == len(rows) and set(docs.columns) < set(out.columns)
    for r in got:
        if r.text is None:
            assert r.kept_text is None and r.n_lines == 0
        elif r.doc_id is not None:
            assert r.kept_text == want[r.doc_id, r.text], r.doc_id
            assert r.n_lines == r.n_exact + r.n_near + r.n_kept
    assert sum(r.n_near for r in got) > 3 and sum(r.n_exact for r in got) > 20


def test_lines_long_and_crowded(spark, no_docs):
    rng = random.Random(5)
    base = "".join(rng.choice("abc ") for _ in range(3000)) + "."
    rows = [(0, base)]
    for i in range(1, 40):
        k = rng.randrange(len(base) - 1)
        rows.append((i, base[:k] + rng.choice(["", "#", base[k] + "%"]) + base[k + 1 :]))
    rows.append((99, base[:10] + "##" + base[12:]))
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert got == {i: len(want[i, t].split("\n")) if want[i, t] else 0 for i, t in rows}
    assert got[0] == 1 and got[99] == 1 and sum(got.values()) == 2
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_short_lines_and_clashing_names(spark):
    rng = random.Random(9)
    texts = ["\n".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, "zz\n\nz"), (91, "qq")]
    want = brute_lines(rows)
    df = spark.createDataFrame([(i, t, *"abcdefghij") for i, t in rows], "doc_id long, text string, id string, row string, lines string, exact string, near string, kept string, equal string, taken string, gone string, `a.b` string")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "kept_text", "n_lines", "n_exact", "n_near", "n_kept"]
    for r in got.collect():
        assert r.kept_text == want[r.doc_id, r.text], r.doc_id
        assert [r[c] for c in df.columns[2:]] == list("abcdefghij")


def test_common_lines_are_dealt_over_tasks(spark):
    """A key with a third of all rows meets its facts in many tasks, with the same rows as a plain join."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k < 2000")
    plain = Counter(map(tuple, rows.join(facts.drop("n"), "k").collect()))
    assert Counter(map(tuple, meet(rows, facts, ["k"], ["id"]).collect())) == plain
    dealt = meet(rows, facts, ["k"], ["id"], most=0, least=50)
    assert Counter(map(tuple, dealt.collect())) == plain and dealt.columns == ["k", "id", "low"]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(sets, linked):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if linked(sets[a], sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def alike(a, b):
    n = len(a & b)
    return bool(a and b) and 100 * n >= 75 * (len(a) + len(b) - n)


def test_near_duplicates_equal_brute_force(docs, rows, no_docs):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    want = brute_groups(sets, alike)
    got = minhash_forest.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id]), r
    assert minhash_forest.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Edits of one text that are alike to some of each other only."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    want = brute_groups(sets, alike)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(600):
        v = centres[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.1, 0.3, 1.0])
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(1000 + i, [float(x) for x in centres[0]], 0) for i in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] + [1.0] * 15, 0), (2005, rows[0][1], None), (2006, [1.0, 2.0], 0), (2007, [], 0), (None, rows[0][1], 0), (2008, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = {r.vec_id: r for r in hnsw.near_vectors(df, shard_rows=90).collect()}
    assert len(got) == len(rows)
    good = {i: (np.array(v) / np.linalg.norm(v), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = brute_groups(good, lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] >= 0.93)
    links = {i: sum(j != i and l == m and len(v) == len(w) and bool(v @ w >= 0.93) for j, (w, m) in good.items()) for i, (v, l) in good.items()}
    found = sum(got[i].n_links for i in good)
    assert 0.97 * sum(links.values()) <= found <= sum(links.values()) and all(got[i].n_links <= links[i] for i in good)
    assert np.mean([got[i].component_id == want[i] for i in good]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2005, 2007, None))
    assert got[2008].component_id == 2006
    assert hnsw.near_vectors(df.where("false")).count() == 0


def test_near_duplicates_lone_links_in_a_wide_crowd(spark):
    """Thousands of texts alike at about 0.6 to all others, a few pairs of which are alike at 0.75."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]

    def edited(words, n):
        words = list(words)
        for k in rng.sample(range(len(words) // 5), n):
            words[5 * k + 2] = f"x{rng.randrange(10**9)}"
        return words

    texts = [edited(base, 3) for _ in range(4000)]
    for i in range(0, 400, 2):
        texts[i + 1] = edited(texts[i], 2)
        for k in (0, 1, 99):
            texts[i + 1][k] = f"y{rng.randrange(10**9)}"
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    number = {s: k for k, s in enumerate({s for x in sets.values() for s in x})}
    held = defaultdict(list)
    for i, x in sets.items():
        for s in x:
            held[number[s]].append(i)
    held = {s: np.array(x) for s, x in held.items()}
    links = []
    for i, x in sets.items():
        shared = sum((np.bincount(held[number[s]], minlength=len(rows)) for s in x), np.zeros(len(rows), int))
        links += [(i, int(j)) for j in np.flatnonzero(100 * shared >= 75 * (len(x) + np.array([len(sets[k]) for k in range(len(rows))]) - shared)) if j < i]
    want = {i: i for i in sets}
    for a, b in sorted(links) * 3:
        low = min(want[a], want[b])
        want = {i: low if g in (want[a], want[b]) else g for i, g in want.items()} if want[a] != want[b] else want
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(links) >= 200 and len(set(want.values())) > 3000
    assert got == want


def test_vectors_of_few_links_in_full_shards(spark):
    """Shards of the registered size whose vectors mostly have no link, some one link in any shard."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 64))
    for i in range(0, 600, 2):
        v[i + 1] = v[i] + 0.3 * rng.normal(size=64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.93)
    links = np.bincount(a[a != b], minlength=len(v))
    df = spark.createDataFrame([(i, [float(c) for c in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in hnsw.near_vectors(df).collect()}
    assert hnsw.SHARD_ROWS == 2000 and links.sum() > 300
    assert [got[i].n_links for i in range(len(v))] == links.tolist()
    assert all(got[i].component_id == (i - i % 2 if links[i] else i) for i in range(len(v)))


def test_queries_walk_where_links_are_few():
    rng = np.random.default_rng(5)
    for linked in (0, 20, 400):
        v = rng.normal(size=(2000, 64))
        for i in range(linked // 2):
            v[1000 + i] = v[i] + 0.02 * rng.normal(size=64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        graph = hnsw.Graph(v)
        a, b = graph.within(v, 0.93, True)
        want = set(zip(*(x.tolist() for x in np.nonzero(v @ v.T >= 0.93))))
        assert graph.walked > 0.9 * len(v) and len(want & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(want)


def test_vector_audit_notices_cut_off_vertices():
    """Few queries have a link, each to a vertex that no walk reaches."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = rng.normal(size=(2000, 32))
    q[5::400] = v[rng.permutation(600)[:5]]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    want = set(zip(*(x.tolist() for x in np.nonzero(q @ v.T >= 0.93))))
    graph = hnsw.Graph(v)
    for layer in graph.adj:
        layer[np.isin(layer, [b for _, b in want])] = -1
    a, b = graph.within(q, 0.93)
    assert len(want) >= 5 and set(zip(a.tolist(), b.tolist())) >= want
