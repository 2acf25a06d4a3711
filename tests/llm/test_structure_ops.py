"""Operators 11, 12 and 13, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from genocohort.llm import runs, sharding, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w, least=24, periods=3):
    n, out = len(w), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, periods * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = j if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 100))]
    for _ in range(rng.randint(0, 3)):
        part = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))]
        at = rng.randint(0, len(w))
        w[at:at] = (part * 60)[: rng.randint(1, 60)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        w = odd_words(rng)
        for least, periods in ((24, 3), (6, 3), (4, 2)):
            assert [tuple(r) for r in runs.runs_of([x.encode() for x in w], least, periods).tolist()] == plain_runs(w, least, periods)


def test_suffix_tree_extensions():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        tree = runs.SuffixTree(s)
        rank, turned = tree.tour(), tree.turned()
        order = sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert [order.index(i) for i in range(len(s) + 1)] == rank.tolist()
        order = sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        assert [order.index(i) for i in range(len(s) + 1)] == turned.tolist()
        a, b = np.array([(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]).T
        for i, j, k in zip(a, b, tree.lce(a, b), strict=True):
            assert s[i : i + k] == s[j : j + k] and (max(i, j) + k == len(s) or s[i + k] != s[j + k])


def report(i, text):
    """The contract of the query for one row."""
    words = WORD.findall(text or "")
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    found = plain_runs(words)
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_run_report(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(odd_words(rng)).replace("a", "é x")) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "x " * 40), (1003, "ab  " * 30), (1003, "ab  " * 30), (1004, "a\x1cb\n" * 24), (1005, ("one two\r\n" * 2000) + "three")]
    docs = spark.createDataFrame([(i, t, 9, "r", "k") for i, t in rows], "doc_id long, text string, start long, runs string, kept_text string").repartition(4)
    got = Counter(tuple(r) for r in runs.run_report(runs.planted(docs)).collect())
    assert got == Counter(report(i, t) for i, t in rows)
    assert runs.run_report(runs.planted(docs.limit(0))).collect() == []


def tree_shard(key, leaves):
    """Plain descent by the same draws."""
    import math

    def wait(path, weight):
        return -math.log((int(hashlib.md5(f"{key}|{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    def first(nodes):
        return min(nodes, key=lambda p: wait(p, sum(x.weight for x in nodes[p])))

    for cut in (lambda x: str(x.region), lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
        nodes = defaultdict(list)
        for x in leaves:
            nodes[cut(x)].append(x)
        leaves = nodes[first(nodes)]
    return leaves[0].shard


def test_hash_tree(spark, docs, rows, no_docs):
    old, new = sharding.shard_tree(24), sharding.shard_tree(25)
    copies = docs.unionByName(docs.where("doc_id = 503").crossJoin(spark.range(2500)).drop("id"))
    got = sharding.place(copies.withColumn("shard", docs["extra"]).withColumn("slot", docs["extra"]), old, new).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), tree_shard("" if i is None else i, old), tree_shard("" if i is None else i, new)) for i, t, *_ in [*rows, *[r for r in rows if r[0] == 503] * 2500])
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.place(no_docs, old).collect() == []


def test_hash_tree_parts_and_weights(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text")
    old = [sharding.Leaf(0, 0, 0), sharding.Leaf(0, 1, 1, 3.0), sharding.Leaf(1, 0, 2, 2.0), sharding.Leaf(1, 0, 3, 0.0)]
    first = {(r.doc_id, r.shard, r.slot) for r in sharding.place(docs, old).collect()}
    monkeypatch.setattr(sharding, "ROWS_A_PART", 50)
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.place(docs, old).collect()} == first
    held = Counter(s for _, s, _ in first)
    assert set(held) == {0, 1, 2} and abs(held[1] - 3000) < 150 and abs(held[2] - 2000) < 150
    # rack 1 of region 0 gets heavier: rows move into region 0, and inside it into rack 1
    new = [sharding.Leaf(0, 0, 0), sharding.Leaf(0, 1, 1, 5.0), sharding.Leaf(1, 0, 2, 2.0)]
    moved = sharding.moves(docs, old, new).collect()
    assert {(r.from_shard, r.to_shard) for r in moved} <= {(0, 1), (2, 0), (2, 1)} and sum(r.rows for r in moved) > 0


def test_write_shards(spark, docs, tmp_path):
    given = docs.withColumn("Shard", docs["extra"])
    for k, files in enumerate((None, 2)):
        name = sharding.write_shards(given, f"{tmp_path}/{k}", sharding.shard_tree(5), files)
        back = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "shard_" and back.count() == docs.count()
        assert back.where(back[name] != sharding.shard_of(back["doc_id"], sharding.shard_tree(5))).count() == 0
        assert not files or max(len(list((tmp_path / f"{k}").glob(f"{name}={s}/*.parquet"))) for s in range(5)) <= 2


def test_findclose():
    rng = random.Random(4)
    for _ in range(150):
        n, bits, depth, lean = rng.choice([1, 3, 40, 200, 900]), [], 0, rng.choice([0.3, 0.5, 0.9])
        while n or depth:
            up = n and (not depth or rng.random() < lean)
            bits.append(up)
            depth, n = depth + (1 if up else -1), n - bool(up)
        stack, want = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = trie.Parens(np.array(bits, bool))
        assert dict(zip(tree.opens().tolist(), tree.findclose(tree.opens()).tolist(), strict=True)) == want


def plain_trie(rows, replay):
    own = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((r or "", x or ""))
    if replay:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[: h[c]] + s[h[c] :] for c, s in dict(own).items()}
    members, kids, sums = defaultdict(list), defaultdict(list), {}
    for c, s in own.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        sums[k] = (sum(sums[x][0] for x in kids[k]) if kids[k] else 1, saved + sum(sums[x][1] for x in kids[k]))
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *sums[k], sha(",".join(map(str, sorted(c for c in m if len(own[c]) == len(k)))))) for k, m in members.items())


CONV = "conv_id long, turn long, role string, text string, mark string, depth long"


def test_trie_equals_brute_force(spark):
    rng = random.Random(5)
    say = ["hi", "", None, "ça va", "good day to you", "x" * 50]
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(say[: rng.choice([1, 4, 6])])) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "again") for c in range(100, 160) for t in range(3)]  # one conversation in many shards
    rows += [(c, t, "user", "again") for c in range(160, 166) for t in range(5)]
    rows += [(200, None, "system", "first"), (200, 0, "user", "hi"), (None, 0, "user", "lost"), (201, 0, None, None), (202, 7, "us", "er"), (203, 7, "use", "r")]
    rows += [(300, t, "user", f"turn {t}") for t in range(3000)]
    table = spark.createDataFrame([(*r, "m", 1) for r in rows], CONV).repartition(3)
    found = trie.sequences(table)
    for replay in (False, True):
        want = plain_trie(rows, replay)
        for shard_turns in (4, 40, 10**6):
            got = trie.trie(trie.replayed(found) if replay else found, shard_turns)
            assert Counter(tuple(r) for r in got.drop("turn_md5").collect()) == want
    assert trie.conversation_trie(table.limit(0)).collect() == []


def test_trie_of_turnless(spark):
    table = spark.createDataFrame([(c, 0, "user", "hi", "m", 1) for c in range(1, 5)], CONV)
    want = plain_trie([(c, 0, "user", "hi") for c in range(1, 5)], True)
    assert Counter(tuple(r) for r in trie.trie(trie.replayed(trie.sequences(table)), 2).drop("turn_md5").collect()) == want
