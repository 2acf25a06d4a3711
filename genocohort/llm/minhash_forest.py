"""MinHash near-dedup by an LSH forest, confirmed on full shingle sets (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, components, meet, smallest_reachable, stage

#: Words in a shingle; link at 100 * shared >= LINK * union.
SHINGLE, LINK = 5, 75
#: Sorted signature orders, fresh values in each, leading values that two neighbours must share,
#: following values that an order sorts by, and neighbours that each row meets on either side.
TREES, FRESH, ROOT, DEPTH, NEAR = 32, 6, 3, 13, 8
VALUES = TREES * FRESH
#: Orders that are searched first: they join most members of a large group, so that the others pass over its pairs.
FIRST_TREES = 4
#: Leading values that the rows of a crowd share: two sets alike at 0.75 share them in one of the
#: orders but for a chance of 2 in 10,000.  Rows of a crowd in a block, two of which meet in a task.
CROWD, BLOCK = 5, 512
#: A pair goes on to the exact test if this part of its signature agrees: at a true similarity
#: of 0.75 the estimate's standard deviation is 0.031, so 0.62 lies over four of them below.
LEAST_AGREEMENT = 0.62
#: Distinct words whose hashes a task remembers before it starts anew.
WORD_CACHE = 500_000

_ODD = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, VALUES + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing step."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; A-Z lower-cased, words
    between ASCII white space; fewer than SHINGLE words make one shingle, none make none."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mixed(out + h[k : n - size + 1 + k] * _ODD[VALUES + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of VALUES multiplicative hashes, as 32 bits."""
    least = np.full(VALUES, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _ODD[None, :VALUES]).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


def roots(values: np.ndarray) -> np.ndarray:
    """For each row of signatures and each order, a hash of the order and its leading ROOT values."""
    out = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(values), TREES))
    for k in range(ROOT):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k : k + FRESH * TREES : FRESH].astype(np.uint64))
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, sig`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        import xxhash

        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")


def light_rows(reps: DataFrame) -> DataFrame:
    """``root, doc_id``: the region of each document in each order."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(roots(sigs).ravel()), pa.array(ids)], names=["root", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(run, "root long, doc_id long")


def forest_rows(reps: DataFrame) -> DataFrame:
    """A row for each order in which a document's region holds others: region, the following
    values to sort by, the signature's low bytes and the order's number."""
    schema = pa.schema([("root", pa.int64()), ("rest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("tree", pa.int32())])

    def run(batches):
        for batch in batches:
            made = [[], [], [], [], [], []]
            for i, n, raw, held in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sig = np.frombuffer(raw, np.uint32)
                own, low, around = roots(sig[None, :])[0], sig.astype(np.uint8).tobytes(), np.concatenate([sig, sig]).astype(">u2")
                for tree in np.flatnonzero(np.isin(own, np.array(held, np.int64))):
                    start = tree * FRESH + ROOT
                    for column, value in zip(made, (int(own[tree]), around[start : start + DEPTH].tobytes(), i, n, low, int(tree))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)

    return reps.select("doc_id", "n_shingles", "sig", "held").mapInArrow(run, "root long, rest binary, doc_id long, n long, low binary, tree int")


def neighbours(rows: DataFrame, best_only: bool) -> DataFrame:
    """``node, a, b, agree``: pairs within NEAR places of each other in a sorted region whose signatures agree enough.

    Neighbours in the order have the longest common prefixes, so a crowded region is
    compared at its own greater depth.  With ``best_only`` each row gives the pair with its best
    predecessor; without, all pairs of different ``group``.  The table is dealt by ranges of
    the whole order: a region of any size is spread over as many tasks as it fills.  The first and
    last NEAR rows of every task meet in one more, so no border parts neighbours.
    """
    least = int(LEAST_AGREEMENT * VALUES)

    names = ["root", "rest", "doc_id", "n", "low", "group"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    schema = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), *zip(names, kinds)])

    def out(node, i, j, agree):
        none = [pa.nulls(len(node), k) for k in kinds]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(agree.astype(np.int32)), *none], schema=schema)

    def border(rows):
        none = [pa.nulls(rows.num_rows, f.type) for f in list(schema)[:4]]
        return pa.RecordBatch.from_arrays([*none, *(rows.column(k).cast(kind) for k, kind in enumerate(kinds))], schema=schema)

    def run(batches):
        kept, first, ends = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if first < NEAR:
                yield border(head := batch.slice(0, NEAR - first))
                first += head.num_rows
            left = NEAR
            last = []
            for rows_ in [batch, *reversed(ends)]:
                if left:
                    last.insert(0, rows_.slice(max(0, rows_.num_rows - left)))
                    left -= last[0].num_rows
            ends = last
            root, ids, n, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 5))
            low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, VALUES)
            if kept is not None:
                root, ids, n, group, low = (np.concatenate([x, y]) for x, y in zip(kept, (root, ids, n, group, low)))
            old = 0 if kept is None else len(kept[0])
            best, who = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
            for step in range(1, NEAR + 1):
                j = np.arange(max(old, step), len(ids))
                i = j - step
                ok = (root[i] == root[j]) & (group[i] != group[j]) & (100 * np.minimum(n[i], n[j]) >= LINK * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                for at in range(0, len(i), 4096):
                    x, y = i[at : at + 4096], j[at : at + 4096]
                    agree = (low[x] == low[y]).sum(axis=1)
                    if best_only:
                        more = (agree >= least) & (agree > best[y])
                        best[y[more]], who[y[more]] = agree[more], x[more]
                    elif (agree >= least).any():
                        hit = agree >= least
                        yield out(ids[y[hit]], ids[x[hit]], ids[y[hit]], agree[hit])
            if best_only and (has := np.flatnonzero(who >= 0)).size:
                yield out(ids[has], ids[who[has]], ids[has], best[has])
            kept = tuple(x[-NEAR:] for x in (root, ids, n, group, low))
        for rows_ in ends:
            yield border(rows_)

    order = ["root", "rest", "doc_id"]
    kind = "node long, a long, b long, agree int, root long, rest binary, doc_id long, n long, low binary, group long"
    met = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).mapInArrow(run, kind), "met")
    # two borders of a task: a few rows for each task, whatever the table
    ends = met.where("node is null").select(*names).distinct().coalesce(1).sortWithinPartitions(*order).mapInArrow(run, kind)
    return met.where("node is not null").unionByName(ends.where("node is not null")).select("node", "a", "b", "agree")


def crowd_links(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """``a, b``: links between the groups of ``rows`` that lie in crowds, or None if there is no crowd.

    A crowd is a set of more rows of an order than a window reaches, with CROWD leading values in
    common and more than one group.  All its rows of different groups are compared on their full sets:
    the crowd is dealt by hash to blocks, and every two blocks meet in a task, which returns a
    spanning set of the links of its groups.
    """
    key = ["root", "head"]
    held = rows.select("root", F.substring("rest", 1, 2 * (CROWD - ROOT)).alias("head"), "doc_id", "group")
    size = held.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("group").alias("x"), F.max("group").alias("y"))
    size = stage(size.where((F.col("rows") > NEAR + 1) & (F.col("x") != F.col("y"))).select(*key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "crowds")
    if not (n := size.count()):
        return None
    held = stage(held.join(bounded_broadcast(size, n), key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "crowded")
    nodes = stage(held.select(F.col("doc_id").alias("node")).distinct().join(known.select("node"), "node", "left_anti"), "nodes")
    sets = known.unionByName(stage(full_sets(docs, nodes, nodes.count()), "sets"))

    def links(pdf):
        import pandas as pd

        mine = pdf["block"].to_numpy() == pdf["x"].iloc[0]
        other = pdf["block"].to_numpy() == pdf["y"].iloc[0]
        group, found = pdf["group"].to_numpy(), pdf["shingles"].to_list()
        at = np.flatnonzero(other)
        n = np.array([len(found[k]) for k in at])
        values, owner = np.concatenate([found[k] for k in at] or [np.empty(0, np.int64)]), np.repeat(np.arange(len(at)), n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.flatnonzero(mine):
            own = found[k]
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            many = high - low
            places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(owner[places], minlength=len(at))
            hit = (group[at] != group[k]) & (100 * shared >= LINK * (len(own) + n - shared))
            b.append(np.unique(group[at[hit]]))
            a.append(np.full(len(b[-1]), group[k]))
        node, least = smallest_reachable(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": node, "b": least})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.select(*key, "doc_id", "group", "block", other).select(*key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "group", F.col("doc_id").alias("node"))
    return stage(dealt.join(sets, "node").groupBy(*key, "x", "y").applyInPandas(links, "a long, b long").where("a <> b").distinct(), "crowd_links")


def full_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """``node, shingles`` of the documents in ``nodes(node)``."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        words = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # of rows that repeat a doc_id with other texts, the one with the least hash stands for the node
    found = texts.join(bounded_broadcast(nodes, n_nodes), "node", "left_semi").groupBy("node").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.mapInArrow(run, "node long, shingles array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are as alike as a link asks."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("shared") >= LINK * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def confirmed(docs: DataFrame, pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(the links among ``pairs``, the sets that were read); ``known`` holds sets read before."""
    pairs = stage(pairs, "pairs")
    nodes = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    nodes = stage(nodes if known is None else nodes.join(known.select("node"), "node", "left_anti"), "nodes")
    sets = stage(full_sets(docs, nodes, nodes.count()), "sets")
    sets = sets if known is None else known.unionByName(sets)
    return stage(confirm(pairs, sets), "links"), sets


def grouped(rows: DataFrame, group: DataFrame) -> DataFrame:
    """``rows`` with the component of each document, itself where it has no link."""
    return rows.join(bounded_broadcast(group, group.count()), F.col("doc_id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "doc_id")).drop("node", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of near duplicates among ``docs(doc_id, text)``.

    Documents with equal shingle sets form a class with the smallest doc_id as its representative;
    the forest finds pairs of representatives, and a pair links only if the full sets confirm it.
    First each document's best candidate in a few orders is confirmed, then the best one of another component in all
    orders, then all candidates between different components: pairs inside a component can't change it, so no
    group of n copies costs n * n.
    Last, crowds that are wider than the windows are compared in full between their components.

    Returns per row ``doc_id, n_shingles, component_id, kept``.  Null and blank texts have
    no shingles and link with nothing, nor does a null doc_id (component null, kept);
    rows that repeat a doc_id are one node; extra columns are not read; an empty table
    gives no rows.
    """
    sigs = stage(sign(docs), "sigs")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # by doc_id, which no two documents share, however many are equal
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "sig"), "text_hash").alias("s"))
    reps = stage(reps.select("doc_id", "s.n_shingles", "s.sig"), "reps")

    light = light_rows(reps)
    regions = light.groupBy("root").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("root")
    regions = stage(regions, "regions")
    held = light.join(bounded_broadcast(regions, regions.count()), "root", "left_semi").groupBy("doc_id").agg(F.collect_list("root").alias("held"))
    crowd = stage(forest_rows(reps.join(held, "doc_id")), "forest")
    joined = links = sets = None
    for trees, best_only in ((FIRST_TREES, True), (TREES, True), (TREES, False)):
        rows = crowd.where(F.col("tree") < trees)
        pairs = neighbours(rows.withColumn("group", F.col("doc_id")) if joined is None else grouped(rows, joined), best_only)
        if best_only:
            pairs = pairs.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("agree", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b")
        found, sets = confirmed(docs, pairs.select("a", "b").distinct(), sets)
        if joined is None or found.take(1):
            links = found if links is None else links.unionByName(found)
            joined = stage(components(links), "groups")
    wide = crowd_links(docs, grouped(crowd, joined), sets)
    if wide is not None and wide.take(1):
        joined = stage(components(links.unionByName(wide)), "groups")

    named = stage(classes.join(joined, F.col("rep") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    linked = meet(full.select("doc_id", "n_shingles", "digest"), named, ["digest"], ["doc_id"]).drop("digest")
    alone = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
