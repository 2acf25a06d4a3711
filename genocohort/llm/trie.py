"""Prefix trie of conversations in balanced parentheses (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, stage

#: Turns of a shard, bits of an excess block, bytes of a turn's digest, and ids that one row hands to a digest.
SHARD_TURNS, BLOCK, DIGEST, IDS_A_ROW = 200_000, 64, 16, 1_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


class Parens:
    """Balanced parentheses with the least excess of each block and, above, of each pair of blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        steps = np.where(self.bits, 1, -1).astype(np.int8)
        full = -(-len(bits) // BLOCK)
        self.steps = np.concatenate([steps, np.ones(full * BLOCK - len(bits), np.int8)])  # what is filled up closes nothing
        inside = self.steps.reshape(full, BLOCK).cumsum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], inside[:, -1].cumsum()[:-1]])
        self.least = [inside.min(axis=1) + self.before]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.least.append(low.reshape(-1, 2).min(axis=1))

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Walk from ``at`` to the end of its block; writes the first place of excess ``target`` and returns who found none."""
        lost = []
        while len(at):
            over = at % BLOCK == 0
            lost.append(which[over])
            at, excess, target, which = at[~over], excess[~over], target[~over], which[~over]
            excess = excess + self.steps[at]
            hit = excess == target
            out[which[hit]] = at[hit]
            at, excess, target, which = at[~hit] + 1, excess[~hit], target[~hit], which[~hit]
        return np.concatenate(lost) if lost else which

    def excess_before(self, at: np.ndarray) -> np.ndarray:
        rows = self.steps.reshape(-1, BLOCK).cumsum(axis=1, dtype=np.int64)
        inside = np.where(at % BLOCK > 0, rows[at // BLOCK, at % BLOCK - 1], 0)
        return self.before[at // BLOCK] + inside

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: in its own block, else in the next block that gets so low."""
        target = self.excess_before(opens)
        out = np.full(len(opens), -1, np.int64)
        every = np.arange(len(opens))
        first = (opens + 1) % BLOCK == 0
        rest = np.concatenate([every[first], self._scan(opens[~first] + 1, target[~first] + 1, target[~first], out, every[~first])])
        node, level, want = opens[rest] // BLOCK, np.full(len(rest), -1), target[rest]
        for k, least in enumerate(self.least):  # up: a right neighbour that gets low enough
            climbs = level < 0
            beside = np.minimum(node + 1, len(least) - 1)
            found = climbs & (node % 2 == 0) & (beside > node) & (least[beside] <= want)
            node, level = np.where(found, beside, np.where(climbs, node // 2, node)), np.where(found, k, level)
        for k in range(len(self.least) - 1, 0, -1):  # down: the left half if it does
            here = level == k
            left = np.minimum(2 * node, len(self.least[k - 1]) - 1)
            node = np.where(here, np.where(self.least[k - 1][left] <= want, left, left + 1), node)
            level = np.where(here, k - 1, level)
        at, excess = node * BLOCK, self.before[node]
        hit = excess + self.steps[at] == want
        out[rest[hit]] = at[hit]
        self._scan(at[~hit] + 1, excess[~hit] + self.steps[at[~hit]], want[~hit], out, rest[~hit])
        return out


def shard_nodes(convs: list[int], keys: list[bytes], sizes: list[np.ndarray], before: int, after: int) -> dict[str, list]:
    """The nodes of one shard, whose conversations come in the order of (key, id).

    ``before`` and ``after`` are how many turns the first and the last key share with the neighbouring shards, -1 without
    one.  Nodes up to there get an id, by which shards are merged.  A node counts as a child, a leaf and an
    owner of bytes in the last shard that has it, so that sums over shards count it once.
    """
    lens = np.array([len(k) // DIGEST for k in keys])
    rows, total = len(keys), int(lens.sum())
    marks = np.frombuffer(b"".join(keys), dtype=[("a", "<u8"), ("b", "<u8")])
    offs = np.concatenate([[0], lens.cumsum()])
    row = np.repeat(np.arange(rows), lens)
    j = np.arange(total) - offs[row]
    was = np.concatenate([[0], lens[:-1]])
    there = j < was[row]
    other = np.where(there, offs[np.maximum(row - 1, 0)] + j, 0)
    same = there & (marks["a"] == marks["a"][other]) & (marks["b"] == marks["b"][other]) if total else there
    lcp, some = np.zeros(rows, np.int64), lens > 0
    if total:
        lcp[some] = np.minimum(np.minimum.reduceat(np.where(same, total, j), offs[:-1][some]), lens[some])
    closing, opening = was - lcp, lens - lcp
    runs = np.stack([closing, opening], axis=1).ravel()
    bits = np.concatenate([[True], np.repeat(np.tile([False, True], rows), runs), np.zeros(lens[-1] + 1, bool)])
    tree = Parens(bits)
    opens = tree.opens()
    closes = tree.findclose(opens)
    n = len(opens)
    fresh = np.flatnonzero(j >= lcp[row])
    depth = np.concatenate([[0], j[fresh] + 1])
    own_row = np.concatenate([[0], row[fresh]])
    pre, below = np.arange(n), (closes - opens + 1) // 2
    ends_at = 1 + (closing + opening).cumsum()
    lo, hi = np.searchsorted(ends_at, opens, "right"), np.searchsorted(ends_at, closes, "right")
    members = hi - lo
    ids = np.array([*convs, 0], np.int64)
    least = np.minimum.reduceat(ids, np.stack([lo, hi], axis=1).ravel())[::2]
    # what is shared with a neighbour, and what the shard after this one owns
    last, first = closes >= len(bits) - 1 - lens[-1], pre <= lens[0]
    shared, owned = (first & (depth <= before)) | (last & (depth <= after)), ~(last & (depth <= after))
    # leaf pairs by rank, bytes by cumulative sums
    pairs = tree.bits[:-1] & ~tree.bits[1:]
    pairs[opens[~owned]] = False
    rank = np.concatenate([[0], pairs.cumsum()])
    leaves = rank[closes] - rank[opens]
    weight = np.concatenate(sizes).astype(np.int64) if total else np.zeros(0, np.int64)
    path = np.concatenate([[0], weight.cumsum()])
    own_bytes = np.concatenate([[0], weight[fresh]])
    sums = np.concatenate([[0], (own_bytes * owned).cumsum()])
    whole = path[offs]
    above = np.concatenate([[0], path[fresh] - path[offs[row[fresh]]]])
    saved = whole[hi] - whole[lo] - members * above - (sums[pre + below] - sums[pre])
    # nodes by depth: children are a stretch of the next depth, a parent is the last before it
    by = depth * (n + 1) + pre
    order = np.argsort(by)
    ranked = by[order]
    counted = np.concatenate([[0], owned[order].cumsum()])
    at = lambda d, p: np.searchsorted(ranked, d * (n + 1) + p)
    children = counted[at(depth + 1, pre + below)] - counted[at(depth + 1, pre + 1)]
    parent = np.where(depth > 0, order[np.maximum(at(depth - 1, pre) - 1, 0)], -1)
    opened = 1 + opening.cumsum()
    end_node = order[at(lens, opened) - 1]
    name: dict[int, bytes] = {}
    for nodes, key, most in ((np.flatnonzero(first), keys[0], before), (np.flatnonzero(last), keys[-1], after)):
        digest = hashlib.md5()
        for v in nodes[np.argsort(depth[nodes])].tolist():
            d = int(depth[v])
            if d > most:
                break
            if d:
                digest.update(key[(d - 1) * DIGEST : d * DIGEST])
            name[v] = digest.digest()
    digests, lists = [NO_ENDS] * n, [None] * n
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], end_node])))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), rows], strict=True):
        v = int(end_node[a])
        if shared[v]:
            lists[v] = convs[a:b]
        else:
            digests[v] = hashlib.sha256(",".join(map(str, convs[a:b])).encode()).hexdigest()
    marked = [None, *[keys[r][d * DIGEST - DIGEST : d * DIGEST].hex() for r, d in zip(own_row[1:].tolist(), depth[1:].tolist(), strict=True)]]
    up = parent.tolist()
    return {
        "node_id": [name.get(v) for v in range(n)], "parent_id": [name.get(p) for p in up], "conv_id": least, "depth": depth, "parent_conv_id": [None if p < 0 or shared[p] else int(least[p]) for p in up],
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digests, "turn_md5": marked, "ends": lists,
    }


NODES = "shard int, node_id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_md5 string, ends array<long>"


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns(turn, mark, bytes)``: each conversation's turns in order, as digests of role and text with the text's bytes.

    Turns are ordered by ``turn``, null first, ties by digest.  A null role or text is empty; rows without a conv_id belong
    to no conversation and are left out.  Texts stay where they were read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def replayed(found: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Each conversation begins with the first h turns of the one whose id is the next lower multiple of ``family`` (none if
    that is absent) and goes on with its own after its first h; h is the crc32 of its id modulo ``most + 1``."""
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = found.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.array().cast(found.schema["turns"].dataType)
    rows = found.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common_turns(a: str, b: str) -> Column:
    """Turns that two keys share from the start."""
    n = F.least(F.octet_length(a), F.octet_length(b)) / DIGEST
    one = lambda k, i: F.substring(k, i * DIGEST + 1, F.lit(DIGEST))
    same = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: one(F.col(a), i) == one(F.col(b), i))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n.cast("long"))


def ends_digest(rows: DataFrame) -> DataFrame:
    """``node_id, digest`` of ``rows(node_id, shard, ends)``: ids in the order of shards run through one hash, some at a time."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        node, digest = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch["node_id"], batch["ids"], strict=True):
                name = bytes(name)
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids.tolist())).encode())
            yield pd.DataFrame(done, columns=["node_id", "digest"])
        if node is not None:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node_id", "digest"])

    some = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ends"), F.lit(IDS_A_ROW)), lambda i: F.slice("ends", i, F.lit(IDS_A_ROW)))).alias("place", "ids")
    dealt = rows.where("size(ends) > 0").select("node_id", "shard", some).repartition("node_id").sortWithinPartitions("node_id", "shard", "place")
    return dealt.select("node_id", "ids").mapInPandas(run, "node_id binary, digest string")


def trie(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node of the prefix trie of ``found(conv_id, turns)``, as ``sequences`` makes it.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that need not be stored again below and at the node), ``ends_sha256`` (hash of the ids that end there),
    ``turn_md5`` (digest of the node's last turn; null for the root).

    Conversations are dealt into shards by ranges of (key, id), the key being the digests of the turns, so that a shard's
    trie is a stretch of the whole one and copies of one conversation fill as many shards as they need.  In a
    shard the trie is a string of balanced parentheses; subtrees end at ``findclose``, leaves are ranked pairs, bytes are
    cumulative sums.  Only the nodes on a border's spine are in several shards: their sums are added up, their ids
    hashed in order by one task that holds a hash and a batch.  Each shard's borders are one row of a small table.

    A conversation without turns is a member of the root; an empty table gives no rows.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    rows = stage(found.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")), "sequences")
    total = int(rows.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0])
    shards = max(1, -(-total // shard_turns))
    rows = stage(rows.repartitionByRange(shards, "key", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    order = Window.orderBy("shard")
    border = rows.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    border = border.select("shard", "low", "high", F.lag("high").over(order).alias("was"), F.lead("low").over(order).alias("next"))
    border = border.select("shard", F.when(F.col("was").isNotNull(), common_turns("was", "low")).otherwise(-1).alias("before"), F.when(F.col("next").isNotNull(), common_turns("high", "next")).otherwise(-1).alias("after"))

    def nodes_of(key, part):
        import pandas as pd

        found = sorted(zip(map(bytes, part["key"]), part["conv_id"].tolist(), part["sizes"], strict=True), key=lambda x: x[:2])
        out = shard_nodes([x[1] for x in found], [x[0] for x in found], [x[2] for x in found], int(part["before"].iloc[0]), int(part["after"].iloc[0]))
        frame = pd.DataFrame({k: pd.Series(list(v), dtype=object) if isinstance(v, list) else v for k, v in out.items()})
        return frame.assign(shard=int(key[0]))[[c.split()[0] for c in NODES.split(", ")]]

    nodes = stage(rows.join(border, "shard").groupBy("shard").applyInPandas(nodes_of, NODES), "nodes")
    spine = nodes.where("node_id is not null")
    merged = spine.groupBy("node_id").agg(F.max("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in SUMS], F.max("turn_md5").alias("turn_md5"))
    merged = merged.join(ends_digest(spine), "node_id", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest")
    merged = stage(merged, "spine")
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256", "turn_md5"]
    inner = nodes.where("node_id is null")
    hangs = inner.where("parent_id is not null").drop("parent_conv_id")
    hangs = hangs.select("parent_id", "conv_id", "depth", *SUMS, "ends_sha256", "turn_md5").unionByName(merged.where("parent_id is not null").drop("node_id"))
    hangs = meet(hangs, merged.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), ["parent_id"], ["conv_id", "depth"])
    root = merged.where("parent_id is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = inner.where("parent_id is null").select(*columns).unionByName(hangs.select(*columns)).unionByName(root.select(*columns))
    return out.select("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256", "turn_md5")


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``trie`` of the conversations as they are."""
    return trie(sequences(conversations), shard_turns)
