"""Embedding near-dedup by navigable small-world graphs per shard (operator 9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, meet, smallest_reachable, stage

#: Link at this cosine or more.
LEAST_COSINE = 0.93
#: Vectors of one label in a shard, links of a vector in a layer, beam while building, first beam of a query,
#: queries of a block that are scanned in full, queries that an audit needs, and the recall it must reach.
SHARD_ROWS, LINKS, BUILD_BEAM, BEAM, SCANNED, AUDITED, LEAST_RECALL = 2_000, 12, 48, 32, 128, 100, 0.99


class Graph:
    """A hierarchy of small-world graphs over unit vectors; layer 0 holds all, each next about
    one in LINKS of the one below."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        u = np.random.Generator(np.random.PCG64(n)).random(n)
        self.level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int), 4)
        self.order = np.argsort(-self.level, kind="stable")
        self.adj = [np.full((n, 2 * LINKS), -1, np.int32) for _ in range(int(self.level.max(initial=0)) + 1)]
        done, size = 0, 64
        while done < n:
            batch = self.order[done : done + size]
            self._insert(batch, done)
            done += len(batch)
            size = min(512, done)

    def _insert(self, batch: np.ndarray, done: int) -> None:
        entry = np.full((len(batch), 1), self.order[0]) if done else None
        own = self.v[batch] @ self.v[batch].T
        np.fill_diagonal(own, -2)
        for layer in range(len(self.adj) - 1, -1, -1):
            here = np.flatnonzero(self.level[batch] >= layer)
            if entry is not None:
                ids, sims = self._beam(self.v[batch], entry, BUILD_BEAM, layer)
                entry = ids[:, :4]
            if not len(here):
                continue
            near = np.argsort(-own[np.ix_(here, here)], axis=1, kind="stable")[:, :BUILD_BEAM]
            cand, sim = batch[here][near], np.take_along_axis(own[np.ix_(here, here)], near, axis=1)
            if entry is not None:
                cand, sim = np.concatenate([cand, ids[here]], axis=1), np.concatenate([sim, sims[here]], axis=1)
            for node, c, s in zip(batch[here], cand, sim):
                keep = self._spread(node, c[s > -1.5], s[s > -1.5], LINKS)
                for other in keep:  # nodes of the same batch may have linked here before
                    self._link(layer, node, other)
                    self._link(layer, other, node)

    def _link(self, layer: int, node: int, new: int) -> None:
        row = self.adj[layer][node]
        if (row == new).any():
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        c = np.append(row, new)
        keep = self._spread(node, c, self.v[c] @ self.v[node], 2 * LINKS - 4)
        row[:] = -1
        row[: len(keep)] = keep

    def _spread(self, node: int, c: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
        """The nearest candidates that are nearer to ``node`` than to one kept before, then the nearest rest."""
        c, first = np.unique(c, return_index=True)
        s = s[first]
        order = np.argsort(-s, kind="stable")[: 4 * most]
        c, s = c[order], s[order]
        if len(c) <= most // 2:
            return c
        between = self.v[c] @ self.v[c].T
        kept, rest = [], []
        for i in range(len(c)):
            (kept if not kept or between[i, kept].max() < s[i] else rest).append(i)
            if len(kept) == most:
                break
        return c[(kept + rest)[:most]]

    def _beam(self, q: np.ndarray, entry: np.ndarray, width: int, layer: int):
        """For each query the ``width`` best vertices of a layer that a best-first walk meets; -1 pads."""
        n, m = len(self.v), len(q)
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -2, np.float32)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)
        for k in range(entry.shape[1]):
            e = entry[:, k]
            ok = (e >= 0) & ~seen[rows, e]
            seen[rows[ok], e[ok]] = True
            ids[ok, k], sims[ok, k] = e[ok], np.einsum("ij,ij->i", self.v[e[ok]], q[ok])
        spent = ids < 0
        while True:
            open_ = np.where(spent, -3, sims)
            best = open_.argmax(axis=1)
            act = np.flatnonzero(open_[rows, best] > -2)
            if not len(act):
                break
            spent[act, best[act]] = True
            nb = self.adj[layer][ids[act, best[act]]].astype(np.int64)
            ok = (nb >= 0) & ~seen[act[:, None], nb]
            seen[np.broadcast_to(act[:, None], nb.shape)[ok], nb[ok]] = True
            s = np.where(ok, np.einsum("ijk,ik->ij", self.v[nb], q[act]), -2).astype(np.float32)
            all_ids, all_s = np.concatenate([ids[act], np.where(ok, nb, -1)], axis=1), np.concatenate([sims[act], s], axis=1)
            all_spent = np.concatenate([spent[act], ~ok], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[act], sims[act], spent[act] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_s, all_spent))
        top = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)

    def unreached(self) -> np.ndarray:
        """Vertices that no link leads to from where walks begin."""
        reached = np.zeros(len(self.v), bool)
        now = self.order[:1]
        reached[now] = True
        while len(now):
            next_ = np.unique(np.concatenate([layer[now].ravel() for layer in self.adj]))
            now = next_[next_ >= 0]
            now = now[~reached[now]]
            reached[now] = True
        return np.flatnonzero(~reached)

    def within(self, q: np.ndarray, least: float, own: bool = False):
        """(query, vertex) index pairs of cosine ``least`` or more; with ``own`` the queries are the
        shard's vectors.

        SCANNED queries, drawn at random, are scanned in full.  Those with a link to another vector are the audit's; where they
        are under AUDITED, perturbed copies of the shard's vectors, whose cosine to them is from ``least`` to 1, make up for the
        rest.  All other queries walk, by beams that widen until each query's beam reaches below ``least`` and the
        audit passes: of the audit's queries that would end here, LEAST_RECALL must have met all of their links, and a
        round in which too few of them end to tell has failed.  A beam as wide as the shard is a full scan.  Vertices that no
        walk can reach are compared with every query.  ``walked`` counts the queries that ended in a walk."""
        rng = np.random.Generator(np.random.PCG64(len(q)))
        q = q.astype(np.float32)
        n, m, floor, self.walked = len(self.v), len(q), least - 1e-4, 0
        todo = rng.permutation(m)
        now, todo = todo[:SCANNED], np.sort(todo[SCANNED:])
        a, b = np.nonzero(q[now] @ self.v.T >= floor)
        found = [(now[a], b)]
        seen = np.bincount(a, minlength=len(now))
        linked = seen > np.bincount(a[now[a] == b], minlength=len(now)) if own else seen > 0
        lost = self.unreached()
        a, b = np.nonzero(q[todo] @ self.v[lost].T >= floor)
        found.append((todo[a], lost[b]))
        short = max(0, AUDITED - int(linked.sum())) if len(todo) else 0
        near = self.v[rng.integers(n, size=short)]
        aside = rng.standard_normal(near.shape).astype(np.float32)
        aside -= np.einsum("ij,ij->i", aside, near)[:, None] * near
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        cos = rng.uniform(least, 1, (short, 1)).astype(np.float32)
        q = np.concatenate([q, cos * near + np.sqrt(1 - cos * cos) * aside])  # planted queries stand behind the own ones
        trial = np.concatenate([now[linked], np.arange(m, m + short)])
        true = np.zeros(len(q), np.int64)
        there = np.delete(self.v, lost, axis=0)
        true[trial] = (q[trial] @ there.T >= floor).sum(axis=1)
        audit = np.zeros(len(q), bool)
        audit[trial] = True
        width = BEAM
        while len(todo):
            if 2 * width >= n:
                a, b = np.nonzero(q[todo] @ self.v.T >= floor)
                new = ~np.isin(b, lost)
                found.append((todo[a[new]], b[new]))
                break
            both = np.concatenate([todo, trial])
            entry = np.full((len(both), 1), self.order[0])
            for layer in range(len(self.adj) - 1, 0, -1):
                entry = self._beam(q[both], entry, 4, layer)[0]
            ids, sims = self._beam(q[both], entry, width, 0)
            hit = sims >= floor
            full = hit[:, -1].copy()
            ends = np.flatnonzero(~full & audit[both])
            if 2 * len(ends) < min(AUDITED, len(trial)) or (hit[ends].sum(axis=1) >= true[both[ends]]).mean() < LEAST_RECALL:
                full[:] = True  # the audit failed: all queries of this round go on with a wider beam
            keep = ~full & ~audit[both]
            a, b = np.nonzero(hit & keep[:, None])
            found.append((both[a], ids[a, b]))
            self.walked += int(keep.sum())
            todo, trial, width = both[full & ~audit[both]], both[full & audit[both]], 4 * width
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links and groups among ``vectors(vec_id, embedding, label)``, within equal labels only.

    Equal vectors of a label form a class with the smallest vec_id for all.  The classes of a label are dealt by
    hash to shards of about ``shard_rows``; a task builds a shard's graph, and every block of queries meets
    every shard of its label in a task of its own.  A task returns counts and a spanning set of its
    links, so a group of n near copies never costs n * n rows.  Use larger shards for larger
    tables: with s shards of a label there are s * s tasks.

    Returns per row ``vec_id, n_links, component_id, kept``.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows with a null label, have 0 links; so has a null vec_id (component
    null, kept).  Rows that repeat a vec_id are rows of one node.  Vectors of different length
    don't link.  Extra columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(fit)
    classes = stage(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    size = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.withColumn("dim", F.size("v")).join(size, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(pdf):
        import pickle

        pdf = pdf.sort_values("rep")
        v = np.stack(pdf["v"].to_list()).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        blob = pickle.dumps((pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), v))
        head = {c: [pdf[c].iloc[0]] for c in ("label", "dim", "shard", "shards")}
        return pd.DataFrame(head | {"data": [blob], "graph": [pickle.dumps(Graph(v).__dict__)]})

    shards = stage(dealt.groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, shard int, shards int, data binary, graph binary"), "graphs")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    left = shards.select("label", "dim", "shard", "graph", F.col("data").alias("base"), every.alias("block"))
    right = shards.select("label", "dim", F.col("shard").alias("block"), F.col("data").alias("queries"), every.alias("shard"))

    def query(frames):
        import pickle

        for pdf in frames:
            for g, base, queries in zip(pdf["graph"], pdf["base"], pdf["queries"]):
                graph = Graph.__new__(Graph)
                graph.__dict__.update(pickle.loads(g))
                (reps, copies, v), (q_reps, _, q) = pickle.loads(base), pickle.loads(queries)
                i, j = graph.within(q, least, len(q_reps) == len(reps) and q_reps[0] == reps[0])
                ok = q_reps[i] != reps[j]
                i, j = i[ok], j[ok]
                cos = np.concatenate([np.einsum("ij,ij->i", q[i[k : k + 8192]], v[j[k : k + 8192]]) for k in range(0, len(i), 8192)] or [np.empty(0)])
                i, j = i[cos >= least], j[cos >= least]
                links = np.bincount(i, copies[j], len(q_reps)).astype(np.int64)
                nodes, low = smallest_reachable(q_reps[i], reps[j])
                yield pd.DataFrame({"a": np.concatenate([q_reps[links > 0], nodes]), "b": np.concatenate([q_reps[links > 0], low]), "n": np.concatenate([links[links > 0], np.zeros(len(nodes), np.int64)])})

    # merged: with a row for each block, a shard's vectors are many times what their file's size says
    met = left.join(right.hint("merge"), ["label", "dim", "shard", "block"]).select("graph", "base", "queries")
    links = stage(met.mapInPandas(query, "a long, b long, n long"), "links")
    counts = links.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    groups = components(links.select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    known = known.select("label", "v", F.col("copies").alias("n"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # facts that hold vectors are too wide to broadcast, few or many
    out = meet(good, stage(known, "known"), ["label", "v"], ["vec_id"], most=0).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
