"""LM scoring by masked pseudo-likelihood with a bidirectional window network (operator 4).

P(token | both sides) = P(class | window) * P(word | class, window) for the words of the vocabulary; the
class of all other words spells them byte by byte, so that every token has a probability of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, drop_stage, stage

#: Size of the network: classes of the vocabulary's words, words in each, endings that stand for other words in a
#: window, words seen on either side, values of an embedding, hidden units.
CLASSES, MEMBERS, ENDINGS, SIDE, EMBED, HIDDEN = 64, 64, 16, 2, 16, 16
WORDS = CLASSES * MEMBERS
PAD = WORDS + ENDINGS
#: Training: documents in a bucket, rounds of averaging (each bucket is trained on in one of them), tokens of a step,
#: step size.
BUCKET_ROWS, ROUNDS, STEP_TOKENS, RATE = 4_000, 2, 8_192, 0.1
#: Distinct words that a task remembers before it starts anew; tokens that it scores at once.
WORD_CACHE, CHUNK = 500_000, 16_384


def pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(neighbouring bytes as before * 257 + after, length + 1 of each word); 0 marks a word's ends."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(flat) + len(words) + 1, np.int64)
    out[np.arange(1, len(flat) + 1) + np.repeat(np.arange(len(words)), size)] = flat.astype(np.int64) + 1
    return out[:-1] * 257 + out[1:], size + 1


def spelling(counts: np.ndarray) -> np.ndarray:
    """log P(next byte or end | byte or start), from counts of pairs and one more of each."""
    table = counts.reshape(257, 257) + 1.0
    return np.log(table / table.sum(axis=1, keepdims=True)).ravel()


class Words(dict):
    """Word (bytes) to its place in ``id`` (what a window sees) and ``spelled`` (log P of other words' letters)."""

    def __init__(self, words: list[bytes], spell: np.ndarray):
        super().__init__()
        self.words, self.spell = words, spell
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update((w, k) for k, w in enumerate(self.words))
        self.new: list[bytes] = []
        self.id, self.spelled = np.arange(len(self.words), dtype=np.int16), np.zeros(len(self.words))

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.new.append(word)
        return found

    def read(self, texts: list) -> list[tuple[np.ndarray, float]]:
        """For each whole text its ids and log P of the letters of its words that are not in the vocabulary."""
        import zlib

        if len(self) > WORD_CACHE:
            self.restart()
        parts = [(t or "").encode().lower().split() for t in texts]
        at = [np.fromiter(map(self.__getitem__, p), np.int64, len(p)) for p in parts]
        if self.new:
            pair, size = pairs(self.new)
            self.spelled = np.append(self.spelled, np.add.reduceat(self.spell[pair], np.cumsum(size) - size))
            self.id = np.append(self.id, np.array([WORDS + zlib.crc32(w.rstrip(b".,;:!?")[-2:]) % ENDINGS for w in self.new], np.int16))
            self.new = []
        return [(self.id[k], float(self.spelled[k].sum())) for k in at]


def fresh(counts: np.ndarray, others: float) -> list[np.ndarray]:
    """Parameters: embeddings, a scale for each place around the token, hidden bias, classes and members of each class
    with their biases, which start at the logarithms of the corpus' counts."""
    rng = np.random.Generator(np.random.PCG64(4))
    freq = np.ones(WORDS)
    freq[: len(counts)] += counts
    freq = freq.reshape(CLASSES, MEMBERS)
    top = np.append(freq.sum(axis=1), 1.0 + others)
    made = [rng.normal(0, 0.3, (PAD + 1, EMBED)), rng.normal(0, 0.2, (2 * SIDE * EMBED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (CLASSES + 1, HIDDEN)), np.log(top / top.sum())]
    made += [rng.normal(0, 0.1, (CLASSES, MEMBERS, HIDDEN)), np.log(freq / freq.sum(axis=1, keepdims=True))]
    return [p.astype(np.float32) for p in made]


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents on end and, for each, the ids around it; PAD beyond the ends."""
    pad = np.full(SIDE, PAD, np.int16)
    line = np.concatenate([x for d in docs for x in (pad, d)] + [pad])
    at = np.flatnonzero(line != PAD)
    return line[at], np.stack([line[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def shares(logits: np.ndarray) -> np.ndarray:
    """Softmax of each column, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


class Pass:
    """Tokens in the order of their class, their windows' embeddings and hidden units, a column for each token."""

    def __init__(self, params, tokens: np.ndarray, around: np.ndarray):
        self.params = params
        own = np.minimum(tokens // MEMBERS, CLASSES)
        self.order = np.argsort(own, kind="stable")
        self.own, self.tokens, self.around = own[self.order], tokens[self.order], around[self.order]
        self.seen = params[0][self.around].reshape(len(tokens), -1)
        self.h = np.tanh(params[1].T @ self.seen.T + params[2][:, None])
        self.every = np.arange(len(tokens))

    def classes(self) -> np.ndarray:
        """P(class) of all classes for each token."""
        return shares(self.params[3] @ self.h + self.params[4][:, None])

    def members(self):
        """For each class of the vocabulary that occurs: class, its tokens' slice, their member, P of all members."""
        ends = np.searchsorted(self.own, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            at = slice(ends[c], ends[c + 1])
            yield c, at, self.tokens[at] - c * MEMBERS, shares(self.params[5][c] @ self.h[:, at] + self.params[6][c][:, None])


def log_probs(params: list[np.ndarray], tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P of each token given both sides, without the letters of words that are not in the vocabulary."""
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), CHUNK):
        now = Pass(params, tokens[at : at + CHUNK], around[at : at + CHUNK])
        p = now.classes()[now.own, now.every]
        for _, part, member, share in now.members():
            p[part] *= share[member, np.arange(len(member))]
        out[at + now.order] = np.log(np.maximum(p, 1e-37))
    return out


def train(params: list[np.ndarray], squares: list[np.ndarray], tokens: np.ndarray, around: np.ndarray) -> None:
    """One pass of Adagrad steps, in place."""
    for at in range(0, len(tokens), STEP_TOKENS):
        now = Pass(params, tokens[at : at + STEP_TOKENS], around[at : at + STEP_TOKENS])
        g = now.classes()
        g[now.own, now.every] -= 1
        back = params[3].T @ g
        members, bias = np.zeros_like(params[5]), np.zeros_like(params[6])
        for c, part, member, gm in now.members():
            gm[member, np.arange(len(member))] -= 1
            members[c], bias[c] = gm @ now.h[:, part].T, gm.sum(axis=1)
            back[:, part] += params[5][c].T @ gm
        back *= 1 - now.h * now.h
        at_, by_place = now.around.T.ravel(), (params[1] @ back).reshape(2 * SIDE, EMBED, -1)
        seen = np.stack([np.bincount(at_, by_place[:, d].ravel(), PAD + 1) for d in range(EMBED)], axis=1)
        for p, s, d in zip(params, squares, (seen, now.seen.T @ back.T, back.sum(axis=1), g @ now.h.T, g.sum(axis=1), members, bias)):
            d = d.astype(np.float32) / len(now.own)
            s += d * d
            p -= RATE * d / (np.sqrt(s) + 1e-6)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words of all documents."""

    def count(batches):
        from collections import Counter

        found: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return got

        for batch in batches:
            for text in batch.column(0):
                found.update((text.as_py() or "").encode().lower().split())
                if len(found) > WORD_CACHE:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(counts: DataFrame, words: list[bytes]) -> tuple[np.ndarray, int]:
    """(counts of neighbouring bytes in the words outside ``words``, how often such words occur)."""

    def run(batches):
        known, total, n_all = set(words), np.zeros(257 * 257), 0
        for batch in batches:
            rest = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in known]
            if rest:
                n = np.array([x for _, x in rest], np.int64)
                pair, size = pairs([w for w, _ in rest])
                total += np.bincount(pair, np.repeat(n, size), 257 * 257)
                n_all += int(n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n_all).astype(np.int64))], names=["pair", "n"])

    found = {r["pair"]: r["n"] for r in counts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    out = np.zeros(257 * 257)
    others = found.pop(-1, 0)
    out[list(found)] = list(found.values())
    return out, others


def vocabulary(docs: DataFrame) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(words of the vocabulary, spelling of the others, parameters to start from), from counts over all documents."""
    counts = stage(word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    words = [bytes(r["word"]) for r in top]
    letters, others = letter_counts(counts, words)
    drop_stage(counts)
    return words, spelling(letters), fresh(np.array([r["n"] for r in top], float), others)


def read_ids(docs: DataFrame, words: list[bytes], spell: np.ndarray, buckets: int) -> DataFrame:
    """``doc_id, bucket, n_tokens, spelled, ids`` of every row: what training and scoring read."""
    schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int64()), ("n_tokens", pa.int64()), ("spelled", pa.float64()), ("ids", pa.binary())])

    def run(batches):
        known = Words(words, spell)
        for batch in batches:
            made = known.read(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(i) for i, _ in made], pa.int64()), pa.array([s for _, s in made], pa.float64()), pa.array([i.tobytes() for i, _ in made], pa.binary())], schema=schema)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id", text), F.lit(buckets)).cast("long").alias("bucket"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, bucket long, n_tokens long, spelled double, ids binary")


def chunks(ids: Iterable[np.ndarray], most: int = 65_536):
    """Lists of documents of about ``most`` tokens; a longer document is a list of its own."""
    held, n = [], 0
    for d in ids:
        held.append(d)
        n += len(d)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def lessons(rows: DataFrame, buckets: int, most: int = BUCKET_ROWS) -> DataFrame:
    """``bucket, doc_id, ids, times``: what each bucket trains on, ``times`` times over.

    Rows hash to buckets by doc_id and text, so that rows equal in both would all meet in one.  Those that occur more than ``most``
    times (fewer keys than buckets) are counted instead, and their number is shared among as many buckets as they fill.
    """
    known = rows.where("n_tokens > 0").select("bucket", "doc_id", "ids", F.lit(1).cast("long").alias("times"), F.xxhash64("doc_id", "ids").alias("key"))
    often = stage(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "often")
    if not (n := often.count()):
        return known.drop("key")
    often = bounded_broadcast(often, n)
    counted = known.join(often, "key", "left_semi").groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / most)
    counted = counted.select("doc_id", "ids", "n", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    times = F.floor(F.col("n") / F.col("parts")) + (F.col("part") < F.col("n") % F.col("parts")).cast("long")
    shared = counted.select(F.pmod(F.xxhash64("doc_id", "ids", "part"), F.lit(buckets)).cast("long").alias("bucket"), "doc_id", "ids", times.alias("times"))
    return known.join(often, "key", "left_anti").drop("key").unionByName(shared)


def fit(rows: DataFrame, params: list[np.ndarray], buckets: int, rounds: int = ROUNDS, most: int = BUCKET_ROWS) -> list[np.ndarray]:
    """The parameters after training on every row of ``rows`` once.

    Each round trains its share of the buckets, each on its own from the common parameters, and averages the
    results by tokens in Spark, 64 at a time, until one is left; the driver holds one set of parameters.  Buckets are
    made by hash and read in the order of doc_id, so the layout of the table changes nothing.
    """
    shapes, size, wide = [p.shape for p in params], 2048, 64

    def local(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "ids", "times"], na_position="first")
        own, n = [p.copy() for p in params], 0
        squares = [np.full_like(p, 1e-6) for p in own]
        repeated = (x for ids, times in zip(pdf["ids"], pdf["times"]) for x in [np.frombuffer(ids, np.int16)] * times)
        for part in chunks(repeated):
            tokens, around = windows(part)
            train(own, squares, tokens, around)
            n += len(tokens)
        values = np.concatenate([p.ravel() for p in own])
        blocks = [values[i : i + size] for i in range(0, len(values), size)]
        return pd.DataFrame({"block": range(len(blocks)), "at": int(pdf["bucket"].iloc[0]) // rounds, "n": n, "v": blocks})

    def average(pdf):
        import pandas as pd

        pdf = pdf.sort_values("at")
        w = pdf["n"].to_numpy(float)
        v = np.average(np.stack(pdf["v"].to_list()).astype(float), axis=0, weights=w)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "at": pdf["at"].iloc[:1] // wide, "n": [int(w.sum())], "v": [v.astype(np.float32)]})

    kind = "block int, at long, n long, v array<float>"
    taught = lessons(rows, buckets, most)
    for k in range(rounds):
        trained = taught.where(F.col("bucket") % rounds == k).groupBy("bucket").applyInPandas(local, kind)
        left = buckets // rounds + 1
        while left > 1:
            trained = trained.groupBy("block", F.floor(F.col("at") / wide)).applyInPandas(average, kind)
            left = -(-left // wide)
        found = trained.collect()
        if found:
            values = np.concatenate([np.array(r["v"], np.float32) for r in sorted(found, key=lambda r: r["block"])])
            ends = np.cumsum([int(np.prod(s)) for s in shapes])
            params = [v.reshape(s) for v, s in zip(np.split(values, ends[:-1]), shapes)]
    return params


def score(docs: DataFrame, rounds: int = ROUNDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The masked pseudo-log-likelihood of every whole text of ``docs(doc_id, text)``.

    The vocabulary, the start of the network and the spelling of other words come from counts over all
    documents, and every document is trained on.  Texts are read once into ids, which training and scoring share.

    Returns ``doc_id, n_tokens, pll`` (sum over all tokens of log P(token | the two words on each
    side)) and ``pll_per_token``.  Null and blank texts have 0 tokens, pll 0.0 and a null mean; a null doc_id stays
    null; repeated rows get equal results; extra columns are not read; an empty table gives no rows.
    """
    words, spell, params = vocabulary(docs)
    buckets = docs.count() // bucket_rows + 1
    rows = stage(read_ids(docs, words, spell, buckets), "ids")
    params = fit(rows, params, buckets, rounds, bucket_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("pll", pa.float64()), ("pll_per_token", pa.float64())])

    def run(batches):
        for batch in batches:
            ids, n = [np.frombuffer(x, np.int16) for x in batch.column(3).to_pylist()], batch.column(1).to_numpy()
            found = [np.empty(0)]
            for part in chunks(ids):
                if sum(map(len, part)):
                    found.append(log_probs(params, *windows(part)))
            sums = np.bincount(np.repeat(np.arange(len(ids)), n), np.concatenate(found), len(ids)) + batch.column(2).to_numpy()
            mean = [s / k if k else None for s, k in zip(sums.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums), pa.array(mean, pa.float64())], schema=schema)

    return rows.select("doc_id", "n_tokens", "spelled", "ids").mapInArrow(run, "doc_id long, n_tokens long, pll double, pll_per_token double")
