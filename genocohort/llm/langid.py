"""Language identification by segmentation-marginalised unigrams (operator 3).

A word's probability in a language is the sum, over all its segmentations into pieces of
a fixed public vocabulary, of the product of the pieces' probabilities: a forward
algorithm.  The piece probabilities are fitted by expectation-maximisation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: The fit reads a hash sample of about this many labelled documents, whole.
FIT_ROWS = 4_000
#: Rounds of expectation-maximisation, probability of a character outside the vocabulary, smoothing, characters
#: after which running probabilities are scaled anew.
ROUNDS, UNKNOWN, SMOOTH, STEP = 3, 1e-7, 0.05, 16
#: Distinct words whose scores a task remembers before it starts anew.
WORD_CACHE = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces made of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.removeprefix(_START).isalpha() or p == _START)


def words_of(text: str) -> list[str]:
    """Runs of letters and marks with a letter in them, lower-cased."""
    import regex

    return [w for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()) if w.isalpha() or regex.search(r"\p{L}", w)]


class Lattice:
    """All segmentations of words into pieces, worked on by columns of equally long words."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.power = np.array([pow(int(_BASE), k, 2**64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = (h + np.uint64(ord(c))) * _BASE
        return h

    def prefixes(self, words: list[str]) -> np.ndarray:
        """Hashes of the beginnings of words of one length, a row for each number of characters."""
        codes = np.array([np.frombuffer((_START + w).encode("utf-32-le"), np.uint32) for w in words]).T
        out = np.zeros((len(codes) + 1, len(words)), np.uint64)
        for j, c in enumerate(codes):
            out[j + 1] = (out[j] + c) * _BASE
        return out

    def ends(self, prefix: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Ids (place, longest, words) of the pieces that end at places ``begin`` to ``end`` - 1, the longest first; the id
        n for no piece, n + 1 for an unknown single character."""
        out = np.full((end - begin, self.longest, prefix.shape[1]), self.n)
        for size in range(1, self.longest + 1):
            first = max(begin, size)
            if first >= end:
                break
            h = prefix[first:end] - prefix[first - size : end - size] * self.power[size]
            at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
            out[first - begin :, self.longest - size] = np.where(self.hashes[at] == h, self.order[at], self.n + (size == 1))
        return out

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) for each word of one length and column of ``table`` (pieces, none, unknown) x languages."""
        prefix = self.prefixes(words)
        length, wide = len(prefix) - 1, self.longest
        alpha, scale = np.zeros((wide + STEP, len(words), table.shape[1])), 0.0
        alpha[wide - 1] = 1
        for begin in range(1, length + 1, STEP):
            ids = self.ends(prefix, begin, min(begin + STEP, length + 1))
            for k, pieces in enumerate(ids):
                alpha[wide + k] = (alpha[k : k + wide] * table[pieces]).sum(axis=0)
            alpha[:wide] = alpha[len(ids) : len(ids) + wide].copy()
            if begin + STEP <= length:
                most = alpha[:wide].max(axis=0)
                alpha[:wide] /= most
                scale = scale + np.log(most)
        return np.log(alpha[wide - 1]) + scale

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in words of one length that occur ``counts`` times, under ``p``; in logarithms."""
        prefix, wide = self.prefixes(words), self.longest
        length = len(prefix) - 1
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        alpha = np.full((length + 1 + wide, len(words)), -np.inf)  # place j is row j + wide
        beta, out = np.full_like(alpha, -np.inf), np.zeros(len(p))  # place j is row j
        alpha[wide], beta[length] = 0, 0
        for begin in range(1, length + 1, STEP):
            for k, pieces in enumerate(self.ends(prefix, begin, min(begin + STEP, length + 1)), begin):
                alpha[wide + k] = np.logaddexp.reduce(alpha[k : k + wide] + logs[pieces], axis=0)
        for begin in reversed(range(1, length + 1, STEP)):
            ids = self.ends(prefix, begin, min(begin + STEP, length + 1))
            for k in reversed(range(begin, begin + len(ids))):
                ways = logs[ids[k - begin]] + beta[k]
                seen = np.exp(alpha[k : k + wide] + ways - alpha[wide + length])
                out += np.bincount(ids[k - begin].ravel(), (seen * counts).ravel(), len(p))
                low = max(0, k - wide)
                beta[low:k] = np.logaddexp(beta[low:k], ways[wide - (k - low) :])
        return out


def by_length(words: list[str], most: int = 20_000):
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for ks in groups.values():
        for at in range(0, len(ks), most):
            yield ks[at : at + most]


def fit(docs: DataFrame, vocabulary_path: str, fit_rows: int = FIT_ROWS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, table) from rows with text and lang whose split is not held out.

    The sample is the rows whose doc_id hash lies under a threshold that about ``fit_rows`` of
    the eligible rows meet; whole texts count.  Word counts are made in Spark.  In each round of
    expectation-maximisation the tasks work out the expected counts of their words' pieces and Spark adds them up; the
    driver holds the table of languages by pieces.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    share = min(1.0, fit_rows / max(1, rows.count()))
    rows = rows.where(F.xxhash64("doc_id", F.lit("fit")) <= min(2**63 - 1, int(-(2**63) + share * 2**64)))

    def count(batches):
        from collections import Counter

        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counts = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    pieces = vocabulary(vocabulary_path)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    table = np.full((len(pieces) + 2, len(langs)), 1.0 / len(pieces))
    table[-2:] = [[0.0], [UNKNOWN]]

    def pieces_seen(batches):
        lattice, seen = Lattice(pieces), np.zeros(table.shape)
        for batch in batches:
            of, words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for k, lang in enumerate(langs):
                mine = [i for i, x in enumerate(of) if x == lang]
                for part in by_length([words[i] for i in mine]):
                    at = [mine[i] for i in part]
                    seen[:, k] += lattice.expected([words[i] for i in at], n[at].astype(float), table[:, k])
        # whole numbers of 1 / 2**20, whose sum doesn't depend on the order
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(seen.ravel()[at] * 2**20).astype(np.int64))], names=["at", "n"])

    for _ in range(ROUNDS if langs else 0):
        found = counts.mapInArrow(pieces_seen, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        new = np.zeros(table.size)
        new[[r["at"] for r in found]] = [r["n"] / 2**20 for r in found]
        new = new.reshape(table.shape) + SMOOTH
        table = new / new[:-2].sum(axis=0)
        table[-2:] = [[0.0], [UNKNOWN]]
    drop_stage(counts)
    return langs, pieces, table


def identify(docs: DataFrame, vocabulary_path: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The language of every whole text: ``doc_id, text_hash, held_out, lang_pred, score, n_words, fitness``.

    ``score`` is the posterior probability under equal priors; ``fitness`` the mean log
    probability of a character in that language.  ``und`` with score 0 for null texts and those
    without a letter, or if no labelled row exists.  Ties go to the first language by code
    point.  A null doc_id is not held out and is not fitted on; repeated rows get equal results;
    extra columns are not read.
    """
    langs, pieces, table = fit(docs, vocabulary_path, fit_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("fitness", pa.float64())])

    def run(batches):
        lattice = Lattice(pieces)
        rows: dict[str, int] = {}
        scores = np.empty((0, len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [words_of(t or "") for t in part.column(3).to_pylist()]
                if len(rows) > WORD_CACHE:
                    rows, scores = {}, np.empty((0, len(langs)))
                new = list({w for ws in texts for w in ws if w not in rows})
                if new:
                    made = np.empty((len(new), len(langs)))
                    for ks in by_length(new):
                        made[ks] = lattice.forward([new[k] for k in ks], table)
                    rows.update(zip(new, range(len(rows), len(rows) + len(new))))
                    scores = np.concatenate([scores, made])
                pred, score, n, fitness = [], [], [], []
                for ws in texts:
                    n.append(len(ws))
                    if not ws or not langs:
                        pred.append("und"), score.append(0.0), fitness.append(None)
                        continue
                    total = scores[np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(np.argmax(total))
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
                    fitness.append(float(total[best] / sum(len(w) + 1 for w in ws)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(fitness, pa.float64())], schema=schema)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), held.alias("held_out"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, held_out boolean, lang_pred string, score double, n_words long, fitness double")
