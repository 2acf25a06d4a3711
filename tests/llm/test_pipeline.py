"""The pipeline, against brute force stage by stage."""

import hashlib
import os
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genocohort.llm import langid, mixing
from genocohort.llm.queries import tokenizer_file

from .test_dedup_ops import alike, brute_groups, brute_lines, shingles
from .test_text_ops import WORD, plain_encoding, water

SF = "/root/testdata/sf0.001"


def brute_language(docs, pieces, langs, table):
    """Rows whose best language holds half of the probability, word by word over all segmentations."""
    import numpy as np

    lattice, out = langid.Lattice(pieces), []
    for r in docs:
        words = langid.words_of(r.text or "")
        if words:
            total = sum(lattice.forward([w], table)[0] for w in words)
            if 1 / np.exp(total - total.max()).sum() >= corpus_pipeline.LEAST_SCORE:
                out.append(r)
    return out


def as_rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))


def check_stages(spark, docs):
    """Run each stage on what the one before it kept and hold it against brute force."""
    columns = docs.columns
    fitted = langid.fit(docs, tokenizer_file("piece_bpe_32k.model"))
    kept = corpus_pipeline.language(spark, docs, SF).cache()
    assert kept.columns == columns
    assert Counter(kept.collect()) == Counter(brute_language(docs.collect(), fitted[1], fitted[0], fitted[2]))

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = brute_lines(rows)
    now = corpus_pipeline.lines(spark, kept, SF).cache()
    assert now.columns == columns and all(r.n_chars is None or r.n_chars == len(r.text) for r in now.collect())
    visible = lambda t: t.replace("\n", "").strip(" ")
    assert Counter((r.doc_id, r.text) for r in now.collect() if r.doc_id is not None) == Counter((i, want[i, t]) for i, t in rows if i is not None and visible(want[i, t]))

    rows = now.collect()
    groups = brute_groups({r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}, alike)
    near = corpus_pipeline.near(spark, now, SF).cache()
    assert near.columns == columns
    assert Counter(near.collect()) == Counter(r for r in rows if r.doc_id is None or groups[r.doc_id] == r.doc_id)

    rows = near.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
    target = water(sizes, sorted(sizes, key=lambda s: (s is None, s or "")))
    mix = corpus_pipeline.mix(spark, near, SF).cache()
    taken, of = Counter(), Counter()
    text = defaultdict(list)
    for r in rows:
        text[r.doc_id].append(r.text)
        of[r.doc_id] += 3 * len(WORD.findall(r.text))
    by_doc = Counter()
    for r in mix.collect():
        n = len(WORD.findall(r.text))
        taken[r.source] += n
        by_doc[r.doc_id] += n
        assert any(r.text in t for t in text[r.doc_id]) and (r.n_chars is None or r.n_chars == len(r.text))
    assert mix.columns == columns and all(abs(taken[s] - target[s]) <= 1 for s in sizes) and all(by_doc[i] <= of[i] for i in by_doc)

    enc = plain_encoding()
    want = Counter()
    for r in mix.collect():
        ids = enc.encode_ordinary(r.text)
        want[r.doc_id, tuple(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    last = corpus_pipeline.encode(spark, mix, SF)
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in last.collect()) == want
    return want


def test_stages_on_odd_rows(spark, docs, no_docs):
    odd = docs.withColumn("row", docs.extra).withColumn("gone", docs.extra).withColumn("judged", docs.extra).withColumn("kept", docs.extra)
    for k, name in enumerate(("kept_text", "n_lines", "n_exact", "n_near", "n_kept")):
        odd = odd.withColumn(name, F.concat("extra", F.lit(k)))
    lined = corpus_pipeline.lines(spark, odd, SF)
    assert {(r.kept_text, r.n_lines, r.n_exact, r.n_near, r.n_kept) for r in lined.collect()} == {("x0", "x1", "x2", "x3", "x4")}
    check_stages(spark, odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, no_docs, SF)
        assert empty.columns == no_docs.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_its_stages(spark):
    want = check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    out = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    assert mixing.SHARDS == 16
