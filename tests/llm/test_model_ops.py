"""Operators 3, 4, 10 and the pipeline."""

import itertools
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from genocohort.llm import langid, lm_score, urlgraph
from genocohort.llm.common import meet
from genocohort.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    rng = np.random.default_rng(1)
    table = np.concatenate([rng.random((len(pieces), 2)), np.zeros((1, 2)), np.full((1, 2), 1e-7)])
    p = {s: table[i] for i, s in enumerate(pieces)}
    got = langid.Lattice(pieces).forward(["abab", "bbac"], table)

    def total(word):
        w, out = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, cur = [], w[0]
            for c, ch in zip(cuts, w[1:]):
                if c:
                    parts.append(cur)
                    cur = ch
                else:
                    cur += ch
            parts.append(cur)
            out = out + np.prod([p.get(s, table[-1] if len(s) == 1 else table[-2]) for s in parts], axis=0)
        return np.log(out)

    assert np.allclose(got, [total("abab"), total("bbac")])
    seen = langid.Lattice(pieces).expected(["abab"], np.array([2.0]), table[:, 0])
    assert math.isclose(sum(seen[i] * len(s) for i, s in enumerate(pieces)), 2 * 5, rel_tol=1e-9)
    # expected counts are the gradient of the log probability by the logarithms of the pieces' probabilities
    for i in range(len(pieces)):
        up = table[:, :1].copy()
        up[i] *= 1 + 1e-6
        slope = (langid.Lattice(pieces).forward(["abab"], up) - langid.Lattice(pieces).forward(["abab"], table[:, :1])) / 1e-6
        assert math.isclose(2 * slope[0, 0], seen[i], abs_tol=1e-4)
    # text without spaces is segmented whole, however long: pieces may stand across every place
    word = "".join(rng.choice(list("abc"), 700))
    logs = np.full((702, 2), -np.inf)
    logs[0] = 0
    for j in range(1, 702):
        for k in range(1, min(j, 3) + 1):
            piece = ("▁" + word)[j - k : j]
            if piece in p or k == 1:
                logs[j] = np.logaddexp(logs[j], logs[j - k] + np.log(p.get(piece, table[-1])))
    assert np.allclose(langid.Lattice(pieces).forward([word], table)[0], logs[-1])
    seen = langid.Lattice(pieces).expected([word], np.array([1.0]), table[:, 0])
    assert math.isclose(sum(seen[i] * len(s) for i, s in enumerate(pieces)) + seen[-1], 701, rel_tol=1e-9)


def test_fit_equals_plain_expectation_maximisation(spark, docs, rows):
    import zlib

    langs, pieces, table = langid.fit(docs, tokenizer_file("piece_bpe_32k.model"))
    assert langs == ["de", "en"] and max(map(len, pieces)) > 12
    lattice = langid.Lattice(pieces)
    for k, lang in enumerate(langs):
        n = Counter(w for i, t, la, *_ in rows if la == lang and i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2 for w in langid.words_of(t))
        p = np.full(len(pieces) + 2, 1 / len(pieces))
        for _ in range(langid.ROUNDS):
            p[-2:] = 0, langid.UNKNOWN
            p = sum((lattice.expected([w], np.array([c]), p) for w, c in n.items()), np.full(len(p), langid.SMOOTH))
            p /= p[:-2].sum()
        assert np.allclose(p[:-2], table[:-2, k], rtol=1e-3, atol=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    known = [r for r in docs.collect() if got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert len(known) > 20 and np.mean([got[r.doc_id].lang_pred == r.lang for r in known]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(spark, docs, rows, no_docs):
    import zlib

    got = langid.identify(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (500, 501, 502, 505):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
    assert langid.identify(no_docs, tokenizer_file("piece_bpe_32k.model")).count() == 0


def plain_score(text, words, spell, params):
    """One token at a time, in double precision."""
    known = {w: k for k, w in enumerate(words)}
    e, v, b, a, ab, m, mb = (p.astype(float) for p in params)
    parts = (text or "").encode().lower().split()
    ids = lm_score.Words(words, spell).read([text])[0][0]
    total = 0.0
    for k, w in enumerate(parts):
        seen = [e[ids[k + o]] if 0 <= k + o < len(ids) else e[lm_score.PAD] for o in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate(seen) @ v + b)
        z = a @ h + ab
        logs = z - np.log(np.exp(z).sum())
        if w in known:
            c, k = divmod(known[w], lm_score.MEMBERS)
            y = m[c] @ h + mb[c]
            total += logs[c] + y[k] - np.log(np.exp(y).sum())
        else:
            total += logs[-1] + sum(spell[x * 257 + y] for x, y in itertools.pairwise([0, *(x + 1 for x in w), 0]))
    return len(parts), total


def test_words_hold_letters():
    # marks, digits, emoji and signs alone are no words; a mark beside a letter is part of one
    assert [langid.words_of(t) for t in ("\u0301 123", "1 2 3", "\U0001f600!", "", "e\u0301t\u0301 \u0301a", "A1B")] == [[], [], [], [], ["e\u0301t\u0301", "\u0301a"], ["a", "b"]]


def test_vocabulary_and_spelling(docs, rows):
    want = Counter(w for _, t, *_ in rows for w in (t or "").encode().lower().split())
    words, spell, params = lm_score.vocabulary(docs)
    top = sorted(want, key=lambda w: (-want[w], w))
    assert words == top[: lm_score.WORDS] and len(top) > lm_score.WORDS
    # the spelling of words outside the vocabulary is a distribution over what may follow each byte
    letters = np.zeros((257, 257))
    for w in top[lm_score.WORDS :]:
        for x, y in itertools.pairwise([0, *(c + 1 for c in w), 0]):
            letters[x, y] += want[w]
    letters += 1
    assert np.allclose(np.exp(spell.reshape(257, 257)), letters / letters.sum(axis=1, keepdims=True))


def test_scores_equal_one_token_at_a_time(docs, rows, no_docs):
    words, spell, params = lm_score.vocabulary(docs)
    buckets = docs.count() // 20 + 1
    trained = lm_score.fit(lm_score.read_ids(docs, words, spell, buckets), params, buckets)
    assert not np.allclose(trained[0], params[0])
    got = lm_score.score(docs, bucket_rows=20).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got[:40]:
        n, total = plain_score(text[r.doc_id], words, spell, trained)
        assert r.n_tokens == n and math.isclose(r.pll, total, rel_tol=1e-3, abs_tol=1e-3)
    assert [(r.n_tokens, r.pll, r.pll_per_token) for r in got if r.doc_id == 500] == [(0, 0.0, None)]
    assert lm_score.score(no_docs).count() == 0


def test_layout_does_not_change_scores(docs):
    words, spell, params = lm_score.vocabulary(docs)
    layouts = [docs, docs.repartition(2, "text")]
    one, other = (lm_score.fit(lm_score.read_ids(d, words, spell, 5), params, 5) for d in layouts)
    assert all(np.array_equal(x, y) for x, y in zip(one, other))
    one, other = (sorted((str(r.doc_id), r.pll) for r in lm_score.score(d, bucket_rows=20).collect()) for d in layouts)
    assert all(a == b and math.isclose(x, y, rel_tol=1e-6) for (a, x), (b, y) in zip(one, other, strict=True))


def test_rows_that_occur_very_often_fill_several_buckets(spark):
    ids = [np.arange(k + 1).astype(np.int16).tobytes() for k in range(5)]
    rows = [(None, 0, 1, ids[0])] * 95 + [(7, 1, 2, ids[1])] * 11 + [(k, k % 4, k + 1, ids[k]) for k in range(2, 5)] + [(9, 0, 0, b"")] * 30
    df = spark.createDataFrame(rows, "doc_id long, bucket long, n_tokens long, ids binary")
    got = lm_score.lessons(df, 40, most=10).collect()
    assert max(r.times for r in got) <= 10 and len({r.bucket for r in got if r.doc_id is None}) > 5
    total = Counter()
    for r in got:
        total[r.doc_id, bytes(r.ids)] += r.times
    assert total == Counter((i, d) for i, _, n, d in rows if n)
    assert {(r.doc_id, r.bucket, r.times) for r in got if (r.doc_id or 0) in (2, 3, 4)} == {(2, 2, 1), (3, 3, 1), (4, 0, 1)}


def test_averages_of_many_buckets_are_weighted_by_tokens(spark):
    """130 buckets of the same text each train alike, so their average is what one of them learns, over two steps of 64."""
    params = lm_score.fresh(np.arange(50.0), 3.0)
    ids = np.arange(40).astype(np.int16).tobytes()
    rows = spark.createDataFrame([(k, k, 40, ids) for k in range(130)], "doc_id long, bucket long, n_tokens long, ids binary")
    many = lm_score.fit(rows, params, 130, rounds=1)
    one = lm_score.fit(rows.where("bucket = 0"), params, 1, rounds=1)
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(many, one)) and not np.allclose(one[0], params[0])


def test_probabilities_of_all_tokens_sum_to_one():
    rng = np.random.default_rng(2)
    params = [rng.normal(0, 1, p.shape).astype(np.float32) for p in lm_score.fresh(np.arange(50.0), 3.0)]
    tokens = np.arange(lm_score.WORDS + 1).astype(np.int16)
    around = np.broadcast_to(rng.integers(0, lm_score.PAD + 1, 4).astype(np.int16), (len(tokens), 4))
    assert abs(np.exp(lm_score.log_probs(params, tokens, around)).sum() - 1) < 1e-4


def test_training_lowers_the_loss():
    ids = [np.array([3, 90, 270, 2810] * 50, np.int16), np.array([5, 4100] * 80, np.int16)] * 5
    tokens, around = lm_score.windows(ids)
    params = lm_score.fresh(np.zeros(0), 0.0)
    before = lm_score.log_probs(params, tokens, around).mean()
    for _ in range(30):
        lm_score.train(params, [np.full_like(p, 1e-6) for p in params], tokens, around)
    assert lm_score.log_probs(params, tokens, around).mean() > before + 2


PAGES = [
    (1, "http://A.example.com/de/x?q#f", ""), (2, "https://www.example.net/en/1", None), (3, "http://x.net/en/", ""), (4, "http://b.org/fr/a", '<base href="http://Based.com/q/"> <a href="http://good.com/a"><a href=mailto:x@y.net> <img src="i.png">'),
    (5, "http://good.com/1", '<a href="/local"> <a href="http://b.org/">'), (14, "http://based.com/", '<a href="javascript:x()">'), (15, "http://far.com/1", '<a href="http://hub.com/">'), (16, "http://far.com/2", '<a href="http://good.com/">'), (6, "http://hub.com/", '<A HREF=//Bad.net/x> <a href="https://bad.net">'), (7, "http://bad.net/z", ""), (8, None, "<a href='http://bad.net/'>"),
    (9, "nohost", ""), (10, "http://netty.com/de/", ""), (11, "http://net", ""), (12, "http://q.net#a/", ""), (13, "", ""), (1, "http://A.example.com/de/x?q#f", ""), (None, "http://b.org/en/", ""),
]


def brute_urls():
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[k:]
        e = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        return rest[:k].lower(), tail[:e]

    out = []
    for i, u, h in PAGES:
        host, path = parts(u)
        fits = [r for r, _ in urlgraph.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        out.append((i, host, path, rule, h))
    hosts = {h for _, h, *_ in out if h}
    says = dict(urlgraph.RULES)
    part = lambda host, v: np.mean([says.get(r) == v for _, h, _, r, _ in out if h == host]) if host in hosts else 0.0
    links = Counter()
    for _, host, _, _, html in out:
        base = re.search(r"""(?i)<base href=["']?(?:[a-z]+:)?//([^/?#"'\s<>]+)""", html or "")
        for m in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s<>]+)""", html or ""):
            named = re.match(r"(?i)(?:[a-z]+:)?//([^/?#]+)", m)
            to = named[1].lower() if named else None if re.match("[a-z]+:", m) else base[1].lower() if base else host
            if host and to and to != host:
                links[host, to] += 1
    every = sorted(hosts | {d for _, d in links})

    def pagerank(seed, links):
        """The fixed point, as a linear equation over all hosts."""
        n, s = len(every), np.array([seed[h] for h in every])
        a = np.zeros((n, n))
        for (x, y), k in links.items():
            a[every.index(y), every.index(x)] += k
        out = a.sum(axis=0)
        step = np.where(out > 0, a / np.where(out > 0, out, 1), (s / s.sum())[:, None])
        return dict(zip(every, np.linalg.solve(np.eye(n) - 0.85 * step, 0.15 * s)))

    trust = pagerank({h: part(h, "allow") for h in every}, links)
    distrust = pagerank({h: part(h, "block") for h in every}, {(b, a): k for (a, b), k in links.items()})
    rows = Counter((i, h, p, r, says[r] if r else "block" if h and distrust[h] - trust[h] >= 0.5 else "allow") for i, h, p, r, _ in out)
    return rows, trust, distrust


def test_urls_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, host string")
    got = urlgraph.judge_urls(df, settled=1e-4).collect()
    want, trust, distrust = brute_urls()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    for r in got:
        if r.host:
            assert abs(r.trust - trust[r.host]) < 2e-3 and abs(r.distrust - distrust[r.host]) < 2e-3
    assert (6, "hub.com", "/", None, "block") in want and trust["based.com"] > 0 and distrust["far.com"] > 0
    assert urlgraph.judge_urls(df.where("false")).count() == 0




def test_links_and_pages_of_large_hosts_are_dealt(spark, monkeypatch):
    """A hub with links to and from all hosts and a third of all pages gives the same scores, however its rows are dealt."""
    hosts = [f"h{k}.example" for k in range(40)] + ["p.org", "q.net"]
    pages = [(k, f"http://{h}/fr/x", f'<a href="http://hub.com/{k}"> <a href="http://{hosts[k * 7 % 42]}/">') for k, h in enumerate(hosts)]
    pages += [(100 + k, f"http://hub.com/{k % 3}", f'<a href="http://{hosts[k % 42]}/">') for k in range(60)] + [(200 + k, None, None) for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = sorted(tuple(r) for r in urlgraph.judge_urls(df, settled=1e-3).collect())
    asked = []

    def dealt(rows, facts, keys, by):
        asked.append(keys)
        return meet(rows, facts, keys, by, most=0, least=4)

    monkeypatch.setattr(urlgraph, "meet", dealt)
    parts = sorted(tuple(r) for r in urlgraph.judge_urls(df, settled=1e-3, most=4).collect())
    assert asked == [["src", "kind"], ["host"]] and len(whole) == len(pages)
    for x, y in zip(whole, parts, strict=True):
        assert x[:5] == y[:5] and np.allclose(x[5:], y[5:])
    # no rule speaks of the hub: what trust it has came along links
    assert all(r[3] is None and r[5] > 0.05 for r in whole if r[1] == "hub.com")
