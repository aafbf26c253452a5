"""Exact corpus counts behind every verdict, whatever is sent to the tasks."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from quarryline.llm import queries, spam

from ..conftest import rows


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "su", "te", "ra") for b in ("n", "r", "st", "l") for c in ("e", "ing", "or", "a")]
    shapes = [[rng.choice(words) for _ in range(9)] for _ in range(40)]
    docs = [" ".join(" ".join(rng.choice(shapes)).capitalize() + "." for _ in range(12)) for _ in range(120)]
    salad = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(4)]
    return [*enumerate(docs), *((500 + k, t) for k, t in enumerate(salad)), (600, "cheap plugin " * 9), (601, "cheap plugin " * 2), (602, ""), (603, None)]


def test_counts_are_exact(spark):
    docs = corpus()
    got = {r.key: r.n for r in spam.corpus_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = Counter()
    raw = spam._hashed([t for _, t in docs if t], spam._Codes())
    want.update(raw[raw >= 0].tolist())
    want.update(k for k, w, v in zip(spam._pairs(raw).tolist(), raw[:-1].tolist(), raw[1:].tolist(), strict=True) if w >= 0 and v >= 0)
    assert got == dict(want)


def test_verdicts_do_not_depend_on_what_is_frequent(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    exact = rows(spam.spam_pages(df))
    assert exact == [(500, "salad"), (501, "salad"), (502, "salad"), (503, "salad"), (600, "keywords")]
    for few in (1, 30, 300):
        monkeypatch.setattr(spam, "FREQUENT_WORDS", few)
        monkeypatch.setattr(spam, "FREQUENT_PAIRS", few)
        assert rows(spam.spam_pages(df)) == exact
        assert rows(spam.spam_pages(df, salad=False)) == [(600, "keywords")]


def test_intervals_hold_the_exact_value():
    rng = np.random.default_rng(1)
    words = rng.zipf(1.3, 4000) % 500
    keys, n = np.unique(np.concatenate([words, spam._pairs(words)]), return_counts=True)
    n_words, n_pairs = len(words), len(words) - 1
    exact = spam.Counts(keys, n, n_words, n_pairs)
    part = spam.Counts(keys[n > 20], n[n > 20], n_words, n_pairs)
    part.rare_word = part.rare_pair = 21
    args = (words[:-1], words[1:], spam._pairs(words))
    (a, b), (low, high) = exact.pmi(*args), part.pmi(*args)
    assert np.allclose(a, b) and (low <= a + 1e-9).all() and (high >= b - 1e-9).all()


def test_mixed_keywords_are_found_and_mixed_passages_are_not(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    docs = [d for d in corpus() if d[0] < 500 and d[1]]
    words = sorted({w for _, t in docs for w in t.lower().replace(".", "").split()})
    page = lambda few, n: " ".join(rng.choice(few) for _ in range(n))
    for k, few in enumerate((10, 20, 30)):
        docs.append((700 + k, page(rng.sample(words, few), 150)))
        docs.append((710 + k, docs[k][1][:200] + "\n" + page(rng.sample(words, few), 150)))
        docs.append((720 + k, page([f"zu{a}{b}x" for a in "bdfgk" for b in "aeiou"][: few - 5], 150)))
    passage = " ".join(t for _, t in docs[:4]).split()
    docs += [(800, " ".join(rng.sample(passage, 90))), (801, " ".join(words))]
    found = [(700 + 10 * a + k,) for a in range(3) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for few in (spam.FREQUENT_WORDS, 1, 30):
        monkeypatch.setattr(spam, "FREQUENT_WORDS", few)
        monkeypatch.setattr(spam, "FREQUENT_PAIRS", few)
        assert rows(queries.p9_found(spark, str(tmp_path))) == found
    assert {r.kind for r in queries.p9_kinds(spark, str(tmp_path)).where("doc_id >= 800").collect()} == {"salad"}
