import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import queries, ranking
from tallyweave.llm.common import table

DOCS = "doc_id long, text string, item_id int, rank string"
ITEMS = "item_id long, text string, doc_id string"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return _WORD.findall((text or "").translate(_FOLD))


def brute(docs, items, k=20):
    """(item_id, rank, score) and the documents of each (item, score), by the formula alone."""
    own = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            n = sum(c.values())
            score = 0
            for w in words(text):
                if c[w]:
                    m = 75 + (25 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def shown(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_equals_the_formula(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert shown(queries.op13_maxscore(spark, sf)) == sorted(brute(docs, items), key=str)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 8)
    monkeypatch.setattr(ranking, "POSTINGS", 5)
    monkeypatch.setattr(ranking, "SEED", 2)
    docs = [
        (1, "the Cat, the dog", 0, ""), (1, "the Cat, the dog", 0, ""), (2, None, 0, ""), (3, "", 0, ""), (None, "cat ÉCLAIR", 0, ""), (4, "cat cat cat " * 50 + "x" * 90, 0, ""),
        (5, "Éclair éclair 漢字 cat's", 0, ""), (6, "...", 0, ""), (7, "K kelvin K", 0, ""), (8, "dog a1 A1", 0, ""),
    ]
    items = [(1, "Cat dog cat", "a"), (1, "éclair", "b"), (None, "A1 the", "c"), (2, None, "d"), (3, "absent", "e"), (4, "k " + "x" * 90, "f"), (5, "漢字 K", "g")]
    got = shown(ranking.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k=3))
    assert got == sorted(brute([d[:2] for d in docs], [i[:2] for i in items], 3), key=str)
    monkeypatch.setattr(ranking, "QUERY_TERMS", 2)  # a block a query
    assert shown(ranking.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=3)) == got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 0, "")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert ranking.rank_documents(docs.filter("doc_id is null"), items).collect() == []
    assert ranking.rank_documents(docs, items.filter("item_id is null")).collect() == []
    assert shown(ranking.rank_documents(docs, items)) == brute([(1, "a")], [(1, "a")])


@pytest.mark.parametrize("seed", range(4))
def test_shards_skip_postings_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    docs, terms, k = 4000, 60, 10
    share = rng.random(terms) ** 3
    has = rng.random((docs, terms)) < share
    owners, which = np.nonzero(has)
    scores = np.floor(1000 * np.log((2 * docs + 2) / (2 * has.sum(0) + 1)))[which].astype(np.int64) * rng.integers(100, 110, len(which))
    shard = ranking.Shard(np.arange(docs), owners, which, scores)
    full = np.zeros((docs, terms), np.int64)
    full[owners, which] = scores
    read = whole = 0
    for _ in range(30):
        own = np.sort(rng.choice(terms + 5, 12, replace=False))
        repeats = rng.integers(1, 3, 12)
        total = full[:, own[own < terms]] @ repeats[own < terms]
        want = sorted(zip(-total, range(docs), strict=True))[:k]
        for least in (0, int(-want[-1][0])):
            got, at, n = shard.search(own, repeats, k, least)
            assert set(zip((-got).tolist(), at.tolist(), strict=True)) >= {(int(s), i) for s, i in want if s < 0}
            assert got.tolist() == total[at].tolist()
            if least:
                read, whole = read + n, whole + int(has[:, own[own < terms]].sum())
    assert read < 0.5 * whole  # with the threshold known


def test_terms_of_long_texts():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("aB1 é.漢\n"), 5000))
    plain = Counter(w.encode() for w in words(text))
    assert ranking.term_counts(text.encode()) == plain
    ranking.CHUNK, kept = 7, ranking.CHUNK
    try:
        assert ranking.term_counts(text.encode()) == plain
    finally:
        ranking.CHUNK = kept
