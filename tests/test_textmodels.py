"""Learned languages and sentence ends against plain Python and a labelled fixture."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.functions import checks as C
from tallyweave.functions import textmodels as T
from tallyweave.plans.tables import table

SMALL = [("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("le chat est sur la table", "fr"), ("le chien et le chat", "fr"), (None, "fr"), ("12 34", "en"), ("lost words", None), ("Über die Straße", "de")]


def grams(word, n, buckets):
    s = f" {word} "
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(xxhash.xxh64_intdigest(s[i : i + n].encode(), 42)) % buckets for i in range(max(len(s) - n, 0) + 1)]


def test_profiles_equal_counts_in_python(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(SMALL)], "i int, text string, lang string")
    got = T.fit_profiles(df, n=3, buckets=64)
    counts = {}
    for t, g in SMALL:
        if t and g:
            counts.setdefault(g, Counter()).update(b for w in re.findall(r"[^\W\d_]+", t.lower()) for b in grams(w, 3, 64))
    assert set(got.weights) == set(counts)
    for g, own in counts.items():
        total = sum(own.values()) + 32
        assert got.weights[g] == pytest.approx([math.log((own[b] + 0.5) / total) for b in range(64)])
    told = {r["i"]: r["x"] for r in df.select("i", T.language_of(F.col("text"), got).alias("x")).collect()}
    for i, (t, _) in enumerate(SMALL):
        found = [b for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for b in grams(w, 3, 64)]
        want = max(((sum(got.weights[g][b] for b in found), g) for g in got.weights))[1] if found else None
        assert told[i] == want, t
    assert T.fit_profiles(df.filter("i < 0")).weights == {} and df.select(T.language_of(F.col("text"), T.fit_profiles(df.filter("i < 0"))).alias("x")).first()["x"] is None


def test_held_out_languages(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    held = F.pmod("doc_id", F.lit(4)) == 0
    profiles = T.fit_profiles(d.filter(~held))
    rows = d.filter(held).filter(F.length("text") >= 40).select("lang", T.language_of(F.col("text"), profiles).alias("told")).collect()
    assert len(rows) > 150 and sum(r["lang"] == r["told"] for r in rows) / len(rows) >= 0.97


ABBREVIATED = ["dr", "prof", "etc", "e.g", "mr"]
NOUNS = "cat house river stone garden letter window summer doctor teacher bread morning evening forest mountain road town music picture question".split()


def corpus():
    """Sentences with known ends, among them abbreviations in the middle and before new sentences."""
    texts = []
    for i in range(160):
        a, b, c = NOUNS[i % 20], NOUNS[(i * 7 + 3) % 20], NOUNS[(i * 3 + 5) % 20]
        texts += [[f"We saw Dr. {a.title()} near the {b}.", f"The {c} was there!"], [f"He met Prof. {b.title()} by the {c}.", f"The {a} is old?"], [f"Bring the {a}, the {b} etc. to the {c}.", f"He saw the {c}."], [f"Many things, e.g. the {a} and the {b}, went to the {c}.", f"The {c} was in the {a}."], [f"Mr. {c.title()} had a {a}.", f"We liked the {b}."]]
    return texts


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(corpus())] + [(-1, None), (-2, "  "), (-3, "")], "i int, text string")
    return df, T.fit_boundaries(df)


def test_abbreviations_and_beginnings_are_learned(learned):
    _, known = learned
    assert set(known.abbreviations) == set(ABBREVIATED)
    assert {"the", "he", "we"} & set(known.beginnings) and not set(known.beginnings) & set(NOUNS)


def test_sentences_of_a_labelled_fixture(spark, learned):
    df, known = learned
    got = {r["i"]: r["s"] for r in df.select("i", T.sentences(F.col("text"), known).alias("s")).collect()}
    assert got[-1] is None and got[-2] == [] and got[-3] == []
    assert all(got[i] == want for i, want in enumerate(corpus()))
    plain = {r["i"]: r["s"] for r in df.select("i", C.sentences(F.col("text")).alias("s")).collect()}
    assert sum(plain[i] == want for i, want in enumerate(corpus())) == 0  # every text has an abbreviation
    odd = {"J. Smith came. He left.": ["J. Smith came.", "He left."], "It cost 3. euros and more.": ["It cost 3. euros and more."], "It was 3. Nobody came.": ["It was 3.", "Nobody came."], "Bread, milk etc. The cat slept.": ["Bread, milk etc.", "The cat slept."], 'She said "no." Then  left!': ['She said "no."', "Then  left!"]}
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", T.sentences(F.col("t"), known).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == odd


def test_scores_equal_the_formula_in_python(spark, learned):
    _, known = learned
    kinds = Counter()
    dotted = Counter()
    for t in corpus():
        for token in " ".join(t).split():
            word = re.sub(r"[.!?]+$", "", re.sub(r"[,;:]+$", "", token.lower()))
            kinds[word] += 1
            dotted[word] += token.endswith(".")
    p = sum(dotted.values()) / sum(kinds.values())
    low = lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n > k else 0)
    want = set()
    for w, n in kinds.items():
        k, length = dotted[w], len(w.replace(".", ""))
        if k and re.search("[a-z]", w):
            score = -2 * (low(k, n, p) - low(k, n, 0.99)) * math.exp(-length) * (w.count(".") + 1) * length ** -(n - k)
            want |= {w} if score >= 0.3 else set()
    assert want == set(known.abbreviations)


def test_checks_use_the_models(spark, learned):
    _, known = learned
    df = spark.createDataFrame([("We saw Dr. Cat near the river. The dog was there!",)], "t string")
    asked = {"num_sentences": 3, "relation": "less than"}
    assert df.select(C.passes("length_constraints:number_sentences", "t", boundaries=known, **asked).alias("x")).first()["x"] is True
    assert df.select(C.passes("length_constraints:number_sentences", "t", **asked).alias("x")).first()["x"] is False
    profiles = T.fit_profiles(spark.createDataFrame([(t, g) for t, g in SMALL], "text string, lang string"))
    told = lambda language: df.select(C.passes("language:response_language", "t", profiles=profiles, language=language).alias("x")).first()["x"]
    assert told("en") is True and told("fr") is False
