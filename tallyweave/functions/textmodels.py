"""Models of plain text that are learned from a corpus by aggregates: languages and ends of sentences.

Both are fitted by grouping tokens in Spark; the driver gets a model of bounded size (a table of hashed character
n-grams; lists of abbreviations and of words that begin sentences) and puts it into expressions as constants, so texts are read
in place, without a join or Python.

Defined results: null texts have no language and no sentences. Rows without a language take no part in fitting.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let
from tallyweave.scratch import materialize

# --- languages ----------------------------------------------------------------------------


class Profiles(NamedTuple):
    """Log-probabilities of hashed n-grams by language."""

    n: int
    buckets: int
    weights: dict[str, list[float]]


def _letters(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _buckets(word: Column, n: int, buckets: int) -> Column:
    """Hashes of the n-grams of a word with a blank at either end; a shorter one is one n-gram."""
    gram = lambda w, i: F.pmod(F.xxhash64(F.substring(w, i, F.lit(n))), F.lit(buckets)).cast("int")
    return let(F.concat(F.lit(" "), word, F.lit(" ")), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: gram(w, i)))


def fit_profiles(df: DataFrame, *, text: str = "text", language: str = "lang", n: int = 3, buckets: int = 1 << 13) -> Profiles:
    """Learned from the words of all rows: counted first, so a word's n-grams are made once a language."""
    words = df.filter(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.explode(_letters(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("times"))
    grams = words.select("lang", "times", F.explode(_buckets(F.col("word"), n, buckets)).alias("bucket")).groupBy("lang", "bucket").agg(F.sum("times").alias("times"))
    counts: dict[str, dict[int, int]] = {}
    for r in grams.collect():  # a row a language and bucket at most
        counts.setdefault(r["lang"], {})[r["bucket"]] = r["times"]
    weights = {}
    for name, own in sorted(counts.items()):
        total = sum(own.values()) + 0.5 * buckets
        weights[name] = [math.log((own.get(b, 0) + 0.5) / total) for b in range(buckets)]
    return Profiles(n, buckets, weights)


def language_of(text: Column, profiles: Profiles) -> Column:
    """The most likely language; null where the text has no letters; of equally likely ones the last by name."""
    tables = {name: F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>") for name, w in profiles.weights.items()}  # a folded constant
    if not tables:
        return F.lit(None).cast("string")

    def best(grams: Column) -> Column:
        total = lambda table: F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b))
        return F.when(F.size(grams) > 0, F.array_max(F.array(*[F.struct(total(t).alias("score"), F.lit(name).alias("name")) for name, t in tables.items()]))["name"])

    return let(F.flatten(F.transform(_letters(text), lambda w: _buckets(w, profiles.n, profiles.buckets))), best)


# --- ends of sentences --------------------------------------------------------------------

#: Limits from the literature on unsupervised sentence boundaries: an abbreviation's score and a beginning's likelihood ratio.
ABBREVIATION, BEGINNING = 0.3, 30.0


class Boundaries(NamedTuple):
    """Abbreviations without their last point, and words that begin sentences; both in lower case."""

    abbreviations: list[str]
    beginnings: list[str]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


#: Brackets and quotes that close.
_CLOSERS = "\"')]”’»"


def _kind(token: Column) -> Column:
    """A token's word: lower case, without the brackets and quotes around it and a point at its end."""
    return F.rtrim(F.lower(F.rtrim(F.ltrim(token, F.lit("\"'([“‘«")), F.lit(_CLOSERS + ",;:"))), F.lit(".!?"))


def _mark(token: Column) -> Column:
    """The last character before the closing brackets and quotes."""
    return F.right(F.rtrim(token, F.lit(_CLOSERS)), F.lit(1))


def _ratio(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p; 0 times log 0 is 0."""
    part = lambda times, share: F.when(times <= 0, 0.0).otherwise(times * F.log(F.greatest(share, F.lit(1e-300))))
    return part(k, p) + part(n - k, 1 - p)


def fit_boundaries(df: DataFrame, *, text: str = "text", most: int = 20_000) -> Boundaries:
    """Learned from all texts: at most `most` abbreviations and beginnings, those of the highest scores.

    A word is an abbreviation if it stands before a point far more often than words do (likelihood ratio against 0.99), the
    more so the shorter it is, the more points it has inside and the less it stands without a point. A word is
    a beginning if it follows ends of sentences that aren't abbreviations more often than its frequency explains.
    """
    ended = lambda c: c.isin(".", "!", "?")
    follows = lambda t: F.transform(t, lambda x, i: F.struct(x.alias("token"), F.when(ended(_mark(x)), F.get(t, i + 1)).alias("then")))  # noqa: E731  only ends ask what follows
    pairs = df.filter(F.length(F.trim(text)) > 0).select(F.explode(let(_tokens(F.col(text)), follows)).alias("x")).select("x.*")
    pairs = pairs.groupBy("token", "then").agg(F.count("*").alias("times"))  # words are made of different tokens only
    last = _mark(F.col("token"))
    pairs = pairs.select(_kind(F.col("token")).alias("kind"), (last == ".").alias("dot"), last.isin("!", "?").alias("mark"), _kind(F.col("then")).alias("then"), "times")
    counted = materialize(pairs.groupBy("kind", "dot", "mark", "then").agg(F.sum("times").alias("times")), "token-pairs")
    kinds = counted.groupBy("kind").agg(F.sum(F.when(F.col("dot"), F.col("times")).otherwise(0)).alias("k"), F.sum("times").alias("n"))
    whole = kinds.agg(F.sum("k").alias("dots"), F.sum("n").alias("tokens")).first()
    if not whole["tokens"]:
        return Boundaries([], [])
    length = F.length(F.replace("kind", F.lit("."), F.lit("")))
    inner = F.length("kind") - length
    score = -2 * (_ratio(F.col("k"), F.col("n"), F.lit(whole["dots"] / whole["tokens"])) - _ratio(F.col("k"), F.col("n"), F.lit(0.99))) * F.exp(-length) * (inner + 1) * F.pow(length, -(F.col("n") - F.col("k")))
    scored = kinds.filter(F.col("kind").rlike(r"\p{L}") & (F.col("k") > 0)).select("kind", score.alias("score")).filter(F.col("score") >= ABBREVIATION)
    short = sorted(r["kind"] for r in scored.orderBy(F.desc("score"), "kind").limit(most).collect())
    initial = F.col("kind").rlike(r"^\p{L}$") | F.col("kind").rlike(r"^\d")
    ends = counted.withColumn("end", F.col("mark") | (F.col("dot") & ~F.col("kind").isin(short) & ~initial) if short else F.col("mark") | (F.col("dot") & ~initial))
    breaks = ends.filter("end and then is not null").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    after = ends.filter("end and then is not null").groupBy(F.col("then").alias("kind")).agg(F.sum("times").alias("both"))
    a, b, both, n = F.lit(float(breaks)), F.col("n"), F.col("both"), F.lit(float(whole["tokens"]))
    rest = n - a
    gain = -2 * (_ratio(both, a, b / n) + _ratio(b - both, rest, b / n) - _ratio(both, a, both / a) - _ratio(b - both, rest, F.greatest(b - both, F.lit(0)) / F.greatest(rest, F.lit(1.0))))
    begun = after.join(kinds, "kind").filter(F.col("kind").rlike(r"^\p{L}+$") & (both / a > b / n)).select("kind", gain.alias("gain")).filter(F.col("gain") >= BEGINNING)
    return Boundaries(short, sorted(r["kind"] for r in begun.orderBy(F.desc("gain"), "kind").limit(most).collect()))


def sentences(text: Column, known: Boundaries) -> Column:
    """array<string>: a text's sentences, trimmed.

    A sentence ends at white space after ! or ?, and after a point, unless the point belongs to an abbreviation, an initial or
    (before a small letter) a number, and what follows isn't a beginning with a capital. Where no sentence ends, white space is one blank.
    """
    among = lambda c, names: c.isin(names) if names else F.lit(False)

    def open_end(before: Column, then: Column) -> Column:
        last = F.reverse(F.regexp_extract(F.reverse(before), r"(?U)^(\S+)", 1))
        first = F.regexp_extract(then, r"(?U)^(\S+)", 1)
        begins = lambda first: first.rlike(r"^[\"'(\[“‘«]*\p{Lu}") & among(_kind(first), known.beginnings)
        held = lambda kind: among(kind, known.abbreviations) | kind.rlike(r"^\p{L}$") | (kind.rlike(r"^\d+$") & then.rlike(r"^\p{Ll}"))
        return (_mark(before) == ".") & let(_kind(last), held) & ~let(first, begins)

    def whole(pieces: Column) -> Column:
        """Pieces with a blank before those that go on; others with a mark and a line end, at which texts were split, so no piece has them."""
        glued = F.transform(pieces, lambda x, i: F.when(i == 0, x).when(open_end(F.get(pieces, i - 1), x), F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit("!\n"), x)))
        return F.when(F.size(pieces) > 0, F.split(F.array_join(glued, ""), "!\n")).otherwise(F.array().cast("array<string>"))

    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    pieces = F.filter(F.split(bare, r"(?U)(?<=[.!?][\"')\]”’»]?)\s+"), lambda s: s != "")
    return F.when(text.isNotNull(), let(pieces, whole))
