"""Instruction checks: 54 predicates over a response, by id, as built-in expressions.

A check is a function of the response and a lookup of its arguments, which are columns, so one
plan serves constants and arguments that differ from row to row. An argument that is not given
makes a check that needs it null, which counts as failed. Responses of null fail.

Words are runs of word characters, or else single signs. Sentences and languages are found by models learned from a corpus
(`textmodels`) where they are given; else a sentence ends at . ! or ? before white space, and the language is told by
common short words of English, French, German and Spanish, and a response that has none of them passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import textmodels
from tallyweave.functions.arrays import let
from tallyweave.functions.textmodels import Boundaries, Profiles

Check = Callable[[Column, "Get"], Column]
CHECKS: dict[str, Check] = {}

#: The answers of the constrained-response check, and dividers between parts.
CONSTRAINED = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
STARS, SIX_STARS = r"(?U)\s?\*\*\*\s?", "******"
#: Short words that tell a language.
COMMON = {
    "en": "the|and|of|to|is|in|that|it|for|with",
    "fr": "le|la|les|des|et|est|une|dans|pour|que",
    "de": "der|die|und|das|ist|nicht|ein|mit|zu|von",
    "es": "el|los|las|que|una|por|con|para|del|es",
}


def check(*ids: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        for i in ids:
            CHECKS[i] = f
        return f

    return add


def strip(c: Column) -> Column:
    """Without white space, of any alphabet, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def bare(c: Column) -> Column:
    """A word in lower case without the punctuation around it."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\p{Punct}]+|[\p{Punct}]+$", ""))


def count(c: Column, pattern: str | Column) -> Column:
    return F.regexp_count(c, F.lit(pattern) if isinstance(pattern, str) else pattern)


def related(n: Column, limit: Column, relation: Column) -> Column:
    """n < limit for "less than", n >= limit for "at least"."""
    return F.when(relation == "less than", n < limit.cast("int")).when(relation == "at least", n >= limit.cast("int"))


def parts(c: Column, divider: str) -> tuple[Column, Column]:
    """(number of parts without an empty first or last one, whether an inner one is empty)."""
    p = F.transform(F.split(c, divider), strip)
    n = F.size(p)
    ends = F.when(p[0] == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    inner = F.exists(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), lambda x: x == "")
    return n - ends, inner


def anycase(pattern: Column) -> Column:
    return F.concat(F.lit("(?i)"), pattern)


def listed(c: Column) -> Column:
    """Items of an argument that holds several, separated by commas or as a JSON list."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r'^\s*\[|\]\s*$|"', ""), ","), strip), lambda x: x != "")


class Get:
    """Looks an argument of a check up, and has the ways to find sentences and to tell a language.

    With models learned from a corpus these are used in place of the simple rules; a text whose language a
    model can't tell passes.
    """

    def __init__(self, argument: Callable[[str], Column], profiles: Profiles | None = None, boundaries: Boundaries | None = None):
        self.argument, self.profiles, self.boundaries = argument, profiles, boundaries

    def __call__(self, name: str) -> Column:
        return self.argument(name)

    def sentences(self, c: Column) -> Column:
        return sentences(c) if self.boundaries is None else textmodels.sentences(c, self.boundaries)

    def language_is(self, c: Column, language: Column) -> Column:
        return language_is(c, language) if self.profiles is None else F.coalesce(textmodels.language_of(c, self.profiles) == language, F.lit(True))


def language_is(c: Column, language: Column) -> Column:
    votes = [F.struct(count(F.lower(c), rf"(?U)\b({w})\b").alias("n"), F.lit(name).alias("name")) for name, w in COMMON.items()]
    best = F.array_max(F.array(*votes))
    return (best["n"] == 0) | (best["name"] == language)


@check("keywords:existence")
def _(c: Column, get: Get) -> Column:
    return F.forall(listed(get("keywords")), lambda k: F.regexp_like(c, anycase(k)))


@check("keywords:frequency", "keywords:word_count_different_numbers")
def _(c: Column, get: Get) -> Column:
    return related(count(c, anycase(get("keyword"))), get("frequency"), get("relation"))


@check("keywords:forbidden_words")
def _(c: Column, get: Get) -> Column:
    return F.forall(listed(get("forbidden_words")), lambda k: ~F.regexp_like(c, F.concat(F.lit(r"(?iU)\b"), k, F.lit(r"\b"))))


@check("keywords:letter_frequency", "letters:letter_counting2")
def _(c: Column, get: Get) -> Column:
    low = F.lower(c)
    return related(F.length(low) - F.length(F.replace(low, F.lower(get("letter")), F.lit(""))), get("let_frequency"), get("let_relation"))


@check("language:response_language")
def _(c: Column, get: Get) -> Column:
    return get.language_is(c, get("language"))


@check("length_constraints:number_sentences")
def _(c: Column, get: Get) -> Column:
    return related(F.size(get.sentences(c)), get("num_sentences"), get("relation"))


@check("length_constraints:number_paragraphs")
def _(c: Column, get: Get) -> Column:
    n, hole = parts(c, STARS)
    return ~hole & (n == get("num_paragraphs").cast("int"))


@check("length_constraints:number_words")
def _(c: Column, get: Get) -> Column:
    return related(count(c, r"(?U)\w+"), get("num_words"), get("relation"))


@check("length_constraints:nth_paragraph_first_word")
def _(c: Column, get: Get) -> Column:
    p = F.transform(F.split(c, r"\n\n"), strip)
    full = F.size(F.filter(p, lambda x: x != ""))
    nth = get("nth_paragraph").cast("int")
    own = F.when((nth >= 1) & (nth <= full), F.get(p, nth - 1))
    first = F.lower(F.regexp_extract(F.regexp_replace(words(own)[0], r"^['\"]+", ""), r"^[^.,?!'\"]*", 0))
    return F.coalesce((full == get("num_paragraphs").cast("int")) & (own != "") & (first == F.lower(get("first_word"))), F.lit(False))


@check("detectable_content:number_placeholders")
def _(c: Column, get: Get) -> Column:
    return count(c, r"\[.*?\]") >= get("num_placeholders").cast("int")


@check("detectable_content:postscript")
def _(c: Column, get: Get) -> Column:
    mark = get("postscript_marker")
    pattern = F.when(mark == "P.P.S", r"(?m)\s*p\.\s?p\.\s?s.*$").when(mark == "P.S.", r"(?m)\s*p\.\s?s\..*$").otherwise(F.concat(F.lit(r"(?m)\s*"), F.lower(mark), F.lit(".*$")))
    return F.regexp_like(F.lower(c), pattern)


@check("detectable_format:number_bullet_lists")
def _(c: Column, get: Get) -> Column:
    return count(c, r"(?m)^\s*\*[^\*].*$") + count(c, r"(?m)^\s*-.*$") == get("num_bullets").cast("int")


@check("detectable_format:constrained_response")
def _(c: Column, get: Get) -> Column:
    return c.contains(CONSTRAINED[0]) | c.contains(CONSTRAINED[1]) | c.contains(CONSTRAINED[2])


@check("detectable_format:number_highlighted_sections")
def _(c: Column, get: Get) -> Column:
    one = F.filter(F.regexp_extract_all(c, F.lit(r"\*[^\n\*]*\*"), F.lit(0)), lambda x: strip(F.replace(x, F.lit("*"), F.lit(""))) != "")
    two = F.filter(F.regexp_extract_all(c, F.lit(r"\*\*([^\n\*]*)\*\*"), F.lit(1)), lambda x: strip(x) != "")
    return F.size(one) + F.size(two) >= get("num_highlights").cast("int")


@check("detectable_format:multiple_sections")
def _(c: Column, get: Get) -> Column:
    return count(c, F.concat(F.lit(r"\s?"), get("section_spliter"), F.lit(r"\s?\d+\s?"))) >= get("num_sections").cast("int")


@check("detectable_format:json_format")
def _(c: Column, get: Get) -> Column:
    inner = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?i:json)?", ""), r"```$", ""))
    return F.try_parse_json(inner).isNotNull()


@check("detectable_format:title")
def _(c: Column, get: Get) -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(r"<<([^\n]+)>>"), F.lit(1)), lambda x: strip(F.regexp_replace(x, r"^<+|>+$", "")) != "")


@check("combination:two_responses")
def _(c: Column, get: Get) -> Column:
    p = F.transform(F.split(c, r"\*\*\*\*\*\*"), strip)
    n = F.size(p)
    inner = F.exists(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), lambda x: x == "")
    full = F.filter(p, lambda x: x != "")
    return ~inner & (F.size(full) == 2) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))


@check("combination:repeat_prompt")
def _(c: Column, get: Get) -> Column:
    return F.startswith(F.lower(strip(c)), F.lower(strip(get("prompt_to_repeat"))))


@check("startend:end_checker")
def _(c: Column, get: Get) -> Column:
    return F.endswith(F.lower(F.regexp_replace(strip(c), r'^"+|"+$', "")), F.lower(strip(get("end_phrase"))))


@check("change_case:capital_word_frequency")
def _(c: Column, get: Get) -> Column:
    n = F.size(F.filter(word_tokens(c), lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    return related(n, get("capital_frequency"), get("capital_relation"))


@check("change_case:english_capital")
def _(c: Column, get: Get) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c) & get.language_is(c, F.lit("en"))


@check("change_case:english_lowercase")
def _(c: Column, get: Get) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c) & get.language_is(c, F.lit("en"))


@check("punctuation:no_comma")
def _(c: Column, get: Get) -> Column:
    return ~c.contains(",")


@check("startend:quotation")
def _(c: Column, get: Get) -> Column:
    s = strip(c)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


@check("copy:repeat_phrase")
def _(c: Column, get: Get) -> Column:
    phrase = words(get("phrase"))
    found = F.regexp_extract_all(c, F.concat(phrase[0], F.lit(" .*? "), F.element_at(phrase, -1)), F.lit(0))
    differ = F.transform(found, lambda f: F.size(F.filter(F.arrays_zip(words(f).alias("a"), phrase.alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"]))))
    same = F.forall(found, lambda f: F.size(words(f)) == F.size(phrase)) & F.forall(differ, lambda d: d <= 1)
    return (F.size(found) == get("small_n").cast("int")) & same & (F.get(differ, F.size(differ) - 1) == 1)


@check("copy:copy", "copy:copying_simple")
def _(c: Column, get: Get) -> Column:
    return F.lower(strip(c)) == F.lower(strip(get("prompt_to_repeat")))


@check("new:copy_span_idx")
def _(c: Column, get: Get) -> Column:
    a, b = get("n_start").cast("int"), get("n_end").cast("int")
    return F.lower(strip(c)) == F.lower(strip(F.substring(get("prompt_to_repeat"), a + 1, b - a)))


@check("detectable_format:sentence_hyphens")
def _(c: Column, get: Get) -> Column:
    own = F.split(c, "-")
    gold = get.sentences(F.regexp_replace(c, "-", " "))
    n = F.least(F.size(own), F.size(gold))
    return F.forall(F.arrays_zip(F.slice(own, F.lit(1), n).alias("a"), F.slice(gold, F.lit(1), n).alias("b")), lambda z: z["a"] == z["b"])


@check("keywords:no_adjacent_consecutive")
def _(c: Column, get: Get) -> Column:
    code = F.transform(words(c), lambda w: F.ascii(F.lower(F.left(w, F.lit(1)))))
    pairs = F.zip_with(code, F.slice(code, 2, F.greatest(F.size(code), F.lit(1))), lambda a, b: F.coalesce(b - a, F.lit(0)))
    return F.forall(pairs, lambda d: d != 1)


@check("detectable_format:square_brackets")
def _(c: Column, get: Get) -> Column:
    return F.forall(words(c), lambda w: w.startswith("[") & w.endswith("]"))


@check("keywords:word_once")
def _(c: Column, get: Get) -> Column:
    return count(c, anycase(get("keyword"))) == 1


@check("keywords:exclude_word_harder")
def _(c: Column, get: Get) -> Column:
    return ~F.contains(c, F.concat(F.lit(" "), get("keyword"), F.lit(" ")))


@check("paragraphs:paragraphs")
def _(c: Column, get: Get) -> Column:
    n, hole = parts(c, STARS)
    return ~hole & (n == 2)


@check("paragraphs:paragraphs2")
def _(c: Column, get: Get) -> Column:
    n, hole = parts(c, r"\n\n")
    return ~hole & (n == 2)


@check("first_word:first_word_sent")
def _(c: Column, get: Get) -> Column:
    return F.forall(get.sentences(c), lambda s: F.lower(F.get(words(s), F.lit(0))) == F.lower(get("first_word")))


@check("first_word:first_word_answer")
def _(c: Column, get: Get) -> Column:
    return F.lower(F.get(words(c), F.lit(0))) == F.lower(get("first_word"))


@check("last_word:last_word_sent")
def _(c: Column, get: Get) -> Column:
    return F.forall(get.sentences(c), lambda s: bare(F.get(words(s), F.size(words(s)) - 1)) == F.lower(get("last_word")))


@check("last_word:last_word_answer")
def _(c: Column, get: Get) -> Column:
    return bare(F.get(words(c), F.size(words(c)) - 1)) == F.lower(get("last_word"))


@check("detectable_format:bigram_wrapping")
def _(c: Column, get: Get) -> Column:
    w = words(c)
    pairs = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.get(w, i + 1).alias("b"))), lambda z: (z["i"] % 2 == 0) & z["b"].isNotNull())
    return F.forall(pairs, lambda z: z["a"].startswith("<<") & z["b"].endswith(">>"))


@check("copy:copying_multiple")
def _(c: Column, get: Get) -> Column:
    p = F.split(c, r"\*\*\*\*\*\*")
    want = F.lower(strip(get("prompt_to_repeat")))
    return (F.size(p) == get("N").cast("int")) & F.forall(p, lambda x: F.lower(strip(x)) == want)


@check("punctuation:punctuation_dot")
def _(c: Column, get: Get) -> Column:
    return ~c.contains(".")


@check("punctuation:punctuation_exclamation")
def _(c: Column, get: Get) -> Column:
    return ~c.contains("!")


@check("count:lowercase_counting")
def _(c: Column, get: Get) -> Column:
    return count(c, r"\b[a-z]+\b") <= get("N").cast("int")


@check("letters:letter_counting")
def _(c: Column, get: Get) -> Column:
    return related(count(c, "[a-zA-Z]"), get("N"), get("relation"))


@check("count:counting_composition")
def _(c: Column, get: Get) -> Column:
    n, hole = parts(c, STARS)
    full = F.filter(F.transform(F.split(c, STARS), strip), lambda x: x != "")
    even = F.forall(full, lambda p: (F.size(get.sentences(p)) == get("n_sent").cast("int")) & F.forall(get.sentences(p), lambda s: F.size(word_tokens(s)) == get("n_words").cast("int")))
    return ~hole & (n == 3) & even


@check("count:count_unique")
def _(c: Column, get: Get) -> Column:
    return F.size(word_tokens(c)) == F.size(F.array_distinct(word_tokens(c)))


@check("count:count_increment_word")
def _(c: Column, get: Get) -> Column:
    return (count(c, anycase(get("keyword1"))) == 1) & (count(c, anycase(get("keyword2"))) == 2)


@check("keywords:palindrome")
def _(c: Column, get: Get) -> Column:
    return F.exists(words(c), lambda w: F.reverse(w) == w)


@check("keywords:keyword_specific_position")
def _(c: Column, get: Get) -> Column:
    s = F.get(get.sentences(c), get("n").cast("int") - 1)
    return F.coalesce(F.get(word_tokens(s), get("m").cast("int") - 1) == get("keyword"), F.lit(False))


@check("keywords:start_end")
def _(c: Column, get: Get) -> Column:
    t = word_tokens(c)
    return (F.size(t) > 1) & (F.lower(F.get(t, F.lit(0))) == F.lower(F.get(t, F.size(t) - 1)))


def passes(check_id: str, text: Column | str, *, profiles: Profiles | None = None, boundaries: Boundaries | None = None, **arguments: object) -> Column:
    """Whether a response passes one check with constant arguments; lists are joined by commas."""
    c = F.col(text) if isinstance(text, str) else text
    known = {k: ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v) for k, v in arguments.items()}
    get = Get(lambda name: F.lit(known.get(name)).cast("string"), profiles, boundaries)
    return F.coalesce(CHECKS[check_id](c, get), F.lit(False))


def constraint_score(df: DataFrame, text: str = "response", constraints: str = "constraints", key: str = "row_id", *, profiles: Profiles | None = None, boundaries: Boundaries | None = None, blank: Column | None = None) -> DataFrame:
    """(key, score) of each row: the share of its constraints that its response passes.

    constraints: array<struct<instruction_id: array<string>, kwargs: array<map<string, string>>>>. Missing
    kwargs are empty, unknown ids count as failed, blank responses and rows without constraints get 0. A response is
    blank if it is null or white space of any alphabet, or as `blank` says. Rows are scored where they are read: keys may repeat or be null.
    """
    c, empty = F.col(text), F.create_map().cast("map<string,string>")
    known = F.filter(constraints, lambda g: g["instruction_id"].isNotNull())
    each = F.flatten(F.transform(known, lambda g: F.transform(g["instruction_id"], lambda name, i: F.struct(name.alias("id"), F.coalesce(F.get(g["kwargs"], i), empty).alias("kw")))))

    def passed(x: Column) -> Column:
        get = Get(lambda name: F.element_at(x["kw"], F.lit(name)), profiles, boundaries)
        made = F.when(F.lit(False), False)
        for check_id, f in CHECKS.items():
            made = made.when(x["id"] == check_id, f(c, get))
        return F.coalesce(made, F.lit(False))

    share = let(each, lambda e: F.when(F.size(e) > 0, F.size(F.filter(e, passed)) / F.size(e)))
    blank = ~F.regexp_like(c, F.lit(r"(?U)\S")) if blank is None else blank
    return df.select(key, F.when(F.coalesce(blank, F.lit(True)) | c.isNull(), 0.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"))
