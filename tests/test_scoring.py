"""Scores and instruction checks on examples; datasets, sinks and streams."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.functions import answers
from tallyweave.functions import checks as C
from tallyweave.functions import scoring as S
from tallyweave.functions import textmodels as T
from tallyweave.sources import datasets as D
from tallyweave.sources import preprocess as P
from tallyweave.sources import sinks as K
from tallyweave.streaming import queues as Q


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "truth", "score"),
    [("so\n#### 1,234", "1234", 1.0), ("so 1234", "1234", 0.0), ("#### 5", "6", 0.1), ("#### 1 #### $2", "1", 1.0), ("#### 7" + "x" * 400, "7", 0.0), (None, "1", 0.0)],
)
def test_number_score(spark, text, truth, score):
    df = spark.createDataFrame([(text, truth)], "t string, g string")
    assert df.select(S.number_score("t", "g", format_score=0.1)).first()[0] == score


def test_flexible_number(spark):
    assert value(spark, S.marked_number("t", "flexible"), t="about 3 or 4.") == "4."
    assert value(spark, S.marked_number("t", "flexible"), t="none . at all") == "."


def test_qa(spark):
    df = spark.createDataFrame([("x <answer> The  Beijing! </answer>", ["beijing"]), ("beijing", ["beijing"]), ("<answer>a</answer>" * 11, ["a"]), ("<answer>new york city</answer>", ["york"])], "t string, g array<string>")
    assert [r[0] for r in df.select(S.qa_score("t", "g")).collect()] == [1.0, 0.0, 0.25, 0.0]
    assert [r[0] for r in df.select(S.qa_score("t", "g", substring=True)).collect()][3] == 1.0


def test_boxed_and_latex():
    assert S.boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\boxed{\\frac{1}{2}}"
    assert S.boxed("\\boxed{1") is None and S.boxed("no") is None and S.boxed("\\boxed 5$ x", loose=True) == "\\boxed 5"
    assert S.unboxed("\\boxed{x}") == "x" and S.unboxed("\\boxed 5") == "5" and S.unboxed("\\fbox{x}") is None
    assert S.latex_score("so \\boxed{\\frac12}", "\\frac{1}{2}") == 1.0 and S.latex_score("so \\boxed{0.5}", "1/2") == 1.0
    assert S.latex_score("x", "1") == 0.0 and S.latex_score(None, "1") == 0.0
    for a, b in (("\\tfrac{1}{2}", "\\frac12"), ("k=3", "3"), ("\\sqrt3", "\\sqrt{3}"), (".5", "0.5"), ("3\\text{ cm}", "3"), ("50\\%", "50"), ("\\frac1{72}", "\\frac{1}{72}"), ("3/4", "\\frac{3}{4}")):
        assert answers.latex_equal(a, b), (a, b)
    assert answers.latex_equal(None, None) and not answers.latex_equal(None, "1")


def test_final_answers():
    assert S.final_answer("x = 1,000") == "1000" and S.final_answer("$\\frac12$") == "\\frac{1}{2}" and S.final_answer("3 inches") == "3"
    assert S.verdict("work\nAnswer: $5$", "5")[:2] == (1.0, True) and S.verdict("no", "5") == (-1.0, False, "[INVALID]")
    assert S.verdict("so \\boxed{7}", "7", strict_box=True) == (1.0, True, "7") and S.verdict("\\boxed{7}" + "x" * 200, "7", strict_box=True)[0] == -1.0


def test_grading():
    for a, b in (("0.5", "\\frac{1}{2}"), ("1,234", "1234"), ("50%", "0.5"), ("1 1/2", "1.5"), ("(1, 2)", "(1.0,2)"), ("[0, 1)", "[0,1)"), ("YES", "yes")):
        assert answers.math_equal(a, b), (a, b)
    for a, b in (("1", "2"), ("(1,2)", "[1,2]"), ("(1,2)", "(1,2,3)"), (None, "1")):
        assert not answers.math_equal(a, b)
    assert S.graded("thus \\boxed{4}", "4") == (True, True, "4") and S.graded("The answer is 4.", "4")[:2] == (True, False)


def test_tool_calls(spark):
    text = 'a<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>b<tool_call>{bad</tool_call>'
    got = value(spark, S.tool_calls("t"), t=text)
    assert got["content"] == "ab" and [(c["name"], json.loads(c["arguments"])) for c in got["calls"]] == [("f", {"x": 1})]


def test_layout_dispatch_and_outputs(spark):
    assert value(spark, S.layout_score("t"), t="<think>a\nb</think>\n\\boxed{1}") == 1.0 and value(spark, S.layout_score("t"), t="no") == 0.0
    assert value(spark, S.layout_and_answer("t", "g"), t="<think>a</think>\\boxed{1}", g="1") == pytest.approx(1.0)
    with pytest.raises(PySparkException):
        value(spark, S.dispatch("t", {"a": F.lit(1.0)}), t="b")
    assert value(spark, S.same_output("a", "b"), a="1 \n 2\n", b="1\n2")
    got = spark.createDataFrame([([("T\nbody",), ("U\nmore",)],)], "r array<struct<contents: string>>").select(S.passages("r")).first()[0]
    assert got.startswith("Doc 1 (Title: T)\nbody") and "Doc 2 (Title: U)" in got
    assert value(spark, S.shortened("t", 10), t="abcdefghijklmno") == "abcde...(truncated) ...klmno"


CASES = [
    ("keywords:existence", "The Cat sat", {"keywords": ["cat", "SAT"]}, True), ("keywords:existence", "The Cat", {"keywords": ["dog"]}, False),
    ("keywords:frequency", "a a a", {"keyword": "a", "frequency": 3, "relation": "at least"}, True), ("keywords:word_count_different_numbers", "a a a", {"keyword": "a", "frequency": 3, "relation": "less than"}, False),
    ("keywords:forbidden_words", "catalog", {"forbidden_words": ["cat"]}, True), ("keywords:forbidden_words", "a cat", {"forbidden_words": ["cat"]}, False),
    ("keywords:letter_frequency", "Eel", {"letter": "e", "let_frequency": 2, "let_relation": "at least"}, True), ("letters:letter_counting2", "Eel", {"letter": "e", "let_frequency": 2, "let_relation": "less than"}, False),
    ("language:response_language", "the cat is in the house", {"language": "en"}, True), ("language:response_language", "le chat est dans la maison", {"language": "en"}, False), ("language:response_language", "xyz", {"language": "de"}, True),
    ("length_constraints:number_sentences", "One. Two! Three?", {"num_sentences": 3, "relation": "at least"}, True),
    ("length_constraints:number_paragraphs", "a\n***\nb", {"num_paragraphs": 2}, True), ("length_constraints:number_paragraphs", "a ***  *** b", {"num_paragraphs": 2}, False),
    ("length_constraints:number_words", "one two-three", {"num_words": 3, "relation": "at least"}, True),
    ("length_constraints:nth_paragraph_first_word", "one\n\n\"Two, is", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "two"}, True), ("length_constraints:nth_paragraph_first_word", "one", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "two"}, False),
    ("detectable_content:number_placeholders", "[name] and [x]", {"num_placeholders": 2}, True), ("detectable_content:postscript", "bye\nP.S. more", {"postscript_marker": "P.S."}, True), ("detectable_content:postscript", "bye", {"postscript_marker": "P.P.S"}, False),
    ("detectable_format:number_bullet_lists", "* a\n- b\n** c", {"num_bullets": 2}, True), ("detectable_format:constrained_response", "My answer is no. ok", {}, True),
    ("detectable_format:number_highlighted_sections", "*a* and **b**", {"num_highlights": 2}, True), ("detectable_format:multiple_sections", "Section 1 a Section 2 b", {"section_spliter": "Section", "num_sections": 2}, True),
    ("detectable_format:json_format", "```json\n{\"a\": 1}\n```", {}, True), ("detectable_format:json_format", "{a", {}, False), ("detectable_format:title", "<<A title>>", {}, True), ("detectable_format:title", "<< >>", {}, False),
    ("combination:two_responses", "a******b", {}, True), ("combination:two_responses", "a******a", {}, False), ("combination:repeat_prompt", "Say hi. Ok", {"prompt_to_repeat": "say HI."}, True), ("startend:end_checker", "so The End\"", {"end_phrase": "the end"}, True),
    ("change_case:capital_word_frequency", "A BIG dog", {"capital_frequency": 2, "capital_relation": "at least"}, True), ("change_case:english_capital", "THE CAT IS", {}, True), ("change_case:english_lowercase", "the Cat", {}, False),
    ("punctuation:no_comma", "a b", {}, True), ("startend:quotation", ' "a" ', {}, True), ("copy:repeat_phrase", "a big cat runs and a red cat runs", {"phrase": "a big cat runs", "small_n": 2}, True), ("copy:repeat_phrase", "a big cat runs", {"phrase": "a big cat runs", "small_n": 1}, False),
    ("copy:copy", " Hi ", {"prompt_to_repeat": "hi"}, True), ("copy:copying_simple", "ho", {"prompt_to_repeat": "hi"}, False), ("new:copy_span_idx", "bcd", {"prompt_to_repeat": "abcdef", "n_start": 1, "n_end": 4}, True),
    ("detectable_format:sentence_hyphens", "One is.-Two is.", {}, True), ("detectable_format:sentence_hyphens", "One is. - Two is.", {}, False), ("detectable_format:sentence_hyphens", "One is", {}, True), ("keywords:no_adjacent_consecutive", "apple cat bird", {}, True), ("keywords:no_adjacent_consecutive", "apple bird", {}, False),
    ("detectable_format:square_brackets", "[a] [b]", {}, True), ("keywords:word_once", "one Cat", {"keyword": "cat"}, True), ("keywords:exclude_word_harder", "a cat b", {"keyword": "cat"}, False),
    ("paragraphs:paragraphs", "a***b", {}, True), ("paragraphs:paragraphs2", "a\n\nb", {}, True), ("paragraphs:paragraphs2", "a\n\nb\n\nc", {}, False), ("first_word:first_word_sent", "So it is. So be it.", {"first_word": "so"}, True), ("first_word:first_word_answer", "So it", {"first_word": "SO"}, True),
    ("last_word:last_word_sent", "it ends. All ends!", {"last_word": "ends"}, True), ("last_word:last_word_answer", "it ends.", {"last_word": "ends"}, True), ("last_word:last_word_answer", "", {"last_word": "ends"}, False),
    ("detectable_format:bigram_wrapping", "<<a b>> <<c d>>", {}, True), ("copy:copying_multiple", "hi******Hi", {"prompt_to_repeat": "hi", "N": 2}, True), ("punctuation:punctuation_dot", "a.", {}, False), ("punctuation:punctuation_exclamation", "a", {}, True),
    ("count:lowercase_counting", "Ab cd ef", {"N": 2}, True), ("letters:letter_counting", "ab1", {"N": 3, "relation": "less than"}, True), ("count:counting_composition", "a b .*** c d .***e f .", {"n_sent": 1, "n_words": 3}, True),
    ("count:count_unique", "a b c", {}, True), ("count:count_unique", "a b a", {}, False), ("count:count_increment_word", "x y y", {"keyword1": "x", "keyword2": "y"}, True), ("keywords:palindrome", "see anna go", {}, True), ("keywords:palindrome", "see it", {}, False),
    ("keywords:keyword_specific_position", "One two. Three four.", {"keyword": "four", "n": 2, "m": 2}, True), ("keywords:start_end", "So it is so", {}, True), ("keywords:start_end", "So", {}, False),
]


def test_all_checks_have_examples():
    assert len(C.CHECKS) == 54 and {c[0] for c in CASES} == set(C.CHECKS)


def test_checks(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, t string")
    got = df.select("i", *[F.when(F.col("i") == i, C.passes(c[0], "t", **c[2])).alias(f"c{i}") for i, c in enumerate(CASES)]).collect()
    wrong = [CASES[r["i"]] for r in got if r[f"c{r['i']}"] != CASES[r["i"]][3]]
    assert not wrong


def test_constraint_scores(spark):
    kind = "row_id long, response string, constraints array<struct<instruction_id: array<string>, kwargs: array<map<string,string>>>>"
    two = (["punctuation:no_comma", "keywords:word_once"], [None, {"keyword": "x"}])
    df = spark.createDataFrame([(1, "x y", [two]), (2, "x, x", [two, (["no:such"], [])]), (3, " ", [two]), (4, "x", []), (5, None, [two])], kind)
    assert {r["row_id"]: r["score"] for r in C.constraint_score(df).collect()} == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0})


def test_constraint_scores_by_row(spark):
    """Every check by its id and arguments, next to an unknown one; keys that repeat or are null; rows without constraints."""
    kind = "row_id long, response string, constraints array<struct<instruction_id: array<string>, kwargs: array<map<string,string>>>>"
    known = lambda args: {k: ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v) for k, v in args.items()}
    rows = [(i, c[1], [([c[0], "no:such"], [known(c[2])])]) for i, c in enumerate(CASES)]
    got = {r["row_id"]: r["score"] for r in C.constraint_score(spark.createDataFrame(rows, kind)).collect()}
    assert not [c for i, c in enumerate(CASES) if got[i] != (0.5 if c[3] and c[1] and c[1].strip() else 0.0)]
    comma = [(["punctuation:no_comma"], None)]
    rows = [(1, "x", comma), (1, "x,", comma), (None, "x", comma), (None, "x,", comma), (2, "x", None), (3, "x", [None, (None, None), comma[0]]), (4, "x", [([None], [])]), (5, "\t", comma), (6, None, comma)]
    df = spark.createDataFrame(rows, kind)
    scores = lambda **more: [(r["row_id"], r["score"]) for r in C.constraint_score(df, **more).collect()]
    assert scores() == [(1, 1.0), (1, 0.0), (None, 1.0), (None, 0.0), (2, 0.0), (3, 1.0), (4, 0.0), (5, 0.0), (6, 0.0)]
    assert scores(blank=F.lit(False))[-2:] == [(5, 1.0), (6, 0.0)]
    told, ends = T.fit_profiles(spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de")], "text string, lang string")), T.Boundaries(["dr"], [])
    asked = [(["language:response_language", "length_constraints:number_sentences"], [{"language": "de"}, {"num_sentences": "1", "relation": "less than"}])]
    df = spark.createDataFrame([(1, "die Katze von Dr. Katze.", asked), (2, "the dog. the cat.", asked)], kind)
    want = [
        sum(df.filter(f"row_id = {i}").select(C.passes(name, "response", profiles=told, boundaries=ends, **args).alias("x")).first()["x"] for name, args in zip(*asked[0], strict=True)) / 2 for i in (1, 2)
    ]
    assert [r["score"] for r in C.constraint_score(df, profiles=told, boundaries=ends).collect()] == want


def test_datasets(spark, tmp_path):
    rows = [("p1", "short one"), ("p2", "word " * 50), ("p3", None)]
    spark.createDataFrame(rows, "id string, prompt string").write.json(f"{tmp_path}/a.json")
    got = D.prompts(spark, f"{tmp_path}/a.json", ["id"], D.PromptOptions(max_prompt_length=10))
    assert [(r["id"], r["row_id"]) for r in got.collect()] == [("p1", 0)]
    with pytest.raises(ValueError):
        D.read_files(spark, "x.csv")
    def broken(texts):
        raise RuntimeError

    df = spark.createDataFrame(rows, "id string, prompt string")
    assert D.short_prompts(df, 10, F.col("prompt"), broken).count() == 0 and D.short_prompts(df, 10, F.col("prompt"), lambda t: [len(t[0].split())]).count() == 1
    with pytest.raises(PySparkException):
        df.limit(1).select(D.message_parts(F.lit("<image>x"), F.array().cast("array<string>"))).collect()


def test_preprocessing_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "q", "s #### -1,200.5"), (1, "r", "none")], "row_id long, question string, answer string")
    got = [r["reward_model"]["ground_truth"] for r in P.marked_answers(df, "train").collect()]
    assert got == ["-1200.5", ""]
    train, test = P.holdout(spark.range(2000).withColumnRenamed("id", "row_id"), 0.1, 3)
    assert train.count() + test.count() == 2000 and 120 < test.count() < 280 and train.join(test, "row_id").count() == 0
    metrics = spark.createDataFrame([(1, "b", 2.0), (1, "a", 0.5)], "step long, name string, value double")
    assert K.metric_line(metrics).first()["line"] == "step:1 - a:0.500 - b:2.000"
    K.log_metrics(metrics, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").first()["data"]["b"] == 2.0
    ids = spark.createDataFrame([("ab-cd",), ("x",)], "request_id string")
    assert K.by_request(ids, "abcd").count() == 1


def test_stream_state_spans_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(0, k * 10 + i, 1.0) for i in range(10)], "queue long, sample_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = Q.read_stream(spark, f"{tmp_path}/in", files_a_trigger=1)
    got = Q.latest(Q.run_to_table(Q.bounded_queue(stream, 4), "update", "t-queue"), "queue").first()
    assert (got["produced"], got["dropped"], got["size"], got["newest"] - got["oldest"]) == (30, 26, 4, 3)
    made = Q.run_to_table(Q.count_windows(stream, 7), "append", "t-windows").collect()
    assert sorted(r["window"] for r in made) == [0, 1, 2, 3] and all(r["total"] == 7.0 for r in made)
    assert Q.capacity_of(10, 0.5, 2, 1) == (30, 16) and Q.should_pause(5, 5, 0, 9) and not Q.should_pause(1, 5, 0, 9)
    with pytest.raises(ValueError):
        Q.draw(spark.range(2).withColumnRenamed("id", "row_id"), 3)
