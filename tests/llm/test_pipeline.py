import corpus_pipeline
from tallyweave.llm import packing, toxicity
from tallyweave.llm.common import table
from tests.llm.test_text_operators import brute_copies, brute_pieces, brute_score


def test_stages_keep_the_columns_and_drop_what_they_should(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    left = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == columns
        counts.append(left.count())
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0.5 * counts[0]
    assert len({r["doc_id"] for r in left.select("doc_id").collect()}) == counts[3]


def test_run_packs_what_is_left(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and max(r["length"] for r in got) <= packing.CAPACITY


def test_stages_on_nothing(spark, sf):
    left = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf)
    assert left.count() == 0


def test_run_against_brute_force(spark, sf):
    """Every stage's rule spelled out in Python, on what the stage before left."""
    docs = table(spark, sf, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    machine = toxicity.train(docs, table(spark, sf, "labels"))
    values = {}

    clean = [(i, t) for i, t in rows if brute_score(t, machine, values) < toxicity.THRESHOLD]
    assert 0 < len(clean) < len(rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\v\f\r").translate(lower)
    owner = {}
    for i, text in clean:
        for line in text.split("\n"):
            owner.setdefault(key(line), i)
    own = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i)) for i, t in clean]
    group = brute_copies(own)
    kept = [(i, t) for i, t in own if group[i] == i]
    assert len(kept) < len(own)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(brute_pieces(kept))
    bound = -(-sum(r["length"] for r in got) // packing.CAPACITY)
    assert bound <= len({r["sequence_id"] for r in got}) <= bound + 1
