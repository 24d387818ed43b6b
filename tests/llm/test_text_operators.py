import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import bands, bpe, linededup, minhash, nearsets, packing, simhash, toxicity
from tallyweave.llm.common import table

DOCS = "doc_id long, text string, lang string, count int, name string, _k int"
ODD = [
    (1, "one two three four five six", "en", 1, "a", 0),
    (2, "one two three four five six", "en", 1, "a", 0),
    (2, "one two three four five six", "en", 1, "a", 0),
    (3, None, None, None, None, None),
    (None, "a line of some length\nshort\nA Line of some length  ", "de", 2, "b", 1),
    (4, "", "fr", 3, "c", 2),
    (5, "a line of some length\r\n\n漢字 é x 😀", "es", 4, "d", 3),
    (6, "word " * 3000 + "a line of some length\nagain and again", "en", 5, "e", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# --- byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def own_codec():
    return bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_library(own_codec):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own_codec.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "it's 12 o'clock", "x" * 1000, "ab" * 700] + ["".join(rng.choice("abcdeéß漢😀  \n1'st.") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for text, ids in zip(texts, own_codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert own_codec.decode(ids) == text.encode()


def test_bpe_single_tree_equals_shared_trees(own_codec):
    words = [b"thanhaedeaa", b"Ob", b" ververstehen", b"aaaaaaaaaaaaaaaa", bytes(range(128, 160))]
    for w in words:
        size = 1 << (len(w) - 1).bit_length()
        assert np.frombuffer(own_codec.merge_many([w], size)[0], "<u4").tolist() == own_codec.merge_one(w)


def test_bpe_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    small = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert small.decode(small.encode(["a few more words than it keeps"])[0]) == b"a few more words than it keeps"


def test_bpe_rows(odd, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_digests(odd, path, P.PATTERN).collect()
    assert len(got) == len(ODD)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((x[1] or "").encode()).hexdigest() for x in ODD)
    assert bpe.encode_digests(none, path, P.PATTERN).count() == 0
    ids = bpe.encode_documents(odd, path, P.PATTERN).collect()
    assert sorted(len(r["ids"]) for r in ids) == sorted(r["n_tokens"] for r in got)


# --- line dedup ---------------------------------------------------------------------------------


def brute_lines(rows, least=10):
    white = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = lambda i: (i is None, i or 0)
    owner, seen = {}, {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = line.strip(white).translate(lower)
            if len(k) >= least:
                owner[k] = min(owner.get(k, rank(i)), rank(i))
                seen.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not ((k := x.strip(white).translate(lower)) in owner and owner[k] != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, sf, odd, none):
    for df, rows in ((odd, [x[:2] for x in ODD]), (table(spark, sf, "documents"), docs(spark, sf))):
        got = [tuple(r) for r in linededup.line_digests(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
        assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)
    assert linededup.line_digests(none).count() == 0


SHARED_IDS = [
    (1, "a common line here\nfirst"),
    (2, "a common line here\nx"),
    (2, "a unique line of the second row\na common line here"),
    (2, "a unique line of the second row\na common line here"),
    (None, "a line that has no id at all\nA common line here "),
    (None, "some other line without an id\na line that has no id at all"),
    (9, "a line that has no id at all"),
]


@pytest.mark.parametrize("broadcast_bytes", [linededup.BROADCAST_BYTES, 0])
def test_line_dedup_of_rows_that_share_an_id(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", broadcast_bytes)
    df = spark.createDataFrame(SHARED_IDS, "doc_id long, text string").withColumn("keep", F.lit(1)).withColumn("_line_keep", F.lit("x")).withColumn("_line_doc", F.lit(2))
    got = [tuple(r) for r in linededup.line_digests(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute_lines(SHARED_IDS), key=str)
    kept = linededup.drop_lines(df)
    assert kept.columns == df.columns and {r["_line_keep"] for r in kept.collect()} == {"x"}
    assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in kept.collect()) == sorted(x[3] for x in brute_lines(SHARED_IDS))


def test_drop_lines_leaves_null_texts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLICE", 5)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one line of text\n\nb"), (4, "b\none line of text")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in linededup.drop_lines(df).collect()) == [(1, None), (2, ""), (3, "one line of text\n\nb"), (4, "b")]


def test_line_dedup_without_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    got = [tuple(r) for r in linededup.line_digests(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute_lines(docs(spark, sf)), key=str)


def test_line_dedup_key_over_many_partitions(spark):
    rows = [(i, f"the very same line everywhere\nown line of document {i}") for i in range(400, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = linededup.line_hashes(df)
    assert {r["doc_id"] for r in linededup.later_copies(hashes, 50).collect()} == set(range(2, 401))


def test_drop_lines_keeps_columns(odd):
    got = linededup.drop_lines(odd)
    assert got.columns == odd.columns
    assert got.count() == len(ODD)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[6]["text"].startswith("word word") and rows[6]["name"] == "e"


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 100):
        gone = sorted(set(rng.integers(0, n, 5).tolist()))
        keep = linededup.unpack_bitmap(linededup.pack_bitmap(gone), n)
        assert np.flatnonzero(~keep).tolist() == gone


# --- SimHash -------------------------------------------------------------------------------------


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_simhash_against_brute_force(spark, sf):
    rows = sorted(docs(spark, sf))
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(table(spark, sf, "documents")).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i][0] for i, _ in rows] == prints
    root = components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert [got[i][1] for i, _ in rows] == [rows[r][0] for r in root]


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {(r["fp"], r["component_id"]) for r in got if r["doc_id"] in (3, 4)} == {(0, 3)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_chain_through_rows_without_an_id(spark, monkeypatch):
    prints = {"a": 0, "b": 3, "c": 15, "d": 255 << 20}
    df = spark.createDataFrame([(1, "a"), (None, "b"), (7, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    value = F.create_map(*[F.lit(x) for kv in prints.items() for x in kv])[F.col("text")].cast("long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", value.alias("fp")))
    got = sorted(((r["fp"], r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 1, 1), (3, None, 1), (15, 7, 1), (255 << 20, None, None), (255 << 20, None, None)], key=str)


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    at = {x: i for i, x in enumerate(signed)}
    links = {(at[r["a"]], at[r["b"]]) for r in simhash.fingerprint_links(df, 2).collect()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    want = components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert components(len(fps), lambda a, b: (a, b) in links or (b, a) in links) == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_copies_of_a_large_group(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join([word() if rng.random() < 0.004 else w for w in base])) for i in range(60)]
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 160)]


def brute_copies(rows, threshold=0.8):
    """The smallest doc_id of each text's component by five-word Jaccard."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = components(len(rows), lambda a, b: len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))
    return {i: rows[r][0] for (i, _), r in zip(rows, root, strict=True)}


SEARCHES = [simhash.near_copies, bands.near_duplicates]


def near_copies(spark, rows, search=simhash.near_copies):
    return {r["doc_id"]: r["component_id"] for r in search(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("search", SEARCHES)
def test_near_copies_with_contiguous_changes(spark, search):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = []
    for n in (12, 40, 200, 500, 1500):
        for _ in range(4):
            base, cut = [word() for _ in range(n)], int(rng.uniform(0.06, 0.25) * n)
            at = rng.randrange(n - cut)
            changed = [word() for _ in range(cut)]
            spread = [word() if rng.random() < 0.02 else w for w in base]
            texts += [base, base + changed, base[:-cut], base[:at] + changed[: cut // 2] + base[at + cut // 2 :], base[:-3] + changed[:3], spread, sorted(base)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_copies(rows)
    assert len(set(want.values())) < 0.6 * len(rows)
    assert near_copies(spark, rows, search) == want


@pytest.mark.parametrize("search", SEARCHES)
def test_near_copies_of_the_table(spark, sf, search):
    rows = sorted(docs(spark, sf))
    assert near_copies(spark, rows, search) == brute_copies(rows)


@pytest.mark.parametrize("search", SEARCHES)
def test_near_copies_of_odd_rows(spark, odd, none, search):
    got = sorted(((r["doc_id"], r["component_id"]) for r in search(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (None, None), (4, 3), (5, 5), (6, 6)], key=str)
    assert search(none).count() == 0


def test_near_copies_name_rows_by_their_text(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    a, b, c = ([word() for _ in range(100)] for _ in range(3))
    rows = [(3, a), (5, [*a, "x"]), (5, b), (None, [*b, "y"]), (None, c), (5, b), (None, c)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").withColumn("_kept_doc", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = [(3, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (None, " ".join(c)), (None, " ".join(c))]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_copies_verify_before_they_unite(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(12):
        base = [word() for _ in range(200)]
        copy = [word() if i in (50, 100, 150) else w for i, w in enumerate(base)]
        mixed = [x for i, w in enumerate(base) for x in ([w, "of"] if i % 8 == 0 else [w])]
        rows += [(3 * k + j, " ".join(t)) for j, t in enumerate(rng.sample([base, copy, mixed], 3))]
    want = brute_copies(rows)
    assert len(set(want.values())) == 24
    assert near_copies(spark, rows) == want


@pytest.mark.parametrize("head", [0, 1, 5])
def test_runs_in_pieces(monkeypatch, head):
    monkeypatch.setattr(nearsets, "LONG_RUN", 20)
    rng = np.random.default_rng(head)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 100), np.full(130, 7), np.full(90, 50)]))
    rows = np.stack([keys, np.arange(len(keys))])
    for step in (1, 3, 17, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, at : at + step]], names=["k", "v"]) for at in range(0, len(keys), step)]
        seen, last = [], None
        for got, cut in nearsets._runs(iter(batches), head):
            start = head if cut and last == got[0, 0] else 0
            if start:
                assert got[1, :head].tolist() == np.flatnonzero(keys == got[0, 0])[:head].tolist()
            assert cut or got.shape[1] <= 20 + head + step or len(set(got[0].tolist())) > 1
            assert not cut or len(set(got[0].tolist())) == 1
            assert last is None or cut or got[0, 0] != last
            seen += got[1, start:].tolist()
            last = got[0, -1]
        assert seen == list(range(len(keys)))


def test_near_copies_of_blocks_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "LONG_RUN", 8)
    monkeypatch.setattr(nearsets, "ROUNDS", (0, 1, 4, 16))
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(14 + i % 5)] + base[14 + i % 5 :])) for i in range(60)]
    rows += [(100 + i, " ".join([word() for _ in range(40)] + base[40:])) for i in range(40)]
    assert near_copies(spark, rows) == brute_copies(rows)


@pytest.mark.parametrize(("first", "last", "k"), [(0, 1, 50), (1, 8, 50), (8, 16, 37), (16, 32, 64), (16, 32, 17), (32, 64, 33)])
def test_tiles_meet_every_pair_once(spark, monkeypatch, first, last, k):
    monkeypatch.setattr(nearsets, "TILE", 10)
    monkeypatch.setattr(nearsets, "MEMBERS", 4)
    rows = spark.range(k).select(F.lit(7).cast("long").alias("block"), F.col("id").alias("rank"), F.lit(k).cast("long").alias("k"))
    tiles = {}
    for r in nearsets._tiles(rows, first, last).collect():
        tiles.setdefault(r["tile"], []).append((r["rank"], r["marks"]))
    met = []
    for own in tiles.values():
        own.sort()
        members = [m & nearsets.MEMBER != 0 for _, m in own]
        assert members == sorted(members, reverse=True) and sum(members) <= 4 and len(own) <= 10 + 4
        met += [(a, b) for i, (a, m) in enumerate(own) if m & nearsets.MEMBER for b, n in own[i + 1 :] if not n & nearsets.COPY]
    assert sorted(met) == [(a, b) for a in range(first, min(last, k)) for b in range(a + 1, k)]


def test_a_large_block_of_unlike_rows_is_many_tasks(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("block"), F.col("id").alias("rank"), F.lit(n).cast("long").alias("k"))
    for first, last in ((0, 1), (64, 4096), (8192, 16384)):
        sizes = nearsets._tiles(rows, first, last).groupBy("tile").agg(F.count("*").alias("n"), F.sum((F.col("marks").bitwiseAND(nearsets.MEMBER) != 0).cast("int")).alias("m")).collect()
        assert len(sizes) >= 6 and max(r["n"] for r in sizes) <= nearsets.TILE + nearsets.MEMBERS and max(r["m"] for r in sizes) <= nearsets.MEMBERS


@pytest.mark.parametrize("search", SEARCHES)
def test_near_copies_of_large_blocks(spark, monkeypatch, search):
    monkeypatch.setattr(nearsets, "TILE", 6)
    monkeypatch.setattr(nearsets, "MEMBERS", 4)
    monkeypatch.setattr(nearsets, "ROUNDS", (0, 1, 4, 8))
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(14 + i % 5)] + base[14 + i % 5 :])) for i in range(40)]
    rows += [(100 + i, " ".join([word() for _ in range(45)] + base[45:])) for i in range(30)]
    assert near_copies(spark, rows, search) == brute_copies(rows)


@pytest.mark.parametrize("few", [1_000_000, 0])
@pytest.mark.parametrize("search", SEARCHES)
def test_near_copies_read_texts_in_place_and_once(spark, monkeypatch, search, few):
    """Texts aren't shuffled to make shingle sets of some, and no round makes a set again; where the names are too many to be sent, results are the same."""
    monkeypatch.setattr(nearsets, "FEW", few, raising=False)
    monkeypatch.setattr(nearsets, "ROUNDS", (0, 1, 4, 8))
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(14 + i % 5)] + base[14 + i % 5 :])) for i in range(20)]
    rows += [(100 + i, " ".join([word() for _ in range(45)] + base[45:])) for i in range(20)]
    made, plans, real = [], [], nearsets.shingle_sets

    def noted(texts, width):
        made.extend(r["text"] for r in texts.collect())
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return real(texts, width)

    monkeypatch.setattr(nearsets, "shingle_sets", noted)
    assert near_copies(spark, rows, search) == brute_copies(rows)
    assert made and len(made) == len(set(made))
    assert not few or not any("Exchange hashpartitioning" in p for p in plans)


def test_near_copies_around_one_that_comes_last(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "ROUNDS", (0, 1, 4, 16))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join([word() for _ in range(22)] + base[22:] if i % 2 else base[:at] + [word() for _ in range(24)] + base[at + 24 :])) for i in range(40) for at in [6 * i]]
    rows += [(99, " ".join(base))]
    want = brute_copies(rows)
    assert set(want.values()) == {0}
    assert near_copies(spark, rows) == want


def test_keep_one_odd_rows(odd, none):
    got = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert None in got and got.count(1) == 1 and 2 not in got and (3 in got) and 4 not in got
    assert simhash.keep_one(none).count() == 0


# --- MinHash -------------------------------------------------------------------------------------


def test_minhash_edits(spark, sf, odd, none):
    rows = sorted(docs(spark, sf), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(table(spark, sf, "documents")).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert got[i]["edited_fingerprint"] == minhash.fingerprint(minhash.signatures([edited.encode()])[0])
        shingle = lambda t: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))}
        a, b = shingle(text), shingle(edited)
        assert abs(len(a & b) / len(a | b) - got[i]["near_edited"]) < 0.2
        parts = lambda x: np.frombuffer(base64.b64decode(x), "<u2")
        own, following = parts(got[i]["fingerprint"]), parts(got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
        assert got[i]["near_edited"] == (own == parts(got[i]["edited_fingerprint"])).mean() and got[i]["near_next"] == (own == following).mean()
    assert minhash.fingerprint_edits(odd).count() == len(ODD)
    assert minhash.fingerprint_edits(none).count() == 0


def brute_signature(text, width=5):
    """Minima of the universal hashes over a text's shingles, in whole numbers modulo 2**64."""
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def word(w):
        power, total = 1, len(w)
        for i, c in enumerate(w):
            power = power * 0x9E3779B97F4A7C15 & full if i % 4096 else 0x9E3779B97F4A7C15
            total += power * (c + (i >> 12) * 257 + 1)
        return mix(total & full)

    words = [word(w) for w in text.encode().split()]
    many = min(len(words), width)
    made = [mix((many + sum(x * int(c) for x, c in zip(words[i : i + many], minhash._C))) & full) for i in range(len(words) - many + 1)] if words else []
    return [min(((h * int(a) + int(b)) & full for h in made), default=full) >> 32 for a, b in zip(minhash._A, minhash._B, strict=True)]


def test_minhash_signatures_against_brute_force():
    rng = random.Random(7)
    texts = ["", " \t", "one", "one two three four", "one two three four five", "漢字 é x 😀 a b", "x" * 9000 + " a b c d e"]
    texts += [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    made = minhash.signatures([t.encode() for t in texts])
    for text, own in zip(texts, made.tolist(), strict=True):
        assert own == brute_signature(text)


def test_minhash_edit_rows_of_an_odd_table(odd):
    """Descending doc_id, nulls last, repeats by text; the last row's edit takes from the first."""
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, row in enumerate(order):
        text, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        make = lambda t: minhash.fingerprint(np.array(brute_signature(t), np.uint32))
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), make(text), make(edited)))
    got = minhash.fingerprint_edits(odd).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got), key=str) == sorted(want, key=str)


def test_minhash_estimates_jaccard():
    rng = random.Random(5)
    words = [str(rng.random()) for _ in range(600)]
    for share in (0.0, 0.3, 0.6, 0.9):
        other = words[: int(600 * share)] + [str(rng.random()) for _ in range(600 - int(600 * share))]
        a, b = minhash.signatures([" ".join(words).encode(), " ".join(other).encode()])
        sets = [{tuple(x[j : j + 5]) for j in range(596)} for x in (words, other)]
        want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(minhash.likeness(a[None], b[None])[0] - want) < 0.15


# --- packing -------------------------------------------------------------------------------------


def brute_pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            out.append((i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("group", [20_000, 37])
def test_packing(spark, sf, odd, group):
    path = P.path("word_bpe_49k.json")
    special = [(1, "hi <|endoftext|> you"), (2, "a<|endoftext|>b <|startoftext|>"), (3, "<|ENDOFTEXT|>"), (3, "<|endoftext|>")]
    for df, rows in ((table(spark, sf, "documents"), docs(spark, sf)), (odd, [x[:2] for x in ODD]), (spark.createDataFrame(special, "doc_id long, text string"), special)):
        got = packing.pack_documents(df, path, group=group).collect()
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(brute_pieces(rows), key=str)
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        bound = -(-sum(r["length"] for r in got) // 2048)
        assert len(places) <= (bound + 1 if group > len(got) else bound * 1.02 + 2)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 5, 5]
    start = [[0, 4], [1, 5], [2, 3]]  # 11 + 11 + 8 of 15: two bins hold all
    made = packing.improve(start, lengths, 15)
    assert len(made) == 2 and sorted(i for b in made for i in b) == list(range(6))
    rng = random.Random(7)
    for _ in range(20):
        lengths = [rng.randint(1, 100) for _ in range(60)]
        bins = packing.best_fit(lengths, 100)
        better = packing.improve(bins, lengths, 100)
        assert len(better) <= len(bins) and sorted(i for b in better for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 100 for b in better)


def helps(giver, taker, capacity):
    """Whether the fuller bin of sizes gets fuller by a document of the other, for none, one or two of its own."""
    room = capacity - sum(taker)
    given = {0, *taker, *(a + b for k, a in enumerate(taker) for b in taker[k + 1 :])}
    return sum(taker) >= sum(giver) and any(0 < x - s <= room for x in set(giver) for s in given)


def test_local_search_leaves_no_exchange():
    for low, high, many, seed in ((400, 1400, 2500, 1), (30, 1000, 2500, 2)):
        rng = random.Random(seed)
        lengths = [rng.randint(low, high) for _ in range(many)]
        bins = packing.improve(packing.best_fit(lengths, 2048), lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(many))
        under = [[lengths[i] for i in b] for b in bins if sum(lengths[i] for i in b) < 2048]
        done = len(bins) == -(-sum(lengths) // 2048)
        assert done or not any(helps(a, b, 2048) for a in under for b in under if a is not b)


@pytest.mark.parametrize("words", [packing.CACHE_WORDS, 200])
def test_word_ids_equal_the_library(monkeypatch, words):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", words)
    path = P.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ["<|endoftext|> it's WE'LL", "", "   ", "\x1c a", "é<|endoftext|>\u0301x", "a<|endoftext|>b<|startoftext|><|ENDOFTEXT|>", "x\x85y z\xa0q"]
    texts += ["".join(rng.choice("abÉçß'sdtİΣσ漢é 0123\u0301<|>.,-\nve²½\x00\x1c") for _ in range(rng.randint(0, 90))) for _ in range(600)]
    for special in (True, False):
        theirs = Tokenizer.from_file(path)
        theirs.encode_special_tokens = not special
        own = packing.WordIds(path, special)
        for at in range(0, len(texts), 50):
            for text, ids in zip(texts[at : at + 50], own.encode(texts[at : at + 50]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_packing_deals_repeated_rows_to_many_groups(spark):
    df = spark.createDataFrame([(1, "the very same row")] * 400, "doc_id long, text string")
    got = packing.pack_documents(df, P.path("word_bpe_49k.json"), capacity=64, group=40).collect()
    assert len(got) == 400 and len({r["sequence_id"] >> 25 for r in got}) > 4


# --- toxicity ------------------------------------------------------------------------------------


def sentences(rng, n, bad=()):
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "in", "at", "es"]) for _ in range(rng.randint(1, 4)))
    out = [word() for _ in range(n)]
    for b in bad:
        out.insert(rng.randrange(len(out)), b)
    return " ".join(out) + "."


def test_toxicity_held_out_and_disguised():
    rng = random.Random(8)
    insults = ["blockhead", "dimwit", "lowlife"]
    texts = [sentences(rng, 60, [rng.choice(insults)]) for _ in range(120)] + [sentences(rng, 60) for _ in range(300)]
    machine = toxicity.fit(texts, [1] * 120 + [0] * 300)
    bad = machine.scores([sentences(rng, 60, [rng.choice(insults)]) for _ in range(60)])
    good = machine.scores([sentences(rng, 60) for _ in range(100)])
    assert (bad >= 0.3).mean() > 0.95 and (good >= 0.3).mean() < 0.05
    for hidden in ("block.head", "b l o c k h e a d", "dim-wit", "d.i.m.w.i.t", "lowxlife", "LOWLIFE!!"):
        assert machine.scores([sentences(rng, 40, [hidden])])[0] >= 0.3, hidden
    assert (machine.scores(["", " ", "."]) < 0.3).all()


def test_toxicity_table_is_the_kernel():
    words, marks = ["idiotic", "st_upid", "ab", ""], ["idiot", "stupid"]
    seen = toxicity.subsequences_of(marks)
    place = np.full(64**3, len(seen))
    place[seen] = np.arange(len(seen))
    kernel = toxicity.subsequence_rows(words, place, len(seen)) @ toxicity.subsequence_rows(marks, place, len(seen)).T
    for j, mark in enumerate(marks):
        one = np.zeros(64**3, np.float32)
        one[seen] = toxicity.subsequence_rows([mark], place, len(seen))[0]
        assert np.allclose(toxicity.table_values(words, one), kernel[:, j], atol=1e-5)
    assert kernel[0, 0] > 0.6 > 0.2 > kernel[0, 1]


def test_toxicity_of_long_words():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij.") for _ in range(n)) for n in [*range(1, 40)] * 20 + [50_000, 2_000_000]]
    table = np.random.default_rng(12).random(64**3, np.float32) * toxicity._WHOLE
    for rows in toxicity._by_length(words):
        assert len(rows) == 1 or len(rows) * max(len(words[i]) for i in rows.tolist()) <= 1 << 20
    want = [toxicity.table_values([w], table)[0] for w in words]
    assert np.allclose(toxicity.table_values(words, table), want)


def test_toxicity_of_windows_of_a_long_word(monkeypatch):
    rng = random.Random(13)
    table = np.random.default_rng(12).random(64**3, np.float32) * toxicity._WHOLE
    words = ["".join(rng.choice("abcdefghij.") for _ in range(n)) for n in (300, 301, 999)] + ["a" * 500]
    want = toxicity.table_values(words, table)
    monkeypatch.setattr(toxicity, "CELLS", 100)
    assert np.allclose(toxicity.table_values(words, table), want)


def brute_value(word, weights):
    """Sum over gapped three-character subsequences, from their definition."""
    code = lambda c: int(toxicity._CODE[ord(c)])
    total = norm = 0.0
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                three = [code(word[x]) for x in (i, j, k)]
                if toxicity._GAP not in three:
                    w = toxicity.DECAY ** (k - i - 2)
                    total += w * weights[three[0] << 12 | three[1] << 6 | three[2]]
                    norm += w * w
    return total / np.sqrt(norm or 1.0)


def brute_score(text, machine, values):
    """A text's score from every word in its place, one after the other."""
    low = text.lower()
    places = [w.strip(toxicity._STRIP) for w in low.split()] + ["".join(x.split()) for x in toxicity._SPELLED.findall(low)]
    values.update({w: brute_value(w, machine.table) + machine.bias for w in set(places) if w not in values})
    own = sorted((values[w] for w in places), reverse=True)
    x = [min(max(v, -1.5), 1.5) for v in [*own, -1.5, -1.5][:2]]
    x.append(np.log((sum(min(max(2 * v, 0), 1) for v in own) + 0.2) / (len(own) + 50)))
    return 1 / (1 + np.exp(-(machine.slope[0] + sum(b * v for b, v in zip(machine.slope[1:], x, strict=True)))))


def test_toxicity_scores_against_brute_force():
    rng = random.Random(14)
    texts = [sentences(rng, 30, ["blockhead"]) for _ in range(60)] + [sentences(rng, 30) for _ in range(120)]
    machine = toxicity.fit(texts, [1] * 60 + [0] * 120)
    for text in ["", "a b", "block.head and b l o c k h e a d", *texts[:5], *texts[-5:]]:
        assert abs(machine.scores([text])[0] - brute_score(text, machine, {})) < 1e-4
    assert machine.scores(["blockhead " * 3 + "on an er " * 10])[0] > machine.scores(["blockhead " + "on an er " * 10])[0]
    assert min(machine.slope[1:]) >= 0


def test_toxicity_of_labelled_rows():
    """Held-out rows of the given tables. Some labels contradict every word of their text, so neither share can be 1."""
    docs = duckdb.sql("select d.doc_id, d.text, l.toxic from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' l using (doc_id) where d.text is not null order by doc_id").fetchall()
    held = [x for x in docs if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    known = [x for x in docs if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    machine = toxicity.fit([x[1] for x in known], [x[2] for x in known])
    told, truth = machine.scores([x[1] for x in held]) >= toxicity.THRESHOLD, np.array([x[2] for x in held]) == 1
    assert (told & truth).sum() >= 0.94 * truth.sum() and (told & truth).sum() >= 0.94 * told.sum()


def test_toxicity_learns_from_bounded_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, share: seen.append((sorted(texts), sorted(labels))))
    keys = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    df = spark.createDataFrame([(k, "x" * 1000 if n == 0 else f"text {n} " * 4) for n, k in enumerate(keys)] + [(keys[1], "text 1 " * 4), (keys[2], "other text")], "doc_id long, text string").withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(keys)], "doc_id long, toxic int")
    toxicity.train(df, labels, chars=500)
    toxicity.train(df, labels, chars=100)
    toxicity.train(df, labels, sample=1)
    assert len(seen[0][0]) == 8 and "other text" in seen[0][0]
    assert 0 < sum(map(len, seen[1][0])) <= 100
    assert 2 <= len(seen[2][0]) <= 3 and set(seen[2][1]) == {0, 1}


def test_keep_clean_with_a_score_column(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string").withColumn("_score", F.lit("own"))
    kept = toxicity.keep_clean(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == df.columns and [r["_score"] for r in kept.collect()] == ["own"] * 2


def test_toxicity_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, labels)
    assert got.count() == len(ODD) and got.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    empty = labels.filter("doc_id = 99")
    assert toxicity.score_documents(odd, empty).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_documents(none, labels).count() == 0
    kept = toxicity.keep_clean(odd, empty)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_held_out_rule(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_fingerprint_strings_decode():
    made = minhash.fingerprint(minhash.signatures([b"a b c d e f"])[0])
    assert len(base64.b64decode(made)) == 2 * minhash.PERMUTATIONS
