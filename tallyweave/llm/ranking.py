"""Ranked lexical search with MaxScore (operator 13).

Terms are runs of letters and digits (any code point beyond ASCII counts as a letter), with A-Z
in lower case. One pass over the texts keeps, for each document, its number of terms and the
counts of the query terms in it; the table is written once, and both the statistics of the corpus
(documents, terms, documents a term is in) and the search read it.

A shard is a run of documents within a task: its postings are grouped by term in numpy, with the
highest score a term has in it. A query takes its terms by these bounds, least first; as many
as together can't reach the query's threshold are non-essential. Documents of the essential
terms are candidates; the others' postings are probed, largest bound first, only for candidates whose score plus
the bounds of what is left can still reach the threshold. The threshold is the k-th best score so
far, at first over about SEED documents picked by a hash, which are searched before and whose
thresholds are sent along, so that every task can skip from its first shard on. A document of equal score may win by
its id and stays in. A task returns k rows a query, and a rank within the query keeps k of all.

Query sets travel in blocks of QUERY_TERMS distinct terms at most (or one query), each with a
search of its own; a larger query set makes more blocks, not larger ones.

Defined results: a null text has no terms, nor has a null query. Documents without an id count in
the statistics and rank behind all others of the same score; rows that repeat an id are documents
each. Queries that repeat an id, or have none, are searched each; they share the id in the
result. Of documents of equal score and id any order holds, as they can't be told apart. Words and texts of any
length are read whole, long texts in runs of CHUNK bytes. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import importable, materialize, release, trimmed

#: Distinct terms and bytes of the queries that are searched at once.
QUERY_TERMS, QUERY_BYTES = 1 << 18, 16 << 20
#: Postings a shard holds, about.
POSTINGS = 1 << 20
#: Documents that set the first thresholds, about.
SEED = 4096
CHUNK = 1 << 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased bytes; all bytes of a code point beyond ASCII are among them
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = (1 << 63) - 1  # stands for a missing id


def term_counts(text: bytes) -> Counter:
    """The terms of a UTF-8 text with their numbers of places."""
    if len(text) <= CHUNK:
        return Counter(_TERM.findall(text.lower()))
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        found.update(_TERM.findall(text[at:end].lower()))
        at = end
    return found


def _counting(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ids, sizes, terms, counts, ends = batch.column(0), [], [], [], [0]
            for i in range(len(texts)):  # one text at a time is a Python object
                own = term_counts(texts[i].as_py() or b"")
                sizes.append(sum(own.values()))
                found = sorted((known[w], c) for w, c in own.items() if w in known)
                terms += [t for t, _ in found]
                counts += [c for _, c in found]
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["id", "n", "terms", "tf"],
            )

    return run


def term_scores(weight: np.ndarray | int, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score; all in whole numbers."""
    m = 75 + (25 * n * docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Postings of a run of documents by term, with their scores for a term that a query has once."""

    def __init__(self, ids: np.ndarray, owners: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> None:
        self.ids = ids
        order = np.argsort(terms, kind="stable")  # owners stay in order within a term
        self.docs, self.scores = owners[order], scores[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.bounds = np.maximum.reduceat(self.scores, self.starts) if len(order) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, documents) of all that may be among the k best with scores of at least `least`, and the postings that were read."""
        at = np.searchsorted(self.terms, terms)
        here = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)) if len(self.terms) else np.zeros(0, int)
        at, times = at[here], repeats[here]
        most = self.bounds[at] * times
        order = np.argsort(most, kind="stable")
        at, times, most = at[order], times[order], most[order]
        below = np.cumsum(most)  # what all terms up to one can add
        first = int(np.searchsorted(below, least, side="left")) if least > 0 else 0  # terms before it are non-essential
        total, read = np.zeros(len(self.ids), np.int64), 0
        for t in range(first, len(at)):
            some = slice(self.starts[at[t]], self.ends[at[t]])
            total[self.docs[some]] += self.scores[some] * times[t]
            read += some.stop - some.start
        alive = np.flatnonzero(total)
        for t in range(first - 1, -1, -1):
            least = max(least, _kth(total[alive], k))
            alive = alive[total[alive] + below[t] >= least]
            if not len(alive):
                break
            some = slice(self.starts[at[t]], self.ends[at[t]])
            docs = self.docs[some]
            place = np.searchsorted(docs, alive)
            hit = np.flatnonzero(docs[np.minimum(place, len(docs) - 1)] == alive)
            total[alive[hit]] += self.scores[some][place[hit]] * times[t]
            read += len(hit)
        scores = total[alive]
        stay = (scores >= max(least, _kth(scores, k))) & (scores > 0)
        return scores[stay], alive[stay], read


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _searching(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = asked.value
        queries, weights, docs, total = sent["queries"], sent["weights"], sent["docs"], sent["total"]
        least = list(sent["least"])
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        held: list[list[np.ndarray]] = [[], [], [], []]

        def search() -> None:
            if not held[0]:
                return
            ids, lens, terms, scores = (np.concatenate(x) for x in held)
            for x in held:
                x.clear()
            shard = Shard(ids, np.repeat(np.arange(len(ids)), lens), terms, scores)
            for q, (own, repeats) in enumerate(queries):
                found, at, _ = shard.search(own, repeats, k, least[q])
                if len(at):
                    order = np.lexsort((ids[at], -found))[:k]
                    best[q] = sorted([*best[q], *zip((-found[order]).tolist(), ids[at[order]].tolist(), strict=True)])[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], -best[q][-1][0])

        for batch in batches:
            step = max(1, POSTINGS // max(1, len(batch.column(2).flatten()) // max(1, len(batch))))
            for a in range(0, len(batch), step):
                some = batch.slice(a, step)
                lens = pc.list_value_length(some.column(2)).to_numpy()
                terms, tf = (some.column(c).flatten().to_numpy() for c in (2, 3))
                n = np.repeat(some.column(1).to_numpy(), lens)
                held[0].append(some.column(0).fill_null(_LAST).to_numpy())
                held[1].append(lens)
                held[2].append(terms)
                held[3].append(term_scores(weights[terms], tf, n, docs, total))
                if sum(map(len, held[2])) >= POSTINGS or sum(map(len, held[0])) >= POSTINGS:
                    search()
        search()
        rows = [(q, None if i == _LAST else i, -s) for q, own in enumerate(best) for s, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["q", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, queries: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of some queries, written to the shared folder."""
    spark = docs.sparkSession
    vocabulary = {w: t for t, w in enumerate(sorted(set().union(*(c for _, c in queries))))}
    words = spark.sparkContext.broadcast(vocabulary)
    counted = materialize(docs.mapInArrow(trimmed(_counting(words)), "id long, n long, terms array<int>, tf array<long>"), "terms")
    totals = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("total")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a query term
        df[r["t"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * totals["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    asked = [(np.array(sorted(vocabulary[w] for w in c), np.int64), c) for _, c in queries]
    inverse = sorted(vocabulary, key=vocabulary.get)
    own = [(terms, np.array([c[inverse[t]] for t in terms], np.int64)) for terms, c in asked]
    sent = {"queries": own, "weights": weights, "docs": totals["docs"], "total": totals["total"] or 1, "least": [0] * len(own)}
    shape = "q int, doc_id long, score long"
    first = spark.sparkContext.broadcast(sent)
    seed = counted.filter(F.pmod(F.xxhash64("id", "n"), F.lit(max(1, totals["docs"] // SEED))) == 0)  # sets thresholds only; all are searched below
    for r in _ranked(seed.mapInArrow(trimmed(_searching(first, k)), shape), k).filter(F.col("rank") == k).collect():  # a row a query at most
        sent["least"][r["q"]] = r["score"]
    last = spark.sparkContext.broadcast(sent)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], "q int, item_id long")
    ranked = _ranked(counted.mapInArrow(trimmed(_searching(last, k)), shape), k).join(F.broadcast(names), "q")
    made = materialize(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    release(counted)
    for b in (words, first, last):
        b.destroy()
    return made


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """Queries as (id, terms), a block at a time."""
    block: list[tuple[int | None, Counter]] = []
    terms, size = set(), 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        own = term_counts((r["t"] or "").encode())
        if block and (len(terms | own.keys()) > QUERY_TERMS or size + sum(map(len, own)) > QUERY_BYTES):
            yield block
            block, terms, size = [], set(), 0
        block.append((r["i"], own))
        terms |= own.keys()
        size += sum(map(len, own)) + 8 * len(own)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k documents of the highest scores above 0."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in query_blocks(items, item_col, item_text):
        found = found.unionByName(_search_block(texts, block, k))
    return found
