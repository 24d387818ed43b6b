"""Toxicity by a string-kernel support vector machine with Nystroem landmarks (operator 1).

Kernel. Two words are compared by the gapped subsequences of three characters they share,
each weighted by DECAY to the power of the stretch it spans, up to SPAN characters. Characters
that are neither letters nor digits only widen the stretch, so inserted ones weaken a match
but don't break it; runs of single characters ("x y z w") are read as one word. A word's
vector is divided by the square root of its summed squared weights.

Nystroem. Landmarks are words of training sentences; a word's features are its kernel with
the landmarks times the inverse square root of the landmarks' own kernel matrix, and a
linear SVM (squared hinge) is fitted on them. The kernel is a sum over subsequences, so the
fitted function is too: its weights are folded into one table over three-character
subsequences, and scoring a word looks its subsequences up, whatever the number of landmarks.

Training. Sentences carry their document's label; a sentence is as toxic as its worst word.
Witnesses of toxic sentences are first the words that clean sentences lack, then those the
machine itself finds worst; clean words that it finds worst are added as negatives, round by
round. A document's score is a logistic function of three things, none of which lowers it as
it grows: its worst word's value, the next worst's (a word that stands twice is its own next),
and the logarithm of the share of its words that are bad, so that a few words that chance makes
alike don't condemn a long text and one insult repeated condemns a short one.

At most SAMPLE labelled rows of each class are learned from, and SAMPLE_CHARS characters of
them, taken in the order of a hash of doc_id; lengths are looked at first, so no more text than
that is gathered. Words over LONG characters, such as base64, are scored whole but not learned
from. Scores read nothing but the text.

Defined results: null and empty texts get the score of a text without words. Labels that are
null are not learned from; of repeated labels of a document the larger counts. Without both
classes every score is the share of toxic labels (0 without labels). Repeated rows get equal
scores. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.bpe import slices
from tallyweave.llm.common import give_back, importable, new_name, text_slices, trimmed

SAMPLE = 2000
SAMPLE_CHARS = 12_000_000
LANDMARKS = 192
DECAY = 0.6
SPAN = 7
ROUNDS = 4
#: Log-likelihood ratio from which a word tells toxic from clean documents.
EVIDENCE = 12.0
#: Clean words that each round learns from, at most.
NEGATIVES = 20_000
#: Words whose values a worker keeps at most.
CACHE_WORDS = 250_000
THRESHOLD = 0.3
#: Value from which a word counts as wholly bad in a text's share of bad words; below, in proportion.
CERTAIN = 0.5
#: Bad words and words that every text is taken to have besides its own, so that a short text's share is steady.
PRIOR_HITS, PRIOR_WORDS = 0.2, 50
#: Characters, with padding, that are coded together.
CELLS = 1 << 20
#: Length over which a word is neither learned from nor kept in a cache.
LONG = 256
#: Bytes of text that a worker holds as Python objects.
SLICE = 2_000_000

_GAP = 63
_STRIP = " \t\n\r\v\f.,;:!?\"'()[]{}<>|*#$%&+-_/\\~`^=@"
_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Codes of the first 65536 characters: letters and digits of ASCII have their own, other letters share the rest.
_CODE = np.full(0x10000, _GAP, np.uint8)
for _i in range(0x10000):
    _c = chr(_i)
    if "a" <= _c <= "z":
        _CODE[_i] = _i - 97
    elif "0" <= _c <= "9":
        _CODE[_i] = 26 + _i - 48
    elif _c.isalnum():
        _CODE[_i] = 36 + _i % 27


def counted(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words without edge punctuation, and the words that runs of single characters spell; how often each stands there.

    A word may be listed more than once, with a part of its number each time.
    """
    low = text.lower()
    found = Counter(low.split())
    spelled = ["".join(x.split()) for x in _SPELLED.findall(low)]
    return [*[w.strip(_STRIP) for w in found], *spelled], [*found.values(), *[1] * len(spelled)]


def words_of(text: str) -> list[str]:
    """The words of `counted`."""
    return counted(text)[0]


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of the words, a row each, and their lengths; words of like length are best passed together."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lens.max(initial=0))
    chars = np.array(words, f"<U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)
    return np.where(chars < 0x10000, _CODE[np.minimum(chars, 0xFFFF)], 36 + chars % 27).astype(np.int64), lens


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(index of the three characters for every row and start, weight) for each pair of gaps; gaps' indexes are 63 somewhere."""
    n = codes.shape[1]
    for span in range(3, min(SPAN, n) + 1):
        first, last = codes[:, : n - span + 1] << 12, codes[:, span - 1 :]
        for mid in range(1, span - 1):
            yield first | codes[:, mid : n - span + 1 + mid] << 6 | last, DECAY ** (span - 3)


_WHOLE = np.ones((64, 64, 64), np.float32)
_WHOLE[_GAP] = _WHOLE[:, _GAP] = _WHOLE[:, :, _GAP] = 0
_WHOLE = _WHOLE.ravel()
_SQUARES: dict[int, float] = {}


def _norms(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of each row's subsequences; 1 where there are none."""
    out = np.zeros(len(codes), np.float64)
    gaps = ((codes == _GAP) & (np.arange(codes.shape[1]) < lens[:, None])).any(axis=1)
    for n in np.unique(lens).tolist():
        if n not in _SQUARES:
            _SQUARES[n] = sum((n - s + 1) * (s - 2) * DECAY ** (2 * (s - 3)) for s in range(3, min(SPAN, n) + 1))
        out[(lens == n)] = _SQUARES[n]
    odd = np.flatnonzero(gaps)
    if len(odd):
        out[odd] = sum(w * w * _WHOLE.take(x).sum(axis=1) for x, w in _subsequences(codes[odd]))
    return np.sqrt(np.where(out > 0, out, 1.0))


def _by_length(words: list[str], step: int = 4096) -> Iterator[np.ndarray]:
    """Positions of the words in runs of like length, of at most `step` words and, padded to their longest, CELLS characters; a longer word is a run of its own."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    at = 0
    while at < len(order):
        own = lens[order[at : at + step]]
        many = max(1, int(np.count_nonzero(own * np.arange(1, len(own) + 1) <= CELLS)))
        yield order[at : at + many]
        at += many


def table_values(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table over each word's weighted subsequences, over the word's norm. table: 64**3, zero at gaps."""
    out = np.zeros(len(words), np.float64)
    for rows in _by_length(words):
        if len(words[rows[0]]) > CELLS:  # alone in its run
            out[rows] = _long_value(words[rows[0]], table)
            continue
        codes, lens = _coded([words[i] for i in rows.tolist()])
        total = np.zeros(len(rows), np.float64)
        for index, weight in _subsequences(codes):
            total += weight * table.take(index).sum(axis=1)
        out[rows] = total / _norms(codes, lens)
    return out


def _long_value(word: str, table: np.ndarray) -> float:
    """The same for one long word, a window of starting places at a time."""
    total = squares = 0.0
    for at in range(0, len(word), CELLS):
        codes, _ = _coded([word[at : at + CELLS + SPAN - 1]])
        for index, weight in _subsequences(codes):
            total += weight * float(table.take(index[:, :CELLS]).sum(dtype=np.float64))
            squares += weight * weight * float(_WHOLE.take(index[:, :CELLS]).sum(dtype=np.float64))
    return total / np.sqrt(squares or 1.0)


def subsequence_rows(words: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` weights for each word, divided by its norm; place gives a subsequence's column, `width` for none."""
    out = np.zeros((len(words), width + 1))
    for rows in _by_length(words):
        codes, lens = _coded([words[i] for i in rows.tolist()])
        for index, weight in _subsequences(codes):
            np.add.at(out, (np.repeat(rows, index.shape[1]), place[index].ravel()), weight)
        out[rows] /= _norms(codes, lens)[:, None]
    return out[:, :width]


def subsequences_of(words: list[str]) -> np.ndarray:
    """All subsequences, without gaps, that the words have."""
    found = [np.unique(index) for w in words for index, _ in _subsequences(_coded([w])[0])]
    whole = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return whole[_WHOLE[whole] > 0]


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter or a sign put in somewhere inside."""
    at = [int(x) for x in rng.integers(1, len(word), 3)]
    extra = [chr(97 + int(rng.integers(26))), ".", word[at[2] - 1]]
    return [word[:p] + c + word[p:] for p, c in zip(at, extra, strict=True)]


def _evidence(k1: int, n1: int, k0: int, n0: int) -> float:
    """Log-likelihood ratio that a word's share of toxic documents isn't its share of clean ones."""
    total = 0.0
    for k, n in ((k1, n1), (k0, n0)):
        share = (k1 + k0) / (n1 + n0)
        for x, p in ((k, share), (n - k, 1 - share)):
            if x:
                total += 2 * x * np.log(x / (n * p))
    return total


@dataclass
class Machine:
    """A fitted scorer. `table` holds the folded weights; without it every text gets `prior`."""

    table: np.ndarray | None = None
    bias: float = 0.0
    slope: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float = 0.0
    cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def values(self, words: list[str]) -> list[float]:
        new = list({w for w in words if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(set(words))
        self.cache.update(zip(new, (table_values(new, self.table) + self.bias).tolist(), strict=True))
        out = list(map(self.cache.__getitem__, words))
        for w in new:
            if len(w) > LONG:
                del self.cache[w]
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: its worst word's value and the next worst's, from -1.5 to 1.5, and the logarithm of its share of bad words."""
        out = np.full((len(texts), 3), -1.5)
        found = [counted(t) for t in texts]
        values = np.array(self.values([w for words, _ in found for w in words]))
        at = 0
        for i, (words, times) in enumerate(found):
            own, many = values[at : at + len(words)].copy(), np.array(times, np.int64)
            at += len(words)
            hits = float((many * np.clip(own / CERTAIN, 0, 1)).sum())
            out[i, 2] = np.log((hits + PRIOR_HITS) / (many.sum() + PRIOR_WORDS))
            for j in range(min(2, int(many.sum()))):
                worst = int(own.argmax())
                out[i, j] = own[worst]
                if many[worst] == 1:
                    own[worst] = -np.inf
        out[:, :2] = np.clip(out[:, :2], -1.5, 1.5)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.slope[0] + self.features(texts) @ np.array(self.slope[1:]))))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(30):
        inside = y * (x @ w) < 1
        xa = x[inside] * weight[inside, None]
        new = np.linalg.solve(xa.T @ x[inside] + np.diag(ridge), xa.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new if _ < 10 else (w + new) / 2
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Constant and slopes; columns whose slope would be negative are left out, the most negative first."""
    used = list(range(x.shape[1]))
    while True:
        own = np.hstack([np.ones((len(x), 1)), x[:, used]])
        w = np.zeros(own.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(own @ w)))
            h = weight * p * (1 - p)
            step = np.linalg.solve((own * h[:, None]).T @ own + 1e-2 * np.eye(len(w)), own.T @ (weight * (y - p)) - 1e-2 * w)
            w = w + step
            if np.abs(step).max() < 1e-7:
                break
        if not used or w[1:].min() >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *[j + 1 for j in used]]] = w
            return tuple(out.tolist())
        del used[int(w[1:].argmin())]


def fit(texts: list[str], labels: list[int], share: float | None = None, landmarks: int = LANDMARKS) -> Machine:
    """Fit on labelled texts; `share` is the share of toxic texts at large, where the sample isn't drawn evenly."""
    y = np.array(labels, int)
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if not len(y) or y.min() == y.max():
        return Machine(prior=share)
    bad, good = Counter(), Counter()
    one: dict[str, str] = {}  # a word is kept once, whatever sentences it stands in
    sentences: list[list[tuple[str, ...]]] = []  # of toxic texts only
    for label, text in zip(labels, texts, strict=True):
        if label:
            sentences.append([tuple(one.setdefault(w, w) for w in set(words_of(s)) if len(w) <= LONG) for s in _SENTENCE.split(text)])
            bad.update({w for s in sentences[-1] for w in s})
        else:
            good.update({one.setdefault(w, w) for s in _SENTENCE.split(text) for w in words_of(s) if len(w) <= LONG})
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    odds = {w: np.log((k + 0.1) / n1) - np.log((good[w] + 0.5) / n0) for w, k in bad.items() if len(w) > 2}
    worst = sorted((w for w in odds if odds[w] > 1.5 and _evidence(bad[w], n1, good[w], n0) > EVIDENCE), key=lambda w: (-odds[w] * min(bad[w], 30), w))[: 4 * landmarks]
    worst = worst or sorted(odds, key=lambda w: (-_evidence(bad[w], n1, good[w], n0), w))[:8]
    if not worst:
        return Machine(prior=share)
    rng = np.random.default_rng(5)
    suspect = set(worst)
    clean = sorted(w for w in good if len(w) > 2 and w not in suspect)
    picked = [clean[i] for i in rng.permutation(len(clean))[:NEGATIVES].tolist()]
    marks = list(dict.fromkeys([*worst[: landmarks * 2 // 3], *picked[: landmarks // 3]]))
    seen = subsequences_of(marks)
    place = np.full(64**3, len(seen))
    place[seen] = np.arange(len(seen))
    rows = subsequence_rows(marks, place, len(seen))
    values, vectors = np.linalg.eigh(rows @ rows.T)
    kept = values > 1e-4 * values.max()
    project = rows.T @ (vectors[:, kept] / np.sqrt(values[kept]))  # subsequences x features

    def features(words: list[str]) -> np.ndarray:
        parts = [subsequence_rows(words[i : i + 512], place, len(seen)) @ project for i in range(0, len(words), 512)]
        return np.vstack(parts) if parts else np.zeros((0, project.shape[1]))

    witness, negative = list(worst), picked[:4000]
    known: dict[str, np.ndarray] = {}
    table, bias = np.zeros(64**3, np.float32), 0.0
    for turn in range(ROUNDS):
        if turn:
            value = dict(zip(odds, table_values(list(odds), table) + bias, strict=True))
            found = Counter()
            for parts in sentences:  # the worst word of each sentence where the machine finds one, or else of the document
                tops = [max((value.get(w, -9), w) for w in p) for p in parts if p]
                found.update([w for v, w in tops if v > 0] or ([max(tops)[1]] if tops else []))
            more = [w for w, k in found.most_common(4000) if odds.get(w, -9) > 1.5 and (k > 2 or value[w] > 0.5)]
            witness = list(dict.fromkeys([*worst, *more]))
            own = set(witness)
            rest = [w for w in clean if w not in own]
            hard = np.argsort(-table_values(rest, table), kind="stable")[:2000]
            negative = list(dict.fromkeys([*negative, *[rest[i] for i in hard.tolist()]]))
        hidden = [(v, 0.1 * bad[w]) for w in witness if w in suspect and len(w) > 4 for v in disguised(w, rng)]
        masked = [v for v, _ in hidden]
        own = set(witness) | set(masked)
        words = [*witness, *masked, *[w for w in negative if w not in own]]
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, features(new), strict=True))
        x, plus = np.array([known[w] for w in words]), len(witness) + len(masked)
        sign = np.where(np.arange(len(words)) < plus, 1.0, -1.0)
        weight = np.array([float(bad[w]) for w in witness] + [k for _, k in hidden] + [1.0] * (len(words) - plus))
        weight[:plus] *= max(1.0, 0.5 * weight[plus:].sum()) / weight[:plus].sum()
        w, bias = _svm(x, sign, weight)
        table = np.zeros(64**3, np.float32)
        table[seen] = project @ w
    del sentences, one, good, bad, odds, clean, known, project
    made = Machine(table=table, bias=bias, prior=share)
    adjust = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    seen_features = []
    for part in slices(texts, 2_000_000):
        seen_features.append(made.features(part))
        made.cache.clear()
    made.slope = _logistic(np.vstack(seen_features), y, adjust)
    return made


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Machine:
    """Fit on labelled documents outside the held-out rows: `sample` of a class and `chars` characters at most.

    Texts of more than `chars` characters are not learned from. Rows that repeat a doc_id are learned from
    each, equal ones once.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Machine()
    share = counts.get(1, 0) / sum(counts.values())
    spark = docs.sparkSession
    kind = known.schema["doc_id"].dataType.simpleString()
    picked = [tuple(r) for y in (1, 0) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y").collect()]
    small = spark.createDataFrame(picked, f"doc_id {kind}, y int")
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = src.join(F.broadcast(small), "doc_id").select("doc_id", "y", F.length("text").alias("n"), F.xxhash64("text").alias("row")).filter(F.col("n") <= chars)
    order, total = [], 0
    for r in rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(2 * sample).collect():  # lengths only
        total += r["n"]
        if total > chars:
            break
        order.append((r["doc_id"], r["row"], r["y"]))
    wanted = spark.createDataFrame([x[:2] for x in order], f"doc_id {kind}, row long")
    found = src.withColumn("row", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "row"]).groupBy("doc_id", "row").agg(F.first("text").alias("text"))
    texts = {(r["doc_id"], r["row"]): r["text"] for r in found.collect()}  # `chars` characters at most
    made = fit([texts[x[:2]] for x in order], [x[2] for x in order], share)
    texts.clear()
    give_back()
    return made


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every text."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _scored(src, machine, ["doc_id"], "score")


def _scored(docs: DataFrame, machine: Machine, columns: list[str], name: str) -> DataFrame:
    """The columns of docs, and the score under that name."""
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, done = batch.schema.get_field_index("text"), 0
            for part in text_slices(batch.column(at), SLICE):
                yield batch.slice(done, len(part)).select(columns).append_column(name, pa.array(own.scores(part)))
                done += len(part)

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.select(columns).schema.fields, T.StructField(name, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 from `threshold` on."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under `threshold`, with their columns."""
    name = new_name(docs, "_score")
    return _scored(docs, train(docs, labels), docs.columns, name).filter(F.col(name) < threshold).drop(name)
