"""Toxicity by multiple-instance learning.

A document is a bag of sentences and toxic when one of them is.  A linear model
over hashed word features scores each sentence; the document's score is the
noisy-or of its sentences, ``1 - prod(1 - p_sentence)``.  Only documents carry
labels: the gradient of the noisy-or hands each label down to the sentences
that account for it, so the fitted model also tells which sentence offends.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each
class, by the order of a hash of their ids, and ``SAMPLE_BYTES`` of text in all,
texts of more than a hundredth of it passed over; rows of the larger class weigh what
they stand for); every row is scored, by its whole text.  One task fits: neither
texts nor features of the sample come to the driver, only the model's weights.

Features of a word: itself, its first 3 to 6 and 8 bytes, its last 4, in lower
case (ASCII).  A sentence ends at ``.``, ``!``, ``?``, ``|`` or a line's end.
Nothing but the text enters a score.

Defined results: a null or empty text is one empty sentence; a null id counts
as the text '' in the hold-out rule; a null label is no label; repeated rows are
rows each; without labels of both classes every score is the prior; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import byte_codes, kept_rows, map_arrow, mix64, powers, slices, spans, texts, utf8

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Bytes of text that the model is fitted on, at most.
SAMPLE_BYTES = 64 << 20
#: Hashed features, as a power of two.
BITS = 19
#: Documents of the sample that must hold a feature, and the least odds (either way) it must have.
LEAST_DOCUMENTS, LEAST_ODDS = 5, 6.0
ROUNDS, RATE, SHRINK = 100, 0.15, 1e-4
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
PREFIXES, SUFFIX = (3, 4, 5, 6, 8), 4
SCHEMA = "doc_id long, score double, worst_start long, worst_end long, worst_score double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (97, 123)):
    _WORD[_a:_b] = True
_WORD[ord("'")] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?|\n"]] = True
_CODES = np.stack([byte_codes(101 + j) for j in range(max(PREFIXES) + SUFFIX + 1)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Sentences:
    """Words of some texts: their features, sentence by sentence."""
    features: np.ndarray   # words x kinds, a bucket each; 0 stands for none
    word_sentence: np.ndarray
    sentence_doc: np.ndarray
    start: np.ndarray      # in bytes, of each sentence
    end: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    n, docs = len(data), len(offsets) - 1
    low = _LOWER[data]
    # a sentence starts at each document and after each end mark inside one
    first = np.zeros(n + 1, bool)
    first[1:][_END[low]] = True
    first[offsets] = True
    first[n] = False
    starts = np.unique(np.concatenate([np.flatnonzero(first), offsets[:-1][offsets[:-1] < n]]))
    held = np.searchsorted(offsets, starts, "right") - 1
    # an empty document has a sentence as well
    empty = np.flatnonzero(offsets[1:] == offsets[:-1])
    sentence_doc = np.concatenate([held, empty])
    ends = np.append(starts[1:], n) if len(starts) else starts
    start, end = np.concatenate([starts, offsets[empty]]), np.concatenate([ends, offsets[empty]])
    inside = _WORD[low]
    words, until = spans(inside, offsets)
    length = until - words
    mask = np.uint64((1 << BITS) - 1)
    columns = []
    padded = np.concatenate([low, np.zeros(16, np.uint8)])
    h = np.zeros(len(words), np.uint64)
    done = 0
    for j in range(max(PREFIXES)):
        h = h + _CODES[j][padded[words + j]]
        done = j + 1
        if done in PREFIXES:
            f = (mix64(h + np.uint64(done)) & mask).astype(np.int32)
            columns.append(np.where(length >= done, f, 0))
    h = np.full(len(words), 77, np.uint64)
    for j in range(SUFFIX):
        h = h + _CODES[max(PREFIXES) + j][padded[np.maximum(until - 1 - j, 0)]]
    columns.append(np.where(length >= SUFFIX, (mix64(h) & mask).astype(np.int32), 0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[-1][low] * powers(_STEP, n)[:n], out=sums[1:], dtype=np.uint64)
    h = (sums[until] - sums[words]) * powers(_BACK, n)[words] if len(words) else np.zeros(0, np.uint64)
    columns.append((mix64(h) & mask).astype(np.int32))
    word_sentence = np.searchsorted(starts, words, "right") - 1
    return Sentences(np.stack(columns, 1) if len(words) else np.zeros((0, len(columns)), np.int32),
                     word_sentence, sentence_doc, start, end)


@dataclass
class Model:
    """The features that have a weight, in order, and their weights."""
    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._all = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_all": None}

    def sentence_margins(self, s: Sentences) -> np.ndarray:
        if self._all is None:
            self._all = np.zeros(1 << BITS, np.float32)
            self._all[self.feature] = self.weight
        by_word = self._all[s.features].sum(1) if len(s.features) else np.zeros(0)
        return self.bias + np.bincount(s.word_sentence, by_word, len(s.sentence_doc))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-z))


def fit(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Noisy-or likelihood by gradient steps on the sample; ``weight`` of each document."""
    docs = len(offsets) - 1
    parts = [(a, sentences(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])) for a, b in slices(offsets, SLICE)]
    prior = float(np.clip((weight * toxic).sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6)) if docs else 1e-3
    n_sentences = sum(len(s.sentence_doc) for _, s in parts)
    # a sentence's margin at the prior: all of a document's sentences together give it
    start = float(np.log(prior / (1 - prior))) - float(np.log(max(n_sentences / max(docs, 1), 1.0)))
    model = Model(np.zeros(0, np.int64), np.zeros(0), start)
    if not docs or not toxic.any() or toxic.all():
        return model
    # how many documents of each class hold a feature
    held = np.zeros((2, 1 << BITS))
    for a, s in parts:
        doc = s.sentence_doc[s.word_sentence]
        pairs = np.unique(doc[:, None].astype(np.int64) << BITS | s.features)
        of = toxic[a + (pairs >> BITS)].astype(int)
        feature = pairs & ((1 << BITS) - 1)
        for c in (0, 1):
            held[c] += np.bincount(feature[of == c], minlength=1 << BITS)
    share = (held + 0.5) / (np.array([[docs - toxic.sum()], [toxic.sum()]]) + 1.0)
    odds = share[1] / share[0]
    use = (held.sum(0) >= LEAST_DOCUMENTS) & ((odds >= LEAST_ODDS) | (odds <= 1 / LEAST_ODDS))
    use[0] = False
    name = np.flatnonzero(use)
    index = np.full(1 << BITS, -1, np.int64)
    index[name] = np.arange(len(name))
    feature, sentence, doc_of, at = [], [], [], 0
    for a, s in parts:
        k = index[s.features]
        row, column = np.nonzero(k >= 0)
        feature.append(k[row, column])
        sentence.append(s.word_sentence[row] + at)
        doc_of.append(s.sentence_doc + a)
        at += len(s.sentence_doc)
    feature, sentence, doc_of = np.concatenate(feature), np.concatenate(sentence), np.concatenate(doc_of)
    w, bias = np.zeros(len(name)), start
    mean, square = np.zeros(len(name) + 1), np.zeros(len(name) + 1)
    total = weight.sum()
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, w[feature], at)
        none = np.bincount(doc_of, -softplus(z), docs)     # log of the chance that no sentence offends
        some = -np.expm1(none)
        pull = np.where(toxic, -np.exp(none) / np.maximum(some, 1e-12), 1.0) * weight / total
        g = pull[doc_of] * sigmoid(z)
        gradient = np.append(np.bincount(feature, g[sentence], len(name)) + SHRINK * w, g.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model(name, w, float(bias))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents of each class that aren't held out."""
    named = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for c in (0, 1):
        part = named.where(F.col("toxic") == c).orderBy(*order).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample ids, so they may be broadcast
    rows = (texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
            .where(F.octet_length("text") <= sample_bytes // 100))
    # of at most 2 * sample rows, those that fit
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        toxic = np.concatenate([np.zeros(0, bool)] + [np.asarray(b.column(1).to_pylist(), dtype=bool) for b in held])
        parts = [utf8(b.column(2)) for b in held]
        data = np.concatenate([np.zeros(0, np.uint8)] + [d for d, _ in parts])
        offsets = np.cumsum(np.concatenate([[0]] + [np.diff(o) for _, o in parts]).astype(np.int64))
        got = {c: max(1, int((toxic == bool(c)).sum())) for c in (0, 1)}
        weight = np.where(toxic, n.get(1, 0) / got[1], n.get(0, 0) / got[0])
        model = fit(data, offsets, toxic, weight)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.feature, model.weight)]
                                         + [pa.array([model.bias])], ["feature", "weight", "bias"])

    chosen_rows = rows.select("doc_id", "toxic", "text").repartition(1).sortWithinPartitions("doc_id")
    found = map_arrow(chosen_rows, run, "feature binary, weight binary, bias double").first()
    if found is None:
        return fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0))
    return Model(np.frombuffer(found["feature"], np.int64), np.frombuffer(found["weight"]), found["bias"])


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Score, start and end (code points) of the worst sentence, and its score, of each text."""
    out = []
    for a, b in slices(offsets, SLICE):
        part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        s = sentences(part, own)
        z = model.sentence_margins(s)
        p = -np.expm1(np.bincount(s.sentence_doc, -softplus(z), b - a))
        order = np.lexsort((-s.start, z, s.sentence_doc))   # each document's last is its worst, the first of equals
        last = order[np.append(np.flatnonzero(np.diff(s.sentence_doc[order])), len(order) - 1)]
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        base = points[own[:-1]]
        out.append((p, points[s.start[last]] - base, points[s.end[last]] - base, sigmoid(z[last])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 4


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` and the sentence that offends most (code points, end exclusive) with its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, start, end, worst = document_scores(model, *utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array(start.astype(np.int64)),
                 pa.array(end.astype(np.int64)), pa.array(worst, pa.float64())],
                ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return map_arrow(texts(docs, id_col, text_col), run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, whole and as they are, that score less than 0.5; no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = document_scores(model, *utf8(batch.column(place)))[0]
            yield from kept_rows(batch, place, p < 0.5)

    return map_arrow(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the worst sentence of every document."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "worst_start", "worst_end", "worst_score")
