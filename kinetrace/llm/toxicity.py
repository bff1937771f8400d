"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
the words in it and of how they begin, and the document's is their noisy-or: toxic if any sentence is.
Only documents carry labels; the gradient of the document's likelihood reaches
the sentences that explain it, so the trained model also tells where the offence
is (``offending_sentences``).

The model is fitted on at most ``MAX_LABELLED`` labelled rows, chosen by hash of
their id; every document is scored, whole.

Defined results: a null or empty text has no sentence, and scores 0; a label that
is null, or whose row is missing, is not learnt from; rows repeated in the labels
count once, as toxic if any says so; rows repeated in the documents are scored
each; without any label the score is that of an untrained model, near 0; an empty
table gives no rows; other columns may have any name; of equally bad sentences the first is the worst.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, slices, text_or_empty

#: Labelled rows that the fit sees at most; documents that a word must be in to count.
MAX_LABELLED, MIN_DOCUMENTS = 6_000, 3
#: Beginnings of words that are features beside the word.
PREFIXES = (3, 4, 5)
STEPS, RATE, DECAY, FIRST_BIAS = 200, 0.25, 1e-5, -10.0
SENTENCE = re.compile(rb"[.!?\n\r]+")
EDGES = b"\"'`.,;:()[]{}<>*#$%&|-_~^"
#: Entries of a worker's table of words, which is emptied beyond them.
CACHE = 100_000


def word_keys(token: bytes) -> list[int]:
    """Features of a lower-case token without punctuation at its ends: the word, and its beginnings."""
    word = token.strip(EDGES).decode(errors="replace").lower()
    if not word:
        return []
    return [xxhash.xxh3_64_intdigest("=" + word), *(xxhash.xxh3_64_intdigest(word[:n]) for n in PREFIXES if len(word) > n)]


def sentences(text: str) -> list[list[bytes]]:
    """Lower-case tokens of the sentences that have any."""
    return [words for s in SENTENCE.split(text.encode().lower()) if (words := s.split())]


@dataclass
class Model:
    """Words' weights by sorted feature, and the bias of a sentence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> _Weights:
        return _Weights(self)


class _Weights(dict):
    """Token -> weight."""

    def __init__(self, model: Model):
        super().__init__()
        self.by_key = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def __missing__(self, token: bytes) -> float:
        if len(self) > CACHE:
            self.clear()
        found = self[token] = sum(self.by_key.get(k, 0.0) for k in word_keys(token))
        return found


def sentence_logits(text: str, weights: _Weights, bias: float) -> np.ndarray:
    """Log odds of each sentence; every distinct word counts once."""
    get = weights.__getitem__
    return np.array([bias + sum(map(get, set(words))) for words in sentences(text)])


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(logit))."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def training_bags(docs: DataFrame, labels: DataFrame, learn_from, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(toxic, text) of the labelled sample: at most ``max_labelled`` ids, one row for each document with one of them."""
    # At most ``max_labelled`` rows of two numbers each.
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text")


def fit(bags: Iterable[tuple[int, str]], steps: int = STEPS) -> Model:
    """Maximum likelihood of the documents' labels under noisy-or, by Adam."""
    vocabulary: dict[bytes, int] = {}
    toxic, words, of_sentence, of_document = [], [], [], []
    n_sentences = 0
    for label, text in bags:
        of = sentences(text)
        own = [set(s) for s in of]
        words.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for s in own for w in s), np.int32))
        of_sentence.append(np.repeat(np.arange(n_sentences, n_sentences + len(of), dtype=np.int32), [len(s) for s in own]))
        of_document.append(np.full(len(of), len(toxic), np.int32))
        toxic.append(label)
        n_sentences += len(of)
    none = Model(np.array([], dtype=np.uint64), np.array([]), FIRST_BIAS)
    if not n_sentences:
        return none
    toxic, document_of_sentence = np.array(toxic, dtype=float), np.concatenate(of_document)
    # Features of words, and the documents that have each.
    keys_of = [word_keys(w) for w in vocabulary]
    feature = np.array([k for keys in keys_of for k in keys], dtype=np.uint64)
    word = np.repeat(np.arange(len(keys_of)), list(map(len, keys_of)))
    keys, feature = np.unique(feature, return_inverse=True)
    documents_with = np.bincount(word, minlength=len(keys_of)) * 0
    for own in words:
        documents_with[np.unique(own)] += 1
    often = np.bincount(feature, documents_with[word], len(keys)) >= MIN_DOCUMENTS
    keep, number = often[feature], np.cumsum(often) - 1
    keys, feature, word = keys[often], number[feature[keep]], word[keep]
    if not len(keys):
        return none
    words, of_sentence = np.concatenate(words), np.concatenate(of_sentence)

    values = np.zeros(len(keys) + 1)
    values[-1] = FIRST_BIAS
    mean, square = np.zeros_like(values), np.zeros_like(values)
    vocabulary.clear()
    for step in range(1, steps + 1):
        of_word = np.bincount(word, values[feature], len(keys_of))
        logits = np.bincount(of_sentence, of_word[words], n_sentences) + values[-1]
        chance = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        total = np.bincount(document_of_sentence, np.logaddexp(0, logits), len(toxic))
        # d(-log likelihood)/d(total): 1 for clean bags, -1/(e^total - 1) for toxic ones.
        outer = np.where(toxic > 0, -1 / np.maximum(np.expm1(np.minimum(total, 40)), 1e-6), 1.0)
        per_sentence = np.clip(outer, -50, 50)[document_of_sentence] * chance
        per_word = np.bincount(words, per_sentence[of_sentence], len(keys_of))
        gradient = np.append(np.bincount(feature, per_word[word], len(keys)), per_sentence.sum()) / len(toxic)
        gradient[:-1] += DECAY * values[:-1]
        mean += 0.1 * (gradient - mean)
        square += 0.001 * (gradient**2 - square)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        values -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        values[:-1] = np.maximum(values[:-1], 0)  # innocent words must not outweigh an insult
    used = values[:-1] > 0
    keys, values = keys[used], np.append(values[:-1][used], values[-1])
    return Model(keys, values[:-1], float(values[-1]))


def train(docs: DataFrame, labels: DataFrame, learn_from, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the bounded sample of labelled rows, which comes to the driver batch by batch."""
    rows = training_bags(docs, labels, learn_from, max_labelled)
    return fit((r["toxic"], r["text"]) for r in rows.toLocalIterator())


def sentence_spans(text: str, weights: _Weights, bias: float):
    """(start, end, score) of each sentence with words, by bytes."""
    raw = text.encode().lower()
    begin = 0
    for end, following in [*(m.span() for m in SENTENCE.finditer(raw)), (len(raw), len(raw))]:
        if words := raw[begin:end].split():
            yield begin, end, noisy_or(np.array([bias + sum(map(weights.__getitem__, set(words)))]))
        begin = following


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, worst_start, worst_end, worst_score) of every row.

    Of a document that is predicted toxic the worst sentence is located: its byte span and score, the
    first of equals; for others they are null.
    """
    def run(batches):
        weights, bias = model.table(), model.bias
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            scores = [noisy_or(sentence_logits(t, weights, bias)) for t in texts]
            worst = [max(sentence_spans(t, weights, bias), key=lambda x: x[2], default=(None,) * 3) if s >= threshold else (None,) * 3 for t, s in zip(texts, scores, strict=True)]
            begin, end, p = zip(*worst, strict=True) if worst else ((),) * 3
            cells = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "score", "predicted", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int, worst_start long, worst_end long, worst_score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        weights, bias = model.table(), model.bias
        for batch in slices(batches):
            clean = [noisy_or(sentence_logits(t or "", weights, bias)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, start, end, score): byte spans of the sentences that reach the threshold."""
    def run(batches):
        weights, bias = model.table(), model.bias
        for batch in slices(batches):
            found = [(row, *span) for row, t in enumerate(batch.column(1).to_pylist()) for span in sentence_spans(t, weights, bias) if span[2] >= threshold]
            row, begin, end, p = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "start", "end", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, start long, end long, score double")


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Train on the rows that are not held out, and score all."""
    model = train(docs, labels, id_remainder(modulus) != held_out)
    return score(docs, model, threshold=threshold).select("doc_id", (id_remainder(modulus) == held_out).alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score")
