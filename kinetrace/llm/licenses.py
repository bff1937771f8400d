"""Licence scans with a trained paragraph classifier.

Paragraphs are lines.  Their word 1- and 2-grams are features of a sparse
multinomial logistic regression over licence families and an unknown class,
trained from public notices, damaged at random, and from sentences that are
none and notices of licences outside the families; a temperature and a least
probability are calibrated on other wordings and on licences that training never
saw.  A prediction is confirmed by comparing the paragraph's n-grams with those
of the family's notices: enough are shared, among them one that only this family has.

Scanning uses DataFrame functions only.  Lines without any word that speaks for
a family are left at once, inside the row and without a shuffle; the few others
meet weights and notices, both fixed tables of some hundred rows, by broadcast.

Defined results: a null text counts as empty and has no paragraph; a line that
some family claims with ``REPORTS`` at least, but none with enough, is reported
as ``unknown``; other lines are no findings; rows repeated in the input are reported
each; a text of any length is scanned whole; an empty table gives no rows; of equally probable families the
later one in the list of templates is named; other columns are not read and may have any name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .license_templates import OTHERS, REWORDED, STRANGERS, STRANGERS_HELD_OUT, TEMPLATES

UNKNOWN = "unknown"
CLASSES = [*TEMPLATES, UNKNOWN]
#: Least share of a notice's n-grams, or of the paragraph's, that confirms a family.
CONFIRMS = 0.6
#: Share of calibration paragraphs of the unknown class that may pass for a family.
FALSE_ALARMS = 0.01
#: Least probability of a family, below which a line is no finding at all.
REPORTS = 0.05
#: Function words, which never make a line a suspect.
FUNCTION_WORDS = {"all", "by", "for", "in", "is", "may", "met", "no", "of", "or", "that", "the", "this", "to", "under", "without", "later", "work"}
WORD = re.compile(r"[a-z0-9]+")


def grams(text: str) -> list[str]:
    """Distinct word 1- and 2-grams."""
    words = WORD.findall(text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


@dataclass
class Classifier:
    """Weights by n-gram and class, bias, temperature and least probability of a family."""

    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def speaking_words(self, at_least: float = 0.5) -> list[str]:
        """Single words whose weight for some family exceeds that for unknown."""
        gain = self.weights[:, :-1].max(axis=1) - self.weights[:, -1]
        return sorted(f for f, g in zip(self.features, gain, strict=True) if " " not in f and g > at_least and len(f) > 1 and f not in FUNCTION_WORDS)


def _damaged(rng: np.random.Generator, text: str, others: list[str]) -> str:
    """A notice as it is found: words lost, other sentences around it."""
    words = text.split()
    if len(words) > 4:
        words = [w for w in words if rng.random() > rng.choice([0, 0.05, 0.15])]
    around = [others[i] for i in rng.integers(len(others), size=int(rng.integers(0, 2)))]
    return " ".join([*around, *words] if rng.random() < 0.5 else [*words, *around])


def _examples(rng: np.random.Generator, per_class: int, notices: dict[str, list[str]], strangers: list[str]) -> tuple[list[str], np.ndarray]:
    """Damaged notices by family; other sentences, scattered words and damaged notices of other licences are unknown."""
    texts, labels = [], []
    every_word = sorted({w for family in TEMPLATES.values() for t in family for w in t.split()})
    for k, family in enumerate(TEMPLATES):
        for i in range(per_class):
            texts.append(_damaged(rng, notices[family][i % len(notices[family])], OTHERS))
            labels.append(k)
    for i in range(3 * per_class):
        scattered = " ".join(rng.choice(every_word, size=int(rng.integers(1, 5))))
        stranger = _damaged(rng, strangers[i // 4 % len(strangers)], OTHERS)
        texts.append([OTHERS[i % len(OTHERS)], f"{OTHERS[i % len(OTHERS)]} {scattered}", scattered, stranger][i % 4])
        labels.append(len(TEMPLATES))
    return texts, np.array(labels)


def own_grams() -> set[tuple[str, str]]:
    """(family, n-gram) of n-grams that no other family, no other licence and no other sentence has."""
    has: dict[str, set[str]] = {}
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, [*OTHERS, *STRANGERS])]:
        for gram in {g for t in texts for g in grams(t)}:
            has.setdefault(gram, set()).add(family)
    return {(*families, gram) for gram, families in has.items() if len(families) == 1 and UNKNOWN not in families}


@lru_cache(maxsize=1)
def train(seed: int = 11, per_class: int = 60, steps: int = 250) -> Classifier:
    """Fit by gradient descent with momentum and decay; a few thousand short paragraphs."""
    rng = np.random.default_rng(seed)
    features = sorted({g for family in TEMPLATES.values() for t in family for g in grams(t)} | {g for t in [*OTHERS, *STRANGERS] for g in grams(t)})
    place = {f: i for i, f in enumerate(features)}

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(features)))
        for row, text in enumerate(texts):
            x[row, [place[g] for g in grams(text) if g in place]] = 1
        return x

    texts, labels = _examples(rng, per_class, TEMPLATES, STRANGERS)
    x, truth = matrix(texts), np.eye(len(CLASSES))[labels]
    w, b = np.zeros((len(features), len(CLASSES))), np.zeros(len(CLASSES))
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        error = (_softmax(x @ w + b) - truth) / len(x)
        vw = 0.9 * vw - 0.8 * (x.T @ error + 1e-4 * w)
        vb = 0.9 * vb - 0.8 * error.sum(axis=0)
        w, b = w + vw, b + vb
    w[np.abs(w).max(axis=1) < 0.02] = 0

    # Calibration on what training has not seen: the temperature of best likelihood, then the least probability.
    texts, labels = _examples(np.random.default_rng(seed + 1), per_class, REWORDED, STRANGERS_HELD_OUT)
    z = matrix(texts) @ w + b
    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(labels)), labels] + 1e-12).mean())
    best = _softmax(z / temperature)[:, :-1].max(axis=1)
    least = max(0.5, float(np.quantile(best[labels == len(TEMPLATES)], 1 - FALSE_ALARMS)))
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return Classifier([features[i] for i in used], w[used], b, float(temperature), least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def paragraph_words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def paragraph_grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def known_grams(model: Classifier) -> list[str]:
    """N-grams that any later step looks at: the model's features and those of the notices."""
    return sorted({*model.features, *(g for texts in TEMPLATES.values() for t in texts for g in grams(t))})


def suspects(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_no, paragraph, n_grams, grams) of the lines with a word that speaks for a family.

    ``n_grams`` counts all n-grams of a line; ``grams`` are those that are known, few in prose.
    """
    speaking = model.speaking_words()
    lines = df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("paragraph", "line"))
    # A cheap test of the whole line comes first; words are split only where it holds.
    lines = lines.where(F.lower("line").rlike(rf"(^|[^a-z0-9])({'|'.join(speaking)})([^a-z0-9]|$)"))
    words = lines.select("doc_id", "row_no", "paragraph", paragraph_words(F.col("line")).alias("words"))
    found = words.where(F.exists("words", lambda w: w.isin(speaking))).select("doc_id", "row_no", "paragraph", paragraph_grams(F.col("words")).alias("all"))
    known = known_grams(model)
    return found.select("doc_id", "row_no", "paragraph", F.size("all").alias("n_grams"), F.filter("all", lambda g: g.isin(known)).alias("grams"))


def scan(df: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of each suspect line.

    ``family`` is the most probable family, or ``unknown`` where that class is
    the most probable or no family is probable enough; ``similarity`` is the
    largest share of n-grams that the line has in common with a notice of it;
    a notice confirms only if an n-gram of the family alone is among them.
    """
    model = model or train()
    spark = df.sparkSession
    found = materialize(suspects(df, model, id_col, text_col), "suspect-lines")
    key = ["row_no", "paragraph"]

    columns = [f"w{k}" for k in range(len(CLASSES))]
    weights = spark.createDataFrame([(f, *map(float, row)) for f, row in zip(model.features, model.weights, strict=True)], ", ".join(["gram string", *(f"{c} double" for c in columns)]))
    sums = found.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(c).alias(c) for c in columns))
    powers = sums.select(*key, F.array(*((F.col(c) + float(b)) / model.temperature for c, b in zip(columns, model.bias, strict=True))).alias("z"))
    powers = powers.withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    best = F.array_max(F.transform(F.slice("e", 1, len(TEMPLATES)), lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    judged = powers.select(*key, best.alias("best"), F.element_at("e", len(CLASSES)).alias("none"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("all"))
    probability = F.col("best.e") / F.col("all")
    names = F.array(*map(F.lit, TEMPLATES))
    sure = (probability >= model.least) & (F.col("best.e") > F.col("none"))
    judged = judged.select(*key, F.element_at(names, F.col("best.i") + 1).alias("likely"), probability.alias("probability"), sure.alias("sure"))
    judged = judged.where(F.col("probability") >= REPORTS)

    # Only lines that are reported are compared with notices, and with those of their likely family alone.
    own = own_grams()
    notices = [(family, n, len(grams(text)), g, int((family, g) in own)) for family, texts in TEMPLATES.items() for n, text in enumerate(texts) for g in grams(text)]
    notice_grams = spark.createDataFrame(notices, "likely string, notice int, notice_size int, gram string, own int")
    lines = found.join(judged, key).withColumn("gram", F.explode("grams")).drop("grams")
    of_line = [F.first(c).alias(c) for c in ("doc_id", "likely", "probability", "sure", "n_grams")]
    common = lines.join(F.broadcast(notice_grams), ["likely", "gram"], "left").groupBy(*key, "notice").agg(F.first("notice_size").alias("notice_size"), F.count("notice").alias("common"), F.max("own").alias("own"), *of_line)
    share = F.greatest(F.col("common") / F.col("notice_size"), F.col("common") / F.col("n_grams"))
    compared = common.withColumn("share", F.when(F.col("common") > 0, share)).groupBy(*key).agg(F.max("share").alias("similarity"), F.max(F.when(F.col("own") == 1, F.col("share"))).alias("own_similarity"), *of_line)
    return compared.select(
        "doc_id",
        "paragraph",
        F.when(F.col("sure"), F.col("likely")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"),
        (F.col("sure") & (F.coalesce("own_similarity", F.lit(0.0)) >= CONFIRMS)).alias("confirmed"),
    )


def classify(text: str, model: Classifier | None = None) -> tuple[str, float]:
    """The plain version for one paragraph, for tests: family and its probability."""
    model = model or train()
    place = {f: i for i, f in enumerate(model.features)}
    z = model.bias + sum((model.weights[place[g]] for g in grams(text) if g in place), np.zeros(len(CLASSES)))
    p = _softmax(z[None] / model.temperature)[0]
    k = int(p[:-1].argmax())
    sure = p[k] >= model.least and p[k] > p[-1]
    return (CLASSES[k] if sure else UNKNOWN), math.floor(p[k] * 1e6 + 0.5) / 1e6
