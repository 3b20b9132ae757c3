"""Toxicity by cumulative-link ordinal regression on sparse word features.

Labels only tell toxic from not.  Severity grades are made from them: 0 for the others, and for toxic documents 1, 2 or 3 by which
third of the toxic their share of toxic words falls in; toxic words are those that stand in toxic documents far more often than
in others.  The model is P(grade <= k) = sigmoid(theta_k - w . x) with one weight vector for all thresholds; x is the square root
of each vocabulary word's share of the words of the text, in percent.  Its outputs are the grade probabilities and the expected
severity, the sum over k of P(grade > k).

The fit takes a bounded sample of labelled documents (``sample`` of each class, by hash order of doc_id); scoring covers every whole
text.  Words are runs of letters in lower case.

Documents that are toxic by label but hold none of the toxic words aren't learned from: nothing in the text tells their grade.

Defined cases: a null text or one without letters has no features and severity of an empty text, far below the threshold; labels
that are null, or whose documents are missing, aren't learned from; a document with contradicting labels counts as toxic; of several rows
with one labelled doc_id the text of smallest md5 is learned from; without toxic labels nothing is toxic; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import textops as T


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_cols: int, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model, by Adam on the mean negative log-likelihood of all rows."""
    n, k = len(grade), int(grade.max())
    w = np.zeros(n_cols)
    theta = np.linspace(1.0, 2.0, k)
    state = [np.zeros(n_cols + k), np.zeros(n_cols + k)]

    for t in range(1, rounds + 1):
        eta = np.bincount(row, value * w[col], minlength=n)
        p = _sigmoid(theta[None, :] - eta[:, None])  # P(grade <= k)
        bounds = np.concatenate([np.zeros((n, 1)), p, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        at = np.maximum(bounds[i, grade + 1] - bounds[i, grade], 1e-9)
        d_eta = (slope[i, grade + 1] - slope[i, grade]) / at / n
        g_w = np.bincount(col, value * d_eta[row], minlength=n_cols) + penalty * w / max(1, n_cols)
        g_theta = np.zeros(k)
        np.add.at(g_theta, grade[grade < k], -(slope[i, grade + 1] / at / n)[grade < k])
        np.add.at(g_theta, grade[grade > 0] - 1, (slope[i, grade] / at / n)[grade > 0])
        g = np.concatenate([g_w, g_theta])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w -= step[:n_cols]
        theta = np.sort(theta - step[n_cols:])

    return w, theta


def _features(batches):
    """(toxic, n words, hashes, counts) for each sampled document."""
    for b in batches:
        ns, hs, cs = [], [], []
        for c in T.chunks(b.column(1)):
            words, rows = T.letter_words(c)
            for i in range(c.hi - c.lo):
                x, k = np.unique(words[rows[i] : rows[i + 1]], return_counts=True)
                ns.append(rows[i + 1] - rows[i])
                hs.append(x.tobytes())
                cs.append(k.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], ["toxic", "n", "h", "c"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, grades: int = 3, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most 2 * sample labelled documents."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(5), F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    picked = picked.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    rows = texts.join(F.broadcast(picked), F.col("key") == F.col("labelled"))  # at most 2 * sample labels
    # one row a label before features are made: what is collected is bounded by the sample, however often its ids repeat
    one = rows.groupBy("labelled").agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.md5("text").alias("sum"), "text")).alias("row"))
    got = one.select("toxic", F.col("row.text").alias("text")).mapInArrow(_features, "toxic int, n long, h binary, c binary").collect()
    got = sorted(r for r in got if r.n)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([5.0 + k for k in range(grades)]))
    toxic = np.array([r.toxic for r in got], bool)
    if not toxic.any() or toxic.all():
        return nothing
    h = np.concatenate([np.frombuffer(r.h, np.uint64) for r in got])
    count = np.concatenate([np.frombuffer(r.c, np.int32) for r in got]).astype(float)
    row = np.repeat(np.arange(len(got)), [len(r.h) // 8 for r in got])
    n = np.array([r.n for r in got], float)
    words, col = np.unique(h, return_inverse=True)
    bad, good = np.bincount(col[toxic[row]], minlength=len(words)), np.bincount(col[~toxic[row]], minlength=len(words))
    ratio = (bad / toxic.sum()) / ((good + 0.5) / (~toxic).sum())
    least = min(5, max(2, toxic.sum() // 20))
    marked = (bad >= least) & (ratio >= 8)
    dose = np.bincount(row, count * marked[col], minlength=len(got)) / n
    sure = ~toxic | (dose > 0)  # toxic by label alone, without any such word: not learned from
    dosed = dose[toxic & (dose > 0)]
    if not len(dosed):
        return nothing
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(dosed, [(k + 1) / grades for k in range(grades - 1)]), dose, "right"), 0)
    used = (bad >= least) & (ratio >= 2)
    place = np.cumsum(used) - 1
    keep = used[col] & sure[row]
    back = np.cumsum(sure) - 1
    w, theta = fit_ordinal(back[row[keep]], place[col[keep]], np.sqrt(100 * count[keep] / n[row[keep]]), grade[sure], int(used.sum()))
    return Model(words[used], w, theta)


def _above(texts: pa.Array, m: Model, vocabulary: T.Vocabulary) -> np.ndarray:
    """For each text, the probability of each grade or a higher one."""
    eta = np.zeros(len(texts))
    for c in T.chunks(texts):
        words, rows = T.letter_words(c)
        at, place = vocabulary.find(words)
        size = max(1, len(m.words))
        pairs, count = np.unique((np.searchsorted(rows, at, "right") - 1) * size + place, return_counts=True)
        row, word = pairs // size, pairs % size
        value = np.sqrt(100 * count / np.diff(rows)[row])
        eta[c.lo : c.hi] = np.bincount(row, value * m.weights[word], minlength=c.hi - c.lo)
    return _sigmoid(eta[:, None] - m.thresholds[None, :])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each document; toxic: P(grade >= 1) of at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        vocabulary = T.Vocabulary(m.words)
        for b in batches:
            above = _above(b.column(1), m, vocabulary)
            grade = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= least)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def not_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", least: float = 0.5, **options) -> DataFrame:
    """docs without the rows that the model finds toxic: each row goes by its own text, whatever its doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text, **options))
    place = docs.columns.index(text)

    def run(batches):
        m = sent.value
        vocabulary = T.Vocabulary(m.words)
        for b in batches:
            yield b.filter(pa.array(_above(b.column(place), m, vocabulary)[:, 0] < least))

    return docs.mapInArrow(run, docs.schema)
