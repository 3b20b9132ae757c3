"""Language identification by hierarchical discrimination.

First a linear support vector machine per family predicts the language family (one against the rest), then one machine for each
pair of languages of that family separates closely related languages, the most votes win, sums of margins break ties.  Features are the
shares of hashed byte trigrams over the text in lower case, with everything but letters as one blank.

The fit takes a bounded sample: at most ``sample`` documents of each language, by hash order of doc_id, in one scan.  Prediction covers every whole
text and sees nothing but the text.

Defined cases: a null text or one without any letter is ``und`` with score 0; documents of null language or null doc_id aren't learned
from; with one language it is always predicted, with none everything is ``und``; repeated rows are treated alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm import textops as T

#: Families of languages by code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt",
    "malayic": "id ms",
}
BITS = 15
UND = "und"


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def _grams(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The trigram of each byte of a chunk (2**BITS where none starts within the row), and the number of trigrams of each row."""
    data = T.fold_case(c.data)
    data = np.where(T.LETTER[data], data, np.uint8(32)).astype(np.uint32)
    n = len(data)
    gram = np.full(n, 1 << BITS, np.int64)
    if n > 2:
        x = (data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]) * np.uint32(2654435761)
        gram[:-2] = x >> np.uint32(32 - BITS)
        blank = (data[:-1] == 32) & (data[1:] == 32)
        gram[:-1][blank] = 1 << BITS
    for k in (1, 2):
        at = c.end - k
        gram[at[at >= c.start]] = 1 << BITS
    return gram, T.row_sums(gram < 1 << BITS, c)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    family_weights: np.ndarray  # [family, gram]
    family_bias: np.ndarray
    pairs: list[tuple[int, int]]  # languages of one family; a positive margin speaks for the first
    pair_weights: np.ndarray
    pair_bias: np.ndarray
    scale: float


def _svm(row, col, value, y, n_cols, penalty=1e-3, rounds=120) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(n_cols), 0.0
    vw, vb = w.copy(), b
    norm = np.bincount(row, value * value, minlength=n).max() + 1
    step, t = 1 / (2 * norm + penalty), 1.0
    for _ in range(rounds):
        lack = np.maximum(0, 1 - y * (np.bincount(row, value * vw[col], minlength=n) + vb)) * weight
        g = np.bincount(col, value * (-2 * y * lack)[row], minlength=n_cols) + penalty * vw
        w2, b2 = vw - step * g, vb - step * float((-2 * y * lack).sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def _sample_rows(batches):
    for b in batches:
        ids, counts = [], []
        for c in T.chunks(b.column(1)):
            gram, _ = _grams(c)
            for s, e in zip(c.start, c.end, strict=True):
                x, k = np.unique(gram[s:e], return_counts=True)
                ids.append(x[x < 1 << BITS].astype(np.int32).tobytes())
                counts.append(k[x < 1 << BITS].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "g", "c"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, sample: int = 600, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from at most ``sample`` documents of each language that aren't held out."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # one scan for the sample: ranks above it leave before the shuffle
    first = W.partitionBy("lang").orderBy("place", "doc_id", "sum")
    ranked = known.select("lang", "doc_id", F.xxhash64(F.lit(10), F.col("doc_id")).alias("place"), F.xxhash64("text").alias("sum"))
    picked = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
    picked = picked.select(F.col("lang").alias("lang2"), F.col("doc_id").alias("id2"), F.col("sum").alias("sum2")).distinct()
    on = (F.col("doc_id") == F.col("id2")) & (F.col("lang") == F.col("lang2")) & (F.xxhash64("text") == F.col("sum2"))
    rows = known.join(F.broadcast(picked), on).select("lang", "text")  # at most sample rows of 24 bytes a language
    rows = rows.mapInArrow(_sample_rows, "lang string, g binary, c binary").collect()
    langs = sorted({r.lang for r in rows})  # the classes
    if not langs:
        return Model([], [], np.zeros((0, (1 << BITS) + 1)), np.zeros(0), [], np.zeros((0, (1 << BITS) + 1)), np.zeros(0), 1.0)
    rows = [r for r in rows if r.g]
    size = [len(r.g) // 4 for r in rows]
    row = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.frombuffer(r.g, np.int32) for r in rows] or [np.zeros(0, np.int32)]).astype(np.int64)
    count = np.concatenate([np.frombuffer(r.c, np.int32) for r in rows] or [np.zeros(0, np.int32)]).astype(float)
    total = np.bincount(row, count, minlength=len(rows))
    n_cols = 1 << BITS
    mean = np.bincount(col, count / total[row], minlength=n_cols) / max(1, len(rows))
    gain = 10 / np.sqrt(mean + 1e-4)  # rare trigrams count for more
    value = count / total[row] * gain[col]
    label = np.array([langs.index(r.lang) for r in rows])
    families = sorted({family_of(x) for x in langs})
    home = np.array([families.index(family_of(x)) for x in langs])

    def machine(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, float]:
        use = mine | theirs
        back = np.cumsum(use) - 1
        k = use[row]
        w, b = _svm(back[row[k]], col[k], value[k], np.where(mine[use], 1.0, -1.0), n_cols)
        return np.append(w * gain, 0.0), b

    nothing = (np.zeros(n_cols + 1), 0.0)
    by_family = [machine(home[label] == k, home[label] != k) if len(families) > 1 and (home[label] == k).any() else nothing for k in range(len(families))]
    pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if home[a] == home[b]]
    by_pair = [machine(label == a, label == b) if (label == a).any() and (label == b).any() else nothing for a, b in pairs]
    stack = lambda ms: (np.array([m[0] for m in ms]).reshape(len(ms), n_cols + 1), np.array([m[1] for m in ms]))
    fw, fb = stack(by_family)
    pw, pb = stack(by_pair)
    return Model(langs, families, fw, fb, pairs, pw, pb, 3.0)


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        home = np.array([m.families.index(family_of(x)) for x in m.langs], int)
        fw, pw = m.family_weights.astype(np.float32), m.pair_weights.astype(np.float32)
        for b in batches:
            pred, score = np.full(len(b), UND, object), np.zeros(len(b))
            for c in T.chunks(b.column(1)):
                gram, n = _grams(c)
                full = np.flatnonzero(c.end > c.start)
                some = np.zeros(c.hi - c.lo, bool)
                some[T.row_sums(T.LETTER[c.data] & (c.data < 128), c) > 0] = True
                for i in np.flatnonzero(~some & (c.end > c.start)):
                    some[i] = any(ch.isalpha() for ch in c.data[c.start[i] : c.end[i]].tobytes().decode("utf-8", "replace"))
                if not m.langs or not len(full):
                    continue

                def margins(weights, bias, rows, gram=gram, n=n, c=c, full=full):
                    out = np.zeros((len(weights), c.hi - c.lo))
                    for k, w in enumerate(weights):
                        out[k, full] = np.add.reduceat(w[gram], c.start[full], dtype=np.float64)
                    return (out / np.maximum(n, 1)[None, :] + bias[:, None])[:, rows]

                rows = np.flatnonzero(some)
                f = margins(fw, m.family_bias, rows)
                family = f.argmax(axis=0) if len(m.families) > 1 else np.zeros(len(rows), int)
                sure = 1 / (1 + np.exp(-m.scale * f[family, np.arange(len(rows))])) if len(m.families) > 1 else np.ones(len(rows))
                wins = np.where(home[:, None] == family[None, :], 0.0, -1e9)
                p = margins(pw, m.pair_bias, rows)
                for k, (x, y) in enumerate(m.pairs):
                    mine = family == home[x]
                    vote = np.where(p[k] > 0, 1.0, 0.0)
                    lean = np.tanh(p[k]) * 1e-3
                    wins[x] += np.where(mine, vote + lean, 0)
                    wins[y] += np.where(mine, 1 - vote - lean, 0)
                best = wins.argmax(axis=0)
                for k, (x, y) in enumerate(m.pairs):
                    part = (best == x) | (best == y)
                    sure = np.where(part, np.minimum(sure, 1 / (1 + np.exp(-m.scale * np.abs(p[k])))), sure)
                pred[c.lo + rows] = np.array(m.langs, object)[best]
                score[c.lo + rows] = sure
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
