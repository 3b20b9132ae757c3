"""Quality rules by weak supervision.

Rules on counts of each whole text vote good, bad, or abstain.  Expectation-maximisation over the vote patterns of all documents
estimates how often each rule votes what for good and for bad documents, without any label; a document is kept if the
posterior probability that it is good, given all votes, is high enough, and not only if it passes every rule.  The patterns
are counted in Spark; at most 3 ** (number of rules) counts reach the driver, whatever the input.

No rule's vote is taken to be rarer than a floor in either class, so that one rule can't decide against all others.

Defined cases: a null or empty text has no words, so it fails the base rules and all rules abstain but the one on length;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm import textops as T
from wakeline.llm.scratch import Scratch

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_ends", "n_wide", "n_digits")


def _flags(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SYMBOL, _UPPER, _SMALL, _SHOUT = _flags(*SYMBOLS), _flags(*range(65, 91)), _flags(*range(97, 123)), _flags(ord("!"))
_DIGIT = _flags(*range(48, 58))
_WIDE = _flags(*range(0xC0, 256))  # first bytes of characters beyond ASCII, which count as letters
_END = _flags(*b".!?:;,\"')")


def _distinct(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, code) pairs: how often each occurs, and whether it is the first of its kind."""
    key = T.mix(code ^ T.mix(row.astype(np.uint64), 5), 6)
    _, first, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), bool)
    is_first[first] = True
    return times[back], is_first


def chunk_counts(c: T.Chunk) -> np.ndarray:
    """COUNTS of each row of a chunk, a column each."""
    m, data = c.hi - c.lo, c.data
    out = np.zeros((m, len(COUNTS)), np.int64)
    if not len(data):
        return out
    inside = ~T.WHITE[data]
    ws, we, rows = T.word_spans(c, inside)
    h = T.prefix_hash(data)
    out[:, 0] = np.diff(rows)
    out[:, 1] = T.row_sums(inside & ((data & 0xC0) != 0x80), c)
    for k, flags in ((2, _SYMBOL), (6, _UPPER), (7, _SMALL), (8, _SHOUT), (10, _WIDE), (11, _DIGIT)):
        out[:, k] = T.row_sums(flags[data], c)
    # lines: cut at \n and at the ends of rows
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, c.start, c.end]))
    ls, le = cut[:-1], cut[1:]
    le = np.where(data[le - 1] == 10, le - 1, le)
    words_before = np.concatenate([[0], np.cumsum(inside)])
    some = words_before[le] > words_before[ls]
    ls, le = ls[some], le[some]
    row = np.searchsorted(c.start, ls, "right") - 1
    if len(ls):
        _, first = _distinct(row, T.span_hash(h, ls, le))
        out[:, 3] = np.bincount(row[~first], minlength=m)
        out[:, 5] = np.bincount(row, minlength=m)
        out[:, 9] = np.bincount(row[_END[data[le - 1]]], minlength=m)
    # words in three-word windows that occur again in the text
    words = T.mix(T.span_hash(h, ws, we))
    row = T.row_of(rows)
    if len(words) > 2:
        k = np.uint64(0xD6E8FEB86659FD93)
        three = (words[:-2] * k + words[1:-1]) * k + words[2:]
        at = np.flatnonzero(row[:-2] == row[2:])
        if len(at):
            times, _ = _distinct(row[at], three[at])
            at = at[times > 1]
            hit = np.zeros(len(words), bool)
            for j in range(3):
                hit[at + j] = True
            out[:, 4] = np.bincount(row[hit], minlength=m)
    return out


def text_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS for each document."""

    def run(batches):
        for b in batches:
            parts = [chunk_counts(c) for c in T.chunks(b.column(1))]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, k].copy()) for k in range(len(COUNTS))]], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of COUNTS: 1 good, -1 bad, 0 abstains.

    Symbols are held against words and against characters in two votes: junk strewn over real words shows in both, and each alone could
    not outweigh the rules that such words satisfy.  Digits speak neither for nor against a text.
    """
    w, lines, chars = F.col("n_words"), F.col("n_lines"), F.col("word_chars")
    some = w > 0
    ascii_ = F.col("n_upper") + F.col("n_lower")
    letters, digits = ascii_ + F.col("n_wide"), F.col("n_digits")
    counted = chars > digits
    return {
        "length": _vote(w >= 100, w < 50),
        "word_length": _vote(some & chars.between(3 * w, 9 * w), some & ~chars.between(F.lit(2.5) * w, 12 * w)),
        "symbols_by_word": _vote(some & (50 * F.col("n_symbols") <= w), some & (10 * F.col("n_symbols") > w)),
        "symbols_by_character": _vote(some & (200 * F.col("n_symbols") <= chars), some & (25 * F.col("n_symbols") > chars)),
        "letters": _vote(counted & (100 * letters >= 90 * (chars - digits)), counted & (100 * letters < 80 * (chars - digits))),
        "same_lines": _vote((lines >= 3) & (20 * F.col("n_dup_lines") <= lines), (lines >= 2) & (10 * F.col("n_dup_lines") > 3 * lines)),
        "same_words": _vote((w >= 30) & (20 * F.col("n_repeat_words") <= w), some & (5 * F.col("n_repeat_words") > w)),
        "capitals": _vote((ascii_ > 0) & (5 * F.col("n_upper") <= ascii_), (ascii_ > 0) & (2 * F.col("n_upper") > ascii_)),
        "shouting": _vote(some & (50 * F.col("n_shouts") <= w), some & (5 * F.col("n_shouts") > w)),
        "sentences": _vote((lines > 0) & (2 * F.col("n_ends") >= lines), (lines >= 3) & (5 * F.col("n_ends") < lines)),
    }


#: What is expected of a rule before any data: P(vote bad, none, good), for bad and for good documents; and the weight of that, and of
#: the expected share of good documents, against all documents.
EXPECTED = np.array([[0.35, 0.30, 0.35], [0.01, 0.29, 0.70]])
EXPECTED_GOOD, TRUST = 0.85, 0.3
#: No vote is taken to be rarer than this in either class, so that no single rule outweighs all others.
RAREST = 0.02


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior probability of good, and P(vote | bad or good) as [rule, class, vote + 1], by expectation-maximisation.

    The estimates are most probable values under EXPECTED, whose weight grows with the number of documents, so that the result does
    not depend on the size of the corpus.
    """
    k = patterns.shape[1] if patterns.ndim == 2 else 0
    prior, table = EXPECTED_GOOD, np.tile(EXPECTED, (k, 1, 1))
    total = counts.sum()
    if not total:
        return prior, table
    for _ in range(rounds):
        good = posterior(patterns, prior, table)
        weight = np.stack([counts * (1 - good), counts * good])
        new = np.stack([[[weight[y][patterns[:, j] == v].sum() for v in (-1, 0, 1)] for y in (0, 1)] for j in range(k)])
        share = np.array([1 - EXPECTED_GOOD, EXPECTED_GOOD])[None, :, None]
        new = new + TRUST * total * share * EXPECTED[None]
        new = np.maximum(new / new.sum(axis=2, keepdims=True), RAREST)
        new /= new.sum(axis=2, keepdims=True)
        moved, table = np.abs(new - table).max(), new
        prior = float((weight[1].sum() + TRUST * total * EXPECTED_GOOD) / ((1 + TRUST) * total))
        if moved < 1e-9:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    odds = np.full(len(patterns), np.log(prior / (1 - prior)))
    for j in range(table.shape[0]):
        odds += np.log(table[j, 1] / table[j, 0])[patterns[:, j] + 1]
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, p_good and kept for each document.

    kept: not base_failed, and a posterior probability of at least ``least``.
    """
    counted = Scratch(docs.sparkSession, "quality").save(text_counts(docs, doc_id=doc_id, text=text), "counts")
    rules = votes()
    voted = counted.select("*", *[v.alias(f"_v_{k}") for k, v in rules.items()])
    found = voted.groupBy(*[f"_v_{k}" for k in rules]).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([r[:-1] for r in found], int).reshape(len(found), len(rules))
    prior, table = fit(patterns, np.array([r[-1] for r in found], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for j, name in enumerate(rules):
        worth = np.log(table[j, 1] / table[j, 0])
        v = F.col(f"_v_{name}")
        odds = odds + F.when(v < 0, float(worth[0])).when(v > 0, float(worth[2])).otherwise(float(worth[1]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return voted.select("doc_id", *COUNTS, failed.alias("base_failed"), p.alias("p_good")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
