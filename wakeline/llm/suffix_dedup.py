"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Parsing.  A rolling hash runs over all ``GRAM``-byte strings.  The trigger of a ``length``-byte string is the smallest of its
hashes (the leftmost of equal ones), so equal strings have equal triggers at equal places, wherever they stand.  A phrase is a
run of strings that share one trigger occurrence: bytes lo .. hi + length.  Every string of the text lies in exactly one phrase,
neighbours overlap by length - 1 bytes, and no part depends on the text around it: the property that prefix-free parsing
needs.  The parse of a document is its sequence of phrases.

Dictionary and parse.  A trigger that occurs once in the corpus has no repeated string in its phrase; those phrases, most of
them in ordinary text, leave after one count.  Of the rest, equal phrases are one word of the dictionary, and all but the
first in corpus order (smallest doc_id, then position) consist of repeated strings only: inside long repeats nothing finer is looked at.
What stays are dictionary words that share a trigger with another word, at the edges of repeats.  Their suffixes are sorted
(a suffix array by prefix doubling, of each task's words, over the first ``length`` bytes), equal neighbours form a class, and
classes of all tasks meet by fingerprint; its first suffix in corpus order stays, all others start a repeat.  Only equality of
``length`` bytes is asked for, so ranks beyond it and the order between unequal suffixes of different tasks are never needed.

Classes are told apart by two independent hashes of their bytes, together 96 bits.  Hot phrases are partial aggregates and join rows,
never a list in one task; a hot suffix leaves each chunk of texts once, the rank over its class streams; only a document's own ranges
are collected.

Defined cases: a null text is empty; texts shorter than ``length`` are left as they are; rows that share a doc_id, or have none, are
documents of their own, in order of their text's md5, and rows that are equal in both are one document with the same result for each;
a null doc_id counts as the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm import textops as T
from wakeline.llm.scratch import Scratch

GRAM = 32
#: Bits of a place: no string of Spark's is longer.
_PLACE = np.uint64((1 << 31) - 1)
_C = np.uint64(0xBF58476D1CE4E5B9)


def _sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def parse(c: T.Chunk, length: int) -> tuple[np.ndarray, ...]:
    """The phrases of a chunk: row, trigger hash, phrase hash, lo (in the row), hi - lo, trigger's place - lo."""
    none = np.zeros(0, np.int64)
    n = len(c.data)
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = T.prefix_hash(c.data)
    _, down = T.powers(n + 1)
    g = (h[GRAM:] - h[:-GRAM]) * down[: n - GRAM + 1]
    g ^= g >> np.uint64(29)
    g *= _C
    place = np.arange(len(g), dtype=np.uint64)
    least = _sliding_least((g & ~_PLACE) | place, length - GRAM + 1)
    trigger = (least & _PLACE).astype(np.int64)
    valid = np.zeros(len(trigger) + 1, bool)
    for a, b in zip(c.start, c.end, strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    opens = valid[:-1].copy()
    opens[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-2]
    lo = np.flatnonzero(opens)
    closes = valid[:-1].copy()
    closes[:-1] &= opens[1:] | ~valid[1:-1]
    hi = np.flatnonzero(closes)
    row = np.searchsorted(c.start, lo, "right") - 1
    at = trigger[lo]
    phrase = T.mix(T.span_hash(h, lo, hi + length) ^ (at - lo).astype(np.uint64), 4)
    return row, g[at], phrase, lo - c.start[row], hi - lo, at - lo


def suffix_classes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A class for each suffix at[i]: equal for equal first length bytes, in the suffixes' order.

    Prefix doubling over the whole buffer: ranks of 1, 2, 4, ... bytes, the last step overlapping so that exactly length bytes count.
    """
    rank = np.concatenate([data.astype(np.int64) + 1, np.zeros(length, np.int64)])
    have = 1
    while have < length:
        step = min(have, length - have)
        pair = rank[: len(data)] * (int(rank.max()) + 1) + rank[step : len(data) + step]
        _, rank_now = np.unique(pair, return_inverse=True)
        rank = np.concatenate([rank_now.astype(np.int64) + 1, np.zeros(length, np.int64)])
        have += step
    return rank[at]


def _width(length: int) -> int:
    """A phrase's place in a document is its first start, above the number of its further starts in so many bits.

    All strings of a phrase hold its trigger, so it has at most length - GRAM further starts.
    """
    return (length - GRAM).bit_length()


def _triggers(length: int):
    """(t, n): the triggers of each chunk of texts, counted."""

    def run(batches):
        for b in batches:
            for c in T.chunks(b.column(0)):
                t, n = np.unique(parse(c, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])

    return run


def _spans(length: int):
    """(t, p, doc, at): trigger, phrase, document, and place with width."""

    bits = _width(length)

    def run(batches):
        for b in batches:
            for c in T.chunks(b.column(1)):
                row, t, p, lo, width, _ = parse(c, length)
                doc = b.column(0).take(pa.array(row + c.lo))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(p.view(np.int64)), doc, pa.array((lo << bits) | width)], ["t", "p", "doc", "at"])

    return run


def _fingerprint(c: T.Chunk, h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the strings at the places given, of 64 and 32 bits."""
    return T.mix(T.span_hash(h, at, at + length), 9).view(np.int64), T.second_hash(c.data, at, length)


def _edge_suffixes(length: int):
    """The suffixes of dictionary words, as (f, f2, doc, lo).

    Of equal suffixes in one chunk of texts the first in corpus order is a row with the fingerprint of its class; the others start a
    repeat for certain, and are known by lo as -1 - lo, with a hash of their place for f.
    """

    bits = _width(length)

    def run(batches):
        for b in batches:
            column, spans = b.column(1), b.column(2)
            doc = b.column(0).to_numpy(zero_copy_only=False)
            at_list = spans.offsets.to_numpy()
            ats = spans.values.to_numpy()
            for c in T.chunks(column):
                words = ats[at_list[c.lo] : at_list[c.hi]]
                if not len(words):
                    continue
                lo, w = words >> bits, words & ((1 << bits) - 1)
                h = T.prefix_hash(c.data)
                row = np.repeat(np.repeat(np.arange(c.hi - c.lo), np.diff(at_list[c.lo : c.hi + 1])), w + 1)
                s = T.within(lo, np.arange(len(lo)), w + 1)
                at = s + c.start[row]
                # only the bytes of the words take part in the sort
                mark = np.zeros(len(c.data) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + length, -1)
                used = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                classes = suffix_classes(c.data[used], np.searchsorted(used, at), length)
                row += c.lo
                order = np.lexsort((s, doc[row], classes))
                first = np.empty(len(order), bool)
                first[0] = True
                first[1:] = classes[order[1:]] != classes[order[:-1]]
                known = np.ones(len(order), bool)
                known[order[first]] = False
                # a row with the same doc_id and text is the same document, its suffixes are no repeats
                same = np.zeros(len(order), bool)
                same[1:] = ~first[1:] & (doc[row[order[1:]]] == doc[row[order[:-1]]]) & (s[order[1:]] == s[order[:-1]])
                known[order[same]] = False
                f, f2 = _fingerprint(c, h, at, length)
                f = np.where(known, T.mix(at.astype(np.uint64), 3).view(np.int64), f)  # not asked for again: dealt evenly
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(f2), pa.array(doc[row]), pa.array(np.where(known, -1 - s, s).astype(np.int32))], ["f", "f2", "doc", "lo"])

    return run


def _cut(length: int, with_text: bool):
    """What is left of each text: counts, hash, and the text itself if asked for."""

    def run(batches):
        for b in batches:
            data, at = T.column_bytes(b.column(1))
            lists = b.column(2)
            size, gone, runs, digest, left = [], [], [], [], []
            for i in range(len(b)):
                text = data[at[i] : at[i + 1]]
                ranges = lists[i]
                removed = number = 0
                if ranges.is_valid:
                    mark = np.zeros(len(text) + 1, np.int64)
                    np.add.at(mark, ranges.values.field("lo").to_numpy(), 1)
                    np.add.at(mark, ranges.values.field("hi").to_numpy() + length, -1)
                    dead = np.cumsum(mark[:-1]) > 0
                    removed = int(dead.sum())
                    number = int(dead[0]) + int((dead[1:] & ~dead[:-1]).sum()) if len(dead) else 0
                    text = text[~dead]
                kept = text.tobytes()
                size.append(at[i + 1] - at[i])
                gone.append(removed)
                runs.append(number)
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = 100, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each document.

    Each byte goes that lies in a length-byte string of its document that also starts earlier in the corpus.  kept is null unless
    with_text.  The places of edges of repeats are measured, and sent to the readers of the texts by a broadcast up to broadcast_bytes; more
    of them meet their texts in a shuffle.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    else:
        docs = _numbered(docs, scratch)
    ranges = _repeats(docs.select("doc", "text").where(F.octet_length("text") >= length), length, broadcast_bytes, scratch)
    scratch.drop("placed", "edges")
    scratch.free()
    out = docs.join(ranges, "doc", "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return out.mapInArrow(_cut(length, with_text), schema)


def _repeats(texts: DataFrame, length: int, broadcast_bytes: int, scratch: Scratch) -> DataFrame:
    """(doc, ranges): first starts and last starts of runs of strings that start earlier too, for each document with any."""
    # phrases whose trigger occurs more than once; texts are parsed twice, as all phrases would be a table of twice the texts' size.
    # The triggers are written, so that the join can split a hot one
    again = texts.select("text").mapInArrow(_triggers(length), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    again = scratch.save(again.where("n > 1").select("t"), "again")
    phrases = texts.mapInArrow(_spans(length), "t long, p long, doc long, at long").join(again, "t")
    phrases = scratch.save(phrases, "phrases")
    scratch.drop("again")

    # dictionary: equal phrases, their first occurrence, and whether another word has the same trigger
    place = F.struct("doc", "at")
    words = phrases.groupBy("t", "p").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    words = scratch.save(words, "words")
    several = words.groupBy("t").agg(F.count("*").alias("words")).where("words > 1").select("t", F.lit(True).alias("edge"))
    words = words.join(several, "t", "left").where("n > 1 or edge").select("t", "p", "first", F.coalesce("edge", F.lit(False)).alias("edge"))
    placed = phrases.join(words, ["t", "p"]).select("doc", "at", "edge", (place == F.col("first")).alias("is_first"))
    placed = scratch.save(placed.where("edge or not is_first"), "placed")
    scratch.drop("phrases", "words")
    bits = _width(length)
    start = F.shiftright("at", bits).cast("int")
    later = placed.where("not is_first").select("doc", start.alias("lo"), (start + F.col("at").bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias("hi"))
    edges = placed.where("is_first").groupBy("doc").agg(F.collect_list("at").alias("spans"))
    edges = scratch.save(edges, "edges")

    # suffixes of the words at the edges; those that are first in their task meet by class
    near = F.broadcast(edges) if (edges.agg(F.sum(F.size("spans") * 8 + 32)).first()[0] or 0) <= broadcast_bytes else edges
    suffixes = texts.join(near, "doc").select("doc", "text", "spans").mapInArrow(_edge_suffixes(length), "f long, f2 int, doc long, lo int")
    order = W.partitionBy("f", "f2", F.col("lo") < 0).orderBy("doc", "lo")
    repeated = suffixes.withColumn("r", F.rank().over(order)).where("lo < 0 or r > 1")
    repeated = repeated.select("doc", F.when(F.col("lo") < 0, -1 - F.col("lo")).otherwise(F.col("lo")).alias("lo")).select("doc", "lo", F.col("lo").alias("hi"))

    ranges = later.union(repeated).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return scratch.save(ranges, "ranges")


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a number doc for each different pair of doc_id and text, in order of doc_id (null first) and the text's md5.

    Numbers ascend over the ranges of one sort, so no task sees more than its range.
    """
    keys = docs.select("doc_id", F.md5("text").alias("sum")).distinct().orderBy(F.asc_nulls_first("doc_id"), "sum")
    keys = scratch.save(keys.withColumn("doc", F.monotonically_increasing_id()), "numbers").select(F.col("doc_id").alias("id2"), F.col("sum").alias("sum2"), "doc")
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.md5("text") == F.col("sum2"))).select("doc_id", "text", "doc")
