"""Benchmark decontamination, with DataFrame functions only: size-partitioned MinHash containment search.

An item with n distinct shingles lies in a document at containment t if the document has at least t * n of them.  Items are
put in size classes; the class fixes how many of an item's smallest shingle hashes (its bottom-k MinHash sketch) are searched
for: k = n - ceil(t * n) + 1 for the largest n of the class.  A document that has none of them lacks k shingles, too many to
reach t, so the search loses nothing however long the document is, which banded signatures of a whole long document can't
promise for short items.  Documents that hit a sketch are verified by exact containment: their shingles, as two independent
64-bit hashes (so 128 bits), are counted against all shingles of the item.

Words are runs of letters and digits in lower case, so marks and line breaks don't hide a passage; shingles are of five words.
Items with one to four words count as one shingle of just that many words; items without words match nothing.

Defined cases: null and empty texts match nothing; repeated items are reported each (rows with the
same item_id and text are one item, with another text another); repeated documents too (rows with the
same doc_id count as one document; rows without a doc_id are passed over, or
with ``without_id`` searched too: those of one text count as one document and are reported with a null doc_id); an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Largest number of distinct shingles in each size class of items; above the last, classes double.
SIZES = (1, 4, 9, 14, 19, 29, 39, 59, 79, 119)


def sketch_length(n: Column, threshold: float) -> Column:
    """How many minima an item of n distinct shingles is searched by: those of the largest item of its class."""
    per_class = F.lit(None).cast("long")
    for top in reversed(SIZES):
        per_class = F.when(n <= top, F.lit(top - ceil(threshold * top - 1e-9) + 1).cast("long")).otherwise(per_class)
    doubled = F.pow(F.lit(2.0), F.ceil(F.log2(n)))
    return F.least(n, F.coalesce(per_class, (doubled - F.ceil(doubled * threshold) + 1).cast("long")))


def word_codes(text: Column) -> Column:
    """A hash of each word of the text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(codes: Column, n: int, seed: int) -> Column:
    """Hashes of all n-word shingles; empty below n words."""
    last = F.size(codes) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(seed * 16 + n), *[codes[i + j] for j in range(n)]))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    broadcast_rows: int = 500_000,
    without_id: bool = False,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that holds at least threshold of an item.

    ``broadcast_rows`` bounds what is sent to all executors: sketches and item shingles (24 bytes a row) and the ids of hit
    documents are counted first and broadcast only up to that many rows; beyond it the same joins shuffle.
    """

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    # sizes of shingles in use: n, and the whole length of shorter items
    coded = items.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_text)).alias("_t"), word_codes(F.col(item_text)).alias("codes")).where(F.size("codes") > 0)
    coded = coded.withColumn("_len", F.least(F.size("codes"), F.lit(n)))
    lengths = sorted(r[0] for r in coded.select("_len").distinct().collect())  # at most n numbers
    pair = lambda codes, k: F.arrays_zip(shingles_of(codes, k, 1).alias("a"), shingles_of(codes, k, 2).alias("b"))
    if not lengths:
        return docs.select(F.col(doc_id).alias("doc_id")).limit(0).selectExpr("doc_id", "cast(null as long) item_id", "0L n_shared", "0L n_item", "0D containment")
    parts = [coded.where(F.col("_len") == k).select("item_id", "_t", F.inline(pair(F.col("codes"), k)).alias("a", "b")) for k in lengths]
    own = parts[0]
    for p in parts[1:]:
        own = own.union(p)
    own = own.distinct().withColumn("n_item", F.count("*").over(W.partitionBy("item_id", "_t")))
    rank = F.row_number().over(W.partitionBy("item_id", "_t").orderBy("a", "b"))
    own = own.withColumn("in_sketch", rank <= sketch_length(F.col("n_item"), threshold))

    # search: documents with any minimum of any item
    sketch = own.where("in_sketch").select(F.col("a").alias("_a")).distinct()
    own_text = F.when(F.col(doc_id).isNull(), F.md5(F.col(text))).otherwise("")  # tells rows without an id apart
    if not without_id:
        docs = docs.where(F.col(doc_id).isNotNull())
    docs = docs.select(F.col(doc_id).alias("doc_id"), own_text.alias("_own"), F.col(text).alias("text")).where(F.col("_own").isNotNull())
    tokens = docs.select("doc_id", "_own", word_codes(F.col("text")).alias("codes"))
    firsts = F.concat(*[shingles_of(F.col("codes"), k, 1) for k in lengths])
    hits = tokens.select("doc_id", "_own", F.explode(firsts).alias("a")).join(side(sketch), F.col("a") == F.col("_a"), "left_semi").select("doc_id", "_own").distinct()

    # verification: exact containment in those documents alone
    from wakeline.llm.scratch import Scratch

    hits = side(Scratch(docs.sparkSession, "decontaminate").save(hits, "hits"))
    again = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (docs["_own"] == hits["_own"]), "left_semi")
    again = again.select("doc_id", "_own", word_codes(F.col("text")).alias("codes"))
    both = F.flatten(F.array(*[pair(F.col("codes"), k) for k in lengths]))
    found = again.select("doc_id", "_own", F.inline(both).alias("a", "b")).join(side(own.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "item_id", "_t", "n_item")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    counted = found.select("doc_id", "_own", "item_id", "_t", "n_item", "a", "b").distinct().groupBy("doc_id", "_own", "item_id", "_t").agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9)).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item; each row goes by its own text (its 128-bit hash), whatever its doc_id."""
    texts = docs.select(F.md5(F.col(text)).alias("doc_id"), F.col(text).alias("text"))
    bad = contaminated(texts, items, **options).select(F.col("doc_id").alias("_text")).distinct()
    return docs.join(bad, F.md5(docs[text]) == bad["_text"], "left_anti")
