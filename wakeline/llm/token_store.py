"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by doc_id, encoded, and their ids packed without gaps into sequences of ``length``: the rows of an Arrow
IPC file, as a fixed-size list of ids and one of mask bits (true where there is an id; false only in the padding at a file's
end).  A fixed-size list is one flat buffer, so sequence i of a memory-mapped file is a slice of it: random access without a
copy.  Ids are uint16 where the vocabulary allows, else uint32.  Beside each file stands an index, an Arrow file too, with each
document's doc_id, start in the file, and length.  Each range of doc_ids is one file, written under a name of its own
attempt and moved into place when complete, so a lost or repeated task leaves one whole file.

Encoding.  Texts are cut into pieces where the tokenizer's own pre-tokenizer always cuts (before white space, and between a letter
and a mark), and each distinct piece is encoded by the tokenizer once per worker, in a cache of bounded size; ids of pieces make up
those of the text.  That holds for byte-level BPE with the usual pattern of runs of letters, digits, marks and spaces, which is
checked when the tokenizer is read; others encode whole texts.  Where a text holds an added token's content that the tokenizer takes
as that token, the text is encoded whole.  Contents of special tokens are taken so with ``added_tokens``, else read as plain text.

Defined cases: a null or empty text has only the end id; null doc_ids come first; rows with equal doc_ids follow one another, by the text's hash,
and may lie in several files;
an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm.scratch import shared_folder

#: Letters up to the end of Latin Extended-B, all of Unicode's class L.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
FINE = re.compile(rf"\s*[^\s{LETTERS}]*[{LETTERS}]+|\s*[^\s{LETTERS}]+|\s+")
COARSE = re.compile(r"\s*\S+|\s+")
#: White space to one rule, but not to another: texts with these are encoded whole.
UNSURE = re.compile("[\x1c-\x1f\x85]")
CACHE = 1_000_000
SEQUENCES_PER_BATCH = 64


class _Over(dict):
    """A few entries over a large dict."""

    def __init__(self, below: dict):
        super().__init__()
        self.below = below

    def __missing__(self, key):
        return self.below[key]


class Encoder:
    """The ids of texts, by a tokenizer file."""

    def __init__(self, path: str, added_tokens: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"] and (added_tokens or not t.get("special"))]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_piece:
            return self._plain(texts)
        out, known = [], self.known
        for lo in range(0, len(texts), 200):
            cut = []
            for t in texts[lo : lo + 200]:
                if UNSURE.search(t) or any(x in t for x in self.added):
                    cut.append([t])
                else:
                    cut.append((FINE if t.isascii() or max(t) < "ɐ" else COARSE).findall(t))
            new = set()
            for pieces in cut:
                new.update(pieces)
            new = list(new.difference(known))
            look = known
            if new:
                made = dict(zip(new, self._plain(new), strict=True))
                if len(known) + len(new) <= CACHE:
                    known.update(made)
                else:  # a full cache keeps what came first, which is what comes most
                    look = _Over(known)
                    look.update(made)
            if look is known:
                get = known.__getitem__
                out += [b"".join(map(get, pieces)) for pieces in cut]
            else:
                out += [b"".join([look[p] for p in pieces]) for pieces in cut]
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, added_tokens: bool) -> Encoder:
    key = path, added_tokens
    if key not in _encoders:
        _encoders[key] = Encoder(path, added_tokens)
    return _encoders[key]


def _schema(length: int, dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI, which the workers can open by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def _write(folder: str, tokenizer: str, length: int, end_id: int, added_tokens: bool):
    def run(batches):
        part = TaskContext.get().partitionId()
        own = uuid.uuid4().hex[:8]
        encoder = _encoder(tokenizer, added_tokens)
        fs, root = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], encoder.dtype).tobytes()
        schema = _schema(length, encoder.dtype)
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        width = np.dtype(encoder.dtype).itemsize
        block = SEQUENCES_PER_BATCH * length * width
        files = None
        rest, at, n_docs = bytearray(), 0, 0

        def rows(data: bytes) -> pa.RecordBatch:
            ids = np.frombuffer(data, encoder.dtype)
            full = -(-len(ids) // length) * length
            mask = np.zeros(full, bool)
            mask[: len(ids)] = True
            ids = np.concatenate([ids, np.zeros(full - len(ids), encoder.dtype)]) if full > len(ids) else ids
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)

        for b in batches:
            if not len(b):
                continue
            if files is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/ids-{part:06d}.{own}.tmp")
                index_out = fs.open_output_stream(f"{root}/index-{part:06d}.{own}.tmp")
                files = pa.ipc.new_file(out, schema), pa.ipc.new_file(index_out, index_schema)
            starts, sizes = [], []
            for lo in range(0, len(b), 500):
                for ids in encoder.encode([t or "" for t in b.column(1).slice(lo, 500).to_pylist()]):
                    rest += ids
                    rest += end
                    n = len(ids) // width + 1
                    starts.append(at)
                    sizes.append(n)
                    at += n
                while len(rest) >= block:
                    files[0].write_batch(rows(bytes(rest[:block])))
                    del rest[:block]
            n_docs += len(b)
            files[1].write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
        if files is None:
            return
        if rest:
            files[0].write_batch(rows(bytes(rest)))
        for writer, stream, name in ((files[0], out, "ids"), (files[1], index_out, "index")):
            writer.close()
            stream.close()
            fs.move(f"{root}/{name}-{part:06d}.{own}.tmp", f"{root}/{name}-{part:06d}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())], ["part", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, length: int = 2048, end_id: int = 2, added_tokens: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, and a manifest table (part, n_docs, n_tokens) in folder/manifest, which is returned."""
    spark = docs.sparkSession
    folder = _qualified(spark, folder)
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    manifest = ordered.mapInArrow(_write(f"{folder}/files", tokenizer, length, end_id, added_tokens), "part int, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _read(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for part, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = pa.ipc.open_file(_open(fs, f"{root}/index-{part:06d}.arrow")).read_all()
                sizes = index.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                crc = np.zeros(len(sizes), np.int64)
                ids_file = pa.ipc.open_file(_open(fs, f"{root}/ids-{part:06d}.arrow"))
                doc, at, now = 0, 0, 0
                for k in range(ids_file.num_record_batches):
                    batch = ids_file.get_batch(k)
                    ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
                    ids = ids[: int(batch.column(1).flatten().sum().as_py() or 0)].astype("<u4")
                    lo = 0
                    while lo < len(ids):
                        hi = min(len(ids), lo + int(ends[doc]) - at)
                        now = zlib.crc32(ids[lo:hi].tobytes(), now)
                        at += hi - lo
                        lo = hi
                        if at == ends[doc]:
                            crc[doc], now = now, 0
                            doc += 1
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(ends - sizes + before), pa.array(sizes), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _open(fs: pafs.FileSystem, path: str):
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files in folder.

    start counts the ids of all documents before it; ids_crc32 is of its ids as little-endian 32-bit integers.
    """
    folder = _qualified(spark, folder)
    manifest = spark.read.schema("part int, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files = manifest.select("part", before.alias("before")).repartition("part")
    return files.mapInArrow(_read(f"{folder}/files"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, *, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write docs into a new folder (by default in the shared one), and read each document's digest back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, folder, tokenizer=tokenizer, **options)
    return read_tokens(spark, folder)
