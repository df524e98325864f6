"""Token ids in flat binary files with 64-bit document offsets.

A store is a folder. Part k has three files: ``k.ids``, the ids as flat unsigned little-endian integers of 16 bits if the
vocabulary allows it and of 32 bits else; ``k.off``, signed 64-bit offsets, one more than documents, counted in ids from
the part's start; and ``k.doc``, the signed 64-bit document ids, the smallest value standing for a null. ``index.json``
names the id type and gives each part's documents and ids, and its base: the ids of all parts before it, a prefix sum.
Files are memory-mapped where the folder is local, and read by ranges elsewhere.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, scratch_path
from tessera.llm.tokens import encoder_of

END_ID = 2
NULL_ID = -(1 << 63)
#: Documents whose rows a reading task returns at once.
ROWS = 20_000
#: Bytes of text, and documents, planned for a part.
PART_BYTES, PART_DOCS = 32 << 20, 1_000_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _local(uri: str) -> str:
    """Hadoop writes file:/x and file:///x for the same place."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, keeps_space: bool = False) -> dict:
    """Encodes every row, appends ``end_id`` and writes the store in ascending order of ``doc_id``; returns its index.

    Rows are dealt by ranges of the id, each task writing a part as it encodes, so that memory holds a batch only. A part
    is written under a name of its attempt and then renamed: a task that runs again replaces the same files. Null ids come
    first; rows that repeat an id follow each other, ordered by text. A null text counts as an empty one: the end id alone.
    An empty table gives an index without parts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = _local(folder)
    kind = "<u2"
    from tokenizers import Tokenizer

    if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) > 1 << 16:
        kind = "<u4"
    end = np.array([end_id], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), None
        fs, root = _open(folder)
        offsets, own = [np.zeros(1, np.int64)], []
        for b in batches:
            if not b.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer_path, keeps_space)
                fs.create_dir(root, recursive=True)
                attempt = f"{root}/_{part}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{attempt}.ids")
            lengths = []
            for ids in encoder.encode(b.column(1)):
                lengths.append(len(ids) + 1)
                out.write(np.concatenate((ids.astype(kind), end)).tobytes())
            offsets.append(offsets[-1][-1] + np.cumsum(lengths))
            own.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if encoder is None:
            return
        out.close()
        flat = np.concatenate(offsets).astype("<i8")
        for name, data in (("off", flat), ("doc", np.concatenate(own))):
            with fs.open_output_stream(f"{attempt}.{name}") as f:
                f.write(data.tobytes())
        for name in ("ids", "off", "doc"):
            fs.move(f"{attempt}.{name}", f"{root}/{part}.{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(flat) - 1], pa.int64()), pa.array([int(flat[-1])], pa.int64())], ["part", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count("*").alias("n")).first()
    parts = max(1, spark.sparkContext.defaultParallelism, -(-(size.b or 0) // PART_BYTES), -(-size.n // PART_DOCS))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    found = sorted((r.part, r.docs, r.ids) for r in ordered.mapInArrow(run, "part int, docs long, ids long").collect())  # a row a task
    bases = np.concatenate(([0], np.cumsum([n for _, _, n in found]))).tolist()
    index = {"kind": kind, "parts": [{"part": p, "docs": d, "ids": n, "base": base} for (p, d, n), base in zip(found, bases, strict=False)]}
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def _array(fs: pafs.FileSystem, path: str, kind: str):
    """A memory-mapped array of a local file; elsewhere an object that reads the ranges asked for."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    width = np.dtype(kind).itemsize

    class Ranges:
        def __init__(self):
            self.file = fs.open_input_file(path)

        def __getitem__(self, at: slice) -> np.ndarray:
            return np.frombuffer(self.file.read_at((at.stop - at.start) * width, at.start * width), kind)

    return Ranges()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the store, a task reading whole parts."""
    folder = _local(folder)
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    kind = index["kind"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not index["parts"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for b in batches:
            for part, docs, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, off, doc = (_array(fs, f"{root}/{part}.{n}", k) for n, k in (("ids", kind), ("off", "<i8"), ("doc", "<i8")))
                for a in range(0, docs, ROWS):
                    z = min(docs, a + ROWS)
                    cut = off[a : z + 1]
                    crcs = [zlib.crc32(np.asarray(ids[int(x) : int(y)]).astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    names = np.asarray(doc[a:z])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(base + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame([(p["part"], p["docs"], p["base"]) for p in index["parts"]], "part int, docs long, base long")
    return parts.repartition(len(index["parts"])).mapInArrow(run, schema)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: the whole ``documents`` table is written as a store in the scratch folder and read back."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder)
