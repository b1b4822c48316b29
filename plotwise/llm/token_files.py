"""Operator 1: a corpus as flat token-id files with 64-bit document offsets.

Format of a folder: for shard i the files ``i.ids`` (unsigned little-endian ids of all its documents, 16 bits wide if the vocabulary
fits, else 32), ``i.offsets`` (int64, one more than documents: where each begins within the shard) and ``i.docs`` (int64 document ids,
the least int64 for null), and ``manifest.json`` (width, end id, shards with documents, ids and the base: ids of all shards before).
Shards are in ascending document id, so shard base + offset is a document's place in the whole corpus. All files can be memory-mapped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm import shared_files
from plotwise.llm.wordtok import default_tokenizer, library_encoder, text_slices
from plotwise.scratch import scratch_path

NO_ID = np.iinfo(np.int64).min
END_ID = 2


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    width: int
    end_id: int
    #: (shard, documents, ids, base)
    shards: tuple[tuple[int, int, int, int], ...]

    @staticmethod
    def load(folder: str) -> TokenFiles:
        x = json.loads(shared_files.read_bytes(f"{folder}/manifest.json"))
        return TokenFiles(folder, x["width"], x["end_id"], tuple(map(tuple, x["shards"])))

    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, documents) of a shard, memory-mapped."""
        return tuple(shared_files.read_array(f"{self.folder}/{i}.{x}", t) for x, t in (("ids", self.dtype()), ("offsets", "<i8"), ("docs", "<i8")))


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, task = library_encoder(tokenizer), TaskContext.get()
    shard, own = task.partitionId(), f".{task.taskAttemptId()}.tmp"
    names = [f"{folder}/{shard}.{x}" for x in ("ids", "offsets", "docs")]
    documents = total = 0
    files = [shared_files.open_out(x + own) for x in names]
    try:
        files[1].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for lo, to in text_slices(batch.column(1)):
                part = batch.slice(lo, to - lo)
                ids, lengths = encoder.encode(part.column(1))
                lengths = lengths + 1
                ends = np.cumsum(lengths)
                out = np.empty(ends[-1], encoder.dtype)
                tail = np.zeros(ends[-1], bool)
                tail[ends - 1] = True
                out[tail], out[~tail] = end_id, ids
                files[0].write(out.tobytes())
                files[1].write((total + ends).astype("<i8").tobytes())
                files[2].write(part.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                documents, total = documents + part.num_rows, total + int(ends[-1])
    finally:
        for f in files:
            f.close()
    for x in names:
        shared_files.move(x + own, x)
    yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [documents], "ids": [total], "width": [encoder.dtype.itemsize]})


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenFiles:
    """Encode every text of ``docs`` and write the folder; other columns are not read.

    Null texts count as empty (only the end id is written), a null id is kept and comes first, rows with the same id stay separate (in order
    of a hash of their text), an empty table gives shards without documents. Documents are range-partitioned by id, so no task gets
    more than its share however the input is laid out. A task commits its files by renaming them, so retries are safe. What comes
    back to the driver is one row a shard, from which the bases are summed.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token_files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    made = sorted_rows.mapInArrow(partial(_write_shard, folder=folder, tokenizer=tokenizer, end_id=end_id), "shard long, documents long, ids long, width long").collect()
    shards_, base, width = [], 0, max([r.width for r in made], default=4)
    for r in sorted(made, key=lambda r: r.shard):
        shards_.append((r.shard, r.documents, r.ids, base))
        base += r.ids
    with shared_files.open_out(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"width": width, "end_id": end_id, "shards": shards_}).encode())
    return TokenFiles(folder, width, end_id, tuple(shards_))


def _read_shards(batches: Iterator[pa.RecordBatch], files: TokenFiles, step: int) -> Iterator[pa.RecordBatch]:
    base = {s: b for s, _, _, b in files.shards}
    for batch in batches:
        for s in batch.column(0).to_pylist():
            ids, offsets, docs = files.shard(s)
            at = 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
                wide = ids[offsets[at] : offsets[to]].astype("<u4")
                cut = offsets[at : to + 1] - offsets[at]
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                doc = np.asarray(docs[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(base[s] + np.asarray(offsets[at:to])), pa.array(np.diff(cut)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                at = to


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one task a shard."""
    n = max(1, len(files.shards))
    shards = spark.range(0, len(files.shards), 1, n)
    return shards.mapInArrow(partial(_read_shards, files=files, step=1_000_000), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, write_token_files(docs, default_tokenizer("word_bpe_49k.json")))
