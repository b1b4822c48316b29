"""Operator 10: bounded-space online packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import default_tokenizer, library_encoder, text_slices
from plotwise.scratch import write_table

END_ID = 2
#: Columns of a piece.
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{x} long" for x in FIELDS)


class Packer:
    """Open windows of one task.

    A piece goes to the open window that it fills best. If none has room and no more may be opened, the fullest is emitted; a gap of more
    than ``max_pad`` ids in it is first filled with the head of the piece. So a window costs at most ``max_pad`` ids of padding.
    """

    def __init__(self, window: int, open_windows: int, max_pad: int, first_id: int):
        self.window, self.most, self.max_pad, self.next_id = window, open_windows, max_pad, first_id
        self.gaps = np.zeros(0, np.int64)
        self.open: list[list[tuple]] = []
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def close(self, i: int) -> None:
        self.emit(self.open.pop(i))
        self.gaps = np.delete(self.gaps, i)

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        """ids: the ids from ``start`` on of a document of ``total`` ids, to be placed whole or in pieces."""
        while len(ids) >= self.window:
            self.emit([(doc, start, total, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            room = np.where(self.gaps >= len(ids), self.gaps, self.window + 1)
            i = int(room.argmin()) if len(room) else -1
            take = len(ids)
            if i < 0 or room[i] > self.window:
                if len(self.open) < self.most:
                    i = len(self.open)
                    self.open.append([])
                    self.gaps = np.append(self.gaps, self.window)
                else:
                    i = int(self.gaps.argmin())
                    take = int(self.gaps[i])
                    if take <= self.max_pad:
                        self.close(i)
                        continue
            self.open[i].append((doc, start, total, ids[:take].copy()))
            self.gaps[i] -= take
            start, ids = start + take, ids[take:]
            if not self.gaps[i]:
                self.close(i)

    def finish(self) -> None:
        """Emit what is left in the open windows as full windows and, for the rest, windows of a power of two: none is padded."""
        left = [p for pieces in self.open for p in pieces]
        self.open, self.gaps = [], np.zeros(0, np.int64)
        rest = sum(len(p[3]) for p in left)
        now: list[tuple] = []
        need = min(self.window, 1 << (rest.bit_length() - 1)) if rest else 0
        for doc, start, total, ids in left:
            while len(ids):
                take = min(need, len(ids))
                now.append((doc, start, total, ids[:take]))
                start, ids, need, rest = start + take, ids[take:], need - take, rest - take
                if not need:
                    self.emit(now)
                    now, need = [], min(self.window, 1 << (rest.bit_length() - 1)) if rest else 0


def _columns(done: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, pa.int64()) for x in zip(*done)] if done else [pa.array([], pa.int64())] * len(FIELDS)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int, open_windows: int, max_pad: int) -> Iterator[pa.RecordBatch]:
    encoder, part = library_encoder(tokenizer), TaskContext.get().partitionId()
    packer = Packer(window, open_windows, max_pad, part << 32)
    names = [*FIELDS, "part", "ids"]

    def flush() -> pa.RecordBatch:
        own, packer.done = packer.done, []
        return pa.RecordBatch.from_arrays([*_columns(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary())], names=names)

    for batch in batches:
        for lo, to in text_slices(batch.column(1)):
            chunk = batch.slice(lo, to - lo)
            ids, lengths = encoder.encode(chunk.column(1))
            at = 0
            for doc, n in zip(chunk.column(0).to_pylist(), lengths.tolist()):
                packer.add(doc, 0, n + 1, np.append(ids[at : at + n], np.int32(end_id)))
                at += n
            yield flush()
    left = [(doc, start, len(ids), None, total, k, None, part, ids.astype("<u4").tobytes()) for k, pieces in enumerate(packer.open) for doc, start, total, ids in pieces]
    yield flush()
    if left:
        kinds = [pa.int64()] * 8 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*left), kinds)], names=names)


def _merge(key: tuple, left: pd.DataFrame, window: int, open_windows: int, max_pad: int) -> pd.DataFrame:
    packer = Packer(window, open_windows, max_pad, ((1 << 24) + int(key[0])) << 32)
    left = left.sort_values(["length", "part", "sequence_id", "doc_id", "start"], ascending=[False, True, True, True, True], kind="stable")
    for doc, start, total, ids in zip(left["doc_id"], left["start"], left["doc_tokens"], left["ids"]):
        packer.add(None if doc is None else int(doc), int(start), int(total), np.frombuffer(ids, "<u4"))
    packer.finish()
    out = pd.DataFrame(packer.done, columns=FIELDS)
    return out.astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, open_windows: int = 32, max_pad: int = 32, end_id: int = END_ID, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id. Whole windows are cut from long documents; what remains goes to ``open_windows`` open windows a
    partition (see :class:`Packer`), so no text is shuffled. What is still open at the end of a partition, at most ``open_windows *
    window`` ids, is merged with that of ``fan_in - 1`` other partitions in a task, whose own rest becomes sequences of a power of two
    ids, which need no padding. Null texts count as empty and give a piece of one id; null and repeated doc_ids are kept as they are;
    an empty table gives no pieces; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = {"window": window, "open_windows": open_windows, "max_pad": max_pad}
    made = write_table(rows.mapInArrow(partial(_pack, tokenizer=tokenizer, end_id=end_id, **sizes), f"{SCHEMA}, part long, ids binary"), "pieces")
    left = made.where("part is not null").withColumns({"merge": F.floor(F.col("part") / fan_in), "doc_id": F.col("doc_id").cast("string")})
    merged = left.groupBy("merge").applyInPandas(partial(_merge, **sizes), SCHEMA)
    return made.where("part is null").select(*FIELDS).unionByName(merged)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer("word_bpe_49k.json"))
