"""Operator 3: byte-pair encoding and decoding by batched merge rounds over one flat symbol array."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import RowTable, default_tokenizer, per_text, ranges, text_slices

NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BatchedBPE:
    """A byte-level vocabulary with ranked merges, read from a tokenizer file."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        vocab, letters = x["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in x["added_tokens"]}
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in x["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab["".join(m)] for m in pairs], np.int32)
        keys = left << 32 | right
        first = np.unique(keys, return_index=True)[1]  # a pair that is listed twice keeps its lowest rank
        self.keys, self.rank, self.made = keys[first], first.astype(np.int32), made[first]
        self.by_rank = made
        byte_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        held: list[bytes] = [b""] * size
        for t, i in vocab.items():
            held[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        for t, i in self.special.items():
            held[i] = t.encode()
        self.length = np.array([len(b) for b in held], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(held), np.uint8)
        self.pieces = regex.compile(self.PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.segments, self.words = RowTable(), RowTable(300_000)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, found by binary search over the sorted pair keys."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NEVER)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word). In each round every word merges all places of its lowest-ranked pair at once."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        out_symbols, out_owner = [], []
        rank = np.full(len(symbols), NEVER, np.int32)
        if len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            if (least == NEVER).any():
                ready = np.repeat(least == NEVER, size)
                out_symbols.append(symbols[ready])
                out_owner.append(owner[ready])
                symbols, owner, rank = symbols[~ready], owner[~ready], rank[~ready]
                size, least = size[least != NEVER], least[least != NEVER]
                if not len(symbols):
                    break
            here = rank == np.repeat(least, size)
            if (here[1:] & here[:-1]).any():  # a run of the same symbol: every second place, from the left
                index = np.arange(len(here))
                began = np.maximum.accumulate(np.where(here & ~np.r_[False, here[:-1]], index, 0))
                here &= (index - began) % 2 == 0
            symbols = np.where(here, self.by_rank[np.minimum(rank, len(self.by_rank) - 1)], symbols)
            keep = ~np.r_[False, here[:-1]]
            symbols, owner, rank, fresh = symbols[keep], owner[keep], rank[keep], here[keep]
            stale = np.flatnonzero(fresh | np.r_[fresh[1:], False])
            inside = stale[stale + 1 < len(symbols)]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[stale] = NEVER
            rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        flat, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_symbols, out_owner))
        return flat[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of.astype(np.int64), minlength=len(words)).astype(np.int64)

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that the pattern may be applied to on their own."""
        found = [self.pieces.findall(s) for s in segments]
        n = np.fromiter(map(len, found), np.int64, len(found))
        if not n.sum():
            return np.zeros(0, np.int32), n
        coded = pc.dictionary_encode(pa.array([p for f in found for p in f], pa.string()))
        rows = self.words.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.merge)[coded.indices.to_numpy()]
        flat, lengths = self.words.take(rows)
        return flat, per_text(lengths, np.r_[0, np.cumsum(n)])

    def _whole(self, text: str) -> np.ndarray:
        """Ids of any text: special strings first, the pattern between them."""
        ids = [np.zeros(0, np.int32)]
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            ids.append(np.array([self.special[part]], np.int32) if k % 2 else self._segments([part])[0])
        return np.concatenate(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text); the array has no nulls.

        A single space between two words always begins a piece of the pattern, and a line break between two words is a piece of its own,
        so each distinct word, with or without the space before it, is encoded once. Texts with other white space or special strings are
        encoded whole.
        """
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        offsets = words.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = pc.dictionary_encode(words.flatten())
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy().astype(np.int64)
        odd = np.fromiter((w != "\n" and (not w or w[0].isspace() or w[-1].isspace() or any(s in w for s in self.special)) for w in names), bool, len(names))
        line = np.fromiter((w == "\n" for w in names), bool, len(names))
        spaced = np.r_[False, ~line[codes[:-1]]] & ~line[codes] if len(codes) else np.zeros(0, bool)
        spaced[offsets[:-1][offsets[:-1] < len(codes)]] = False
        by_text = per_text(odd[codes], offsets) > 0
        # a line break at either end of a text is beside an empty word, so it is odd already
        variant = codes * 2 + spaced
        used, place = np.unique(variant, return_inverse=True)
        strings = [(" " if v & 1 else "") + names[v >> 1] for v in used.tolist()]
        fine = ~odd[used >> 1]
        rows = np.zeros(len(used), np.int64)
        rows[fine] = self.segments.rows([s for s, x in zip(strings, fine) if x], self._segments)
        lengths = np.where(fine, self.segments.length[rows], 0)
        if not by_text.any():
            flat, _ = self.segments.take(rows[place])
            return flat, per_text(lengths[place], offsets)
        flat, of = [], []
        for i in range(len(texts)):
            if by_text[i]:
                ids = self._whole(texts[i].as_py())
            else:
                ids, _ = self.segments.take(rows[place[offsets[i] : offsets[i + 1]]])
            flat.append(ids)
            of.append(len(ids))
        return np.concatenate(flat), np.array(of, np.int64)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
        n = self.length[ids]
        raw = self.bytes[ranges(self.start[ids], n)].tobytes()
        ends = np.cumsum(per_text(n, np.r_[0, np.cumsum(lengths)])).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]


_models: dict[str, BatchedBPE] = {}


def batched_bpe(path: str) -> BatchedBPE:
    if path not in _models:
        _models[path] = BatchedBPE(path)
    return _models[path]


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    model = batched_bpe(tokenizer)
    for batch in batches:
        for lo, to in text_slices(batch.column(1)):
            part = batch.slice(lo, to - lo)
            ids, lengths = model.encode(part.column(1))
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, in place: no row moves. Null texts count as empty and have no ids; null and repeated
    document ids are kept; an empty table gives an empty table; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_encode, tokenizer=tokenizer), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    model = batched_bpe(tokenizer)
    for batch in batches:
        ids = batch.column(1)
        texts = model.decode(ids.flatten().to_numpy(), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of a table of (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, tokenizer=tokenizer), "doc_id long, text string")


def _digests(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    model = batched_bpe(tokenizer)
    for batch in _encode(batches, tokenizer):
        lists = batch.column(1)
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ids = lists.flatten().to_numpy()
        wide, ends = ids.astype("<u4"), np.cumsum(lengths).tolist()
        of_ids = [hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends)]
        of_text = [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, lengths)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes and digests in one pass, so that ids and texts never leave the worker."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_digests, tokenizer=default_tokenizer("byte_bpe_50k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
