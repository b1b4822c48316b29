"""Operator 12: hard negatives by BOND, a vertical scan with bounds.

Vectors are stored in blocks, dimension by dimension, with the least and the greatest value of each dimension in the block. A scan for an anchor reads
the dimensions in descending order of the anchor's own components. After each few of them, a row's partial inner product and what the remaining
dimensions can add at least and at most bound its score; rows that can no longer be among those asked for leave the bitmap of candidates.
The few that stay are known exactly at the end.

Two scans are made: the nearest rows of the anchor's own label are its positives; each positive gives a window of scores, and the highest rows of other
labels within each window are its hard negatives. Every block of rows meets every block of anchors, the stated query set, in a task of
its own and gives out only its best few, which are then ranked by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwise.scratch import write_table

#: Components of a block of rows, anchors of a block of anchors, and dimensions that are read between two looks at the bounds.
CELLS, ANCHORS, STEP = 1 << 22, 4096, 8
BLOCKS = "n long, width long, small boolean, cells binary, least array<double>, most array<double>, uids binary, ids binary, labels binary"
LONG = (1 << 63) - 1


def block_of(uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, cells: np.ndarray) -> dict:
    """``cells`` (rows, dimensions) of whole numbers as doubles, turned so that a dimension's values lie together; in 16 bits if they fit."""
    small = bool(np.all(np.abs(cells) < 32768))
    turned = np.ascontiguousarray(cells.T.astype(np.int16 if small else np.float64))
    return {"n": len(uid), "width": cells.shape[1], "small": small, "cells": turned.tobytes(), "least": cells.min(axis=0).tolist(), "most": cells.max(axis=0).tolist(), "uids": uid.astype(np.int64).tobytes(), "ids": vec_id.astype(np.int64).tobytes(), "labels": label.astype(np.int64).tobytes()}


def _as_record(blocks: list[dict]) -> pa.RecordBatch:
    kinds = {"n": pa.int64(), "width": pa.int64(), "small": pa.bool_(), "cells": pa.binary(), "least": pa.list_(pa.float64()), "most": pa.list_(pa.float64()), "uids": pa.binary(), "ids": pa.binary(), "labels": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([b[c] for b in blocks], k) for c, k in kinds.items()], names=list(kinds))


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of (uid, vec_id, label, vector); a block holds vectors of one width."""
    waiting: dict = {}
    for batch in batches:
        lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
        uid, vec_id, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            flat = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            waiting.setdefault(width, []).append((uid[at], vec_id[at], label[at], np.floor(scale * flat).reshape(len(at), width)))
            most = max(256, CELLS // max(width, 1))
            if sum(len(x[0]) for x in waiting[width]) >= most:
                whole = [np.concatenate(x) for x in zip(*waiting[width])]
                while len(whole[0]) >= most:
                    yield _as_record([block_of(*(x[:most] for x in whole))])
                    whole = [x[most:] for x in whole]
                waiting[width] = [tuple(whole)] if len(whole[0]) else []
    for parts in waiting.values():
        if parts:
            yield _as_record([block_of(*(np.concatenate(x) for x in zip(*parts)))])


def _anchors(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(uid, vec_id, label, vector) of the rows of the blocks whose vec_id is divisible by ``every``."""
    for batch in batches:
        for b in batch.to_pylist():
            uid, vec_id, label = (np.frombuffer(b[c], np.int64) for c in ("uids", "ids", "labels"))
            cells = np.frombuffer(b["cells"], np.int16 if b["small"] else np.float64).reshape(b["width"], b["n"])
            at = np.flatnonzero(vec_id % every == 0)
            if len(at):
                own = cells[:, at].T.astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(vec_id[at]), pa.array(label[at]), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["uid", "vec_id", "label", "vector"])


class Block:
    """A block of rows ready for scans. Sums are exact: in 32 or 64 bits where these hold every sum, else in whole numbers of any size."""

    def __init__(self, row):
        self.width, n = int(row.width), int(row.n)
        self.uid, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (row.uids, row.ids, row.labels))
        self.raw = np.frombuffer(row.cells, np.int16 if row.small else np.float64).reshape(self.width, n)
        self.least, self.most = np.asarray(row.least, np.float64), np.asarray(row.most, np.float64)
        self.size = max(float(np.max(np.abs(self.least), initial=0)), float(np.max(np.abs(self.most), initial=0)))
        self.cast: dict = {}

    def kind(self, anchor: np.ndarray):
        own = float(np.abs(anchor).sum())
        bound = max(own, self.size, own * self.size)
        return np.int32 if bound < 2**30 else np.int64 if bound < 2**61 else object

    def columns(self, kind) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.raw.astype(kind) if kind is not object else np.array([[int(x) for x in c] for c in self.raw.tolist()], object).reshape(self.raw.shape)
        return self.cast[kind]


def whole(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(kind) if kind is not object else np.array([int(v) for v in x.tolist()], object)


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, keeps: Callable, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the rows of ``alive`` that ``keeps(partial, least, most)`` leaves, given what remaining dimensions can add.

    Vectors of different widths are compared as if the shorter one ended in zeros.
    """
    anchor = anchor[: block.width]
    order = np.argsort(-np.abs(anchor), kind="stable")
    kind = block.kind(anchor)
    columns, a = block.columns(kind), whole(anchor[order], kind)
    low, high = whole(block.least[order], kind), whole(block.most[order], kind)
    ends = np.stack([a * low, a * high]) if len(a) else np.zeros((2, 0), kind)
    left = [np.concatenate([np.cumsum(f(ends, axis=0)[::-1])[::-1], np.zeros(1, kind)]) for f in (np.min, np.max)]
    at, score = alive, np.zeros(len(alive), kind)
    for k in range(0, max(len(order), 1), step):
        every = len(at) == columns.shape[1]
        for d, x in zip(order[k : k + step], a[k : k + step]):
            score = score + x * (columns[d] if every else columns[d][at])
        done = min(k + step, len(order))
        keep = keeps(score, left[0][done], left[1][done])
        at, score = at[keep], score[keep]
        if not len(at):
            break
    return at, score


def kth(values: np.ndarray, k: int):
    """The k-th greatest value."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def among_best(k: int) -> Callable:
    """For :func:`scan`: rows that may be among the ``k`` highest, ties included."""
    return lambda s, least, most: s + most >= kth(s, k) + least if len(s) > k else np.ones(len(s), bool)


def within_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """For :func:`scan`: rows that may be among the ``k`` highest of those within one of the windows, ties included."""

    def keeps(s, least, most):
        keep = np.zeros(len(s), bool)
        for low, high in windows:
            may = (s + most >= low) & (s + least <= high)
            sure = (s + least >= low) & (s + most <= high)
            if np.count_nonzero(sure) >= k:
                may &= s + most >= kth(s[sure], k) + least
            keep |= may
        return keep

    return keeps


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the smaller id first among equal ones."""
    if len(score) > k:
        at = np.flatnonzero(score >= kth(score, k))
    else:
        at = np.arange(len(score))
    return at[sorted(range(len(at)), key=lambda i: (-int(score[at[i]]), int(ids[at[i]])))[:k]] if score.dtype == object else at[np.lexsort((ids[at], -score[at]))[:k]]


def _meet(key: tuple, rows: pd.DataFrame, anchors: pd.DataFrame, each: Callable, columns: list[str]) -> pd.DataFrame:
    out: list = []
    for row in rows.itertuples():
        block = Block(row)
        for group in anchors["anchors"]:
            for a in group:
                out += each(block, a)
    return pd.DataFrame(out, columns=columns)


def _own_label(block: Block, a, k: int) -> list[tuple]:
    at = np.flatnonzero((block.labels == a["label"]) & (block.uid != a["uid"]))
    at, score = scan(np.asarray(a["vector"], np.float64), block, at, among_best(k))
    ids = block.ids[at]
    return [(a["uid"], int(ids[i]), max(-LONG, min(LONG, int(score[i])))) for i in best(ids, score, k)]


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score with low * positive <= 100 * score <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _other_labels(block: Block, a, k: int, low: int, high: int) -> list[tuple]:
    positives = [(p["positive_id"], int(p["score"]), p["place"]) for p in a["positives"]]
    windows = {p: window_of(p, low, high) for _, p, _ in positives}
    asked = sorted({w for w in windows.values() if w[0] <= w[1]})
    if not asked:
        return []
    at, score = scan(np.asarray(a["vector"], np.float64), block, np.flatnonzero(block.labels != a["label"]), within_windows(asked, k))
    ids, found = block.ids[at], {}
    for w in asked:
        inside = np.flatnonzero((score >= w[0]) & (score <= w[1]))
        found[w] = [(int(ids[inside[i]]), int(score[inside[i]])) for i in best(ids[inside], score[inside], k)]
    return [(a["uid"], a["vec_id"], pid, p, place, nid, s) for pid, p, place in positives for nid, s in found.get(windows[p], [])]


def _all_blocks(blocks: DataFrame, anchors: DataFrame, parts: int, each: Callable, schema: str) -> DataFrame:
    """What ``each(block, anchor)`` gives for all blocks of rows and all anchors; anchors go in ``parts`` blocks."""
    own = [c for c in anchors.columns]
    packed = write_table(anchors.groupBy(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(*own)).alias("anchors")), "anchors")
    numbers = blocks.agg(F.collect_list("block").alias("all"))  # one row: a number for each block of rows
    right = packed.crossJoin(F.broadcast(numbers)).select("part", "anchors", F.explode("all").alias("block"))
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(key, rows: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        return _meet(key, rows, met, each, names)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, schema)


def mine_hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, embedding, label).

    Scores are inner products of floor(``scale`` * component). Anchors are the rows whose vec_id is divisible by ``every``; their positives the
    first ``positives`` other rows of their label; their negatives, for each positive, the first ``negatives`` rows of another label whose score is
    between ``low`` and ``high`` hundredths of the positive's. Higher scores come first, then smaller ids. Without a positive, or
    a row in the window, there is no row.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that repeat an id are separate rows, and separate
    anchors. Vectors of different widths are compared as if the shorter ended in zeros; a score beyond a long counts as the greatest
    one, its window too. An empty table gives an empty result; other columns are not read.

    Vectors are written once, in blocks by dimension. Blocks of rows and blocks of up to about 4,096 anchors meet by an equi-join on their numbers:
    a block of rows is sent once for each block of anchors, a block of anchors once for each block of rows.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) <= F.lit(1.7976931348623157e308 / max(scale, 1)), F.lit(False)))
    plain = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    plain = plain.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    blocks = write_table(plain.mapInArrow(partial(_blocks, scale=scale), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    anchors = write_table(blocks.mapInArrow(partial(_anchors, every=every), "uid long, vec_id long, label long, vector array<double>"), "anchor_rows")
    parts = max(1, -(-anchors.count() // ANCHORS))

    near = _all_blocks(blocks, anchors, parts, partial(_own_label, k=positives), "uid long, positive_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "positive_id")
    near = write_table(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    given = near.groupBy("uid").agg(F.collect_list(F.struct("positive_id", "score", "place")).alias("positives"))
    asking = write_table(anchors.hint("merge").join(given, "uid"), "asking")

    far = _all_blocks(blocks, asking, parts, partial(_other_labels, k=negatives, low=low, high=high), "uid long, anchor_id long, positive_id long, positive_score long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mixed_labels(rows: DataFrame) -> DataFrame:
    """The embeddings with every seventh label moved on by one."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(mixed_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as own, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where own qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) as integer) as rank, n.other_id as negative_id, p.positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.own and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) <= 10
"""
