"""Operator 13: toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are, for each n-gram of letters of its words (lower case, with a sign for their edges), how often its distinct words hold it. Over
the training texts, the share of an n-gram among toxic and among clean features gives its log-count ratio, held towards zero where
counts are small. Logistic regression is then fitted on features times ratios, so what is rare or even between the classes can hardly get a
weight. As the score is linear, each distinct word of a batch is scored once and a text adds up its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import text_slices
from plotwise.scratch import write_table

BITS = 18
BUCKETS = 1 << BITS
SIZES = (3, 4, 5, 6)
#: Bytes of text that are taken apart at a time.
SLICE = 1_000_000
ODD = np.uint32(0x9E3779B1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, document of each word, its number among the distinct ones) of lower-case words between white space."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(words.flatten())
    return coded.dictionary, np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy())), coded.indices.to_numpy().astype(np.int64)


def each_once(doc: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of document and word."""
    pairs = np.unique(doc * max(n_words, 1) + word)
    return pairs // max(n_words, 1), pairs % max(n_words, 1)


def ngram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all n-grams of distinct words, in order of their size. The edges of a word count as a sign."""
    signs = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode("utf-32-le"), np.uint32)
    edge = signs == 32
    word = (np.cumsum(edge) - 1).astype(np.int32)  # a space belongs to the word that it begins
    to_edge = np.flatnonzero(edge)
    # how many signs there are from each sign to the space that ends its word, that space included
    reach = np.r_[to_edge[1:], to_edge[-1]][word] - np.arange(len(signs)) + 1
    at, h, found = np.arange(len(signs)), np.zeros(len(signs), np.uint32), []
    for n in range(1, SIZES[-1] + 1):
        inside = reach[at] >= n
        at, h = at[inside], h[inside]
        h = (h ^ signs[at + n - 1]) * ODD
        h ^= h >> np.uint32(15)
        if n in SIZES:
            last = (h * ODD) >> np.uint32(32 - BITS)
            found.append((word[at], last))
    return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found]).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean): what each bucket counts in the texts of a task, (toxic, text). Bucket -1 has the number of texts."""
    sums, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for lo, to in text_slices(batch.column(1), SLICE):
            part = batch.slice(lo, to - lo)
            label = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, doc, word = words_of(part.column(1))
            doc, word = each_once(doc, word, len(words))
            of, bucket = ngram_buckets(words)
            for k in (0, 1):
                times = np.bincount(word[label[doc] == k], minlength=len(words))
                sums[k] += np.bincount(bucket, times[of], BUCKETS).astype(np.int64)
                texts[k] += np.count_nonzero(label == k)
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[texts[1], sums[1, at]]), pa.array(np.r_[texts[0], sums[0, at]])], names=["bucket", "toxic", "clean"])


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, smoothing: float, least_z: float, least_ratio: float = 0.0) -> np.ndarray:
    """log of (share of a bucket among toxic features / its share among clean ones), each with ``smoothing`` counts at the overall shares; 0
    where the difference is less than ``least_z`` standard errors or the ratio nearer to 0 than ``least_ratio``, which would hardly move a score."""
    a, b = max(int(toxic.sum()), 1), max(int(clean.sum()), 1)
    share = a / (a + b)
    n = toxic + clean
    z = np.abs(toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    ratio = np.log((toxic + smoothing * share) / share) - np.log((clean + smoothing * (1 - share)) / (1 - share))
    return np.where((z >= least_z) & (np.abs(ratio) >= least_ratio), ratio, 0.0)


@dataclass
class ToxicityModel:
    """Weights (already times the ratios) of the buckets that have one, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out

    def score(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        words, doc, word = words_of(texts)
        of, bucket = ngram_buckets(words)
        own = np.bincount(of, table[bucket], len(words))
        marked = own[word] != 0
        doc, word = each_once(doc[marked], word[marked], len(words))
        return sigmoid(self.bias + np.bincount(doc, own[word], len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_slope(x: np.ndarray, docs: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood with an L2 penalty on all but the bias, which is the last of ``x``, and its gradient."""
    w, n = x[:-1], len(labels)
    s = x[-1] + np.bincount(docs, values * w[cols], n)
    p = sigmoid(s)
    loss = float(np.sum(np.logaddexp(0, s) - labels * s) + decay / 2 * (w @ w))
    back = p - labels
    return loss, np.append(np.bincount(cols, values * back[docs], len(w)) + decay * w, back.sum())


def fit_logistic(docs: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, f: int, decay: float, rounds: int) -> np.ndarray:
    """Minimum of :func:`loss_and_slope` by full-batch Adam with falling steps."""
    x, m, v = np.zeros(f + 1), np.zeros(f + 1), np.zeros(f + 1)
    if len(labels):
        x[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for t in range(1, rounds + 1 if len(labels) else 1):
        _, g = loss_and_slope(x, docs, cols, values, labels, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _chosen_features(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(toxic, columns, counts) of each text: the buckets in ``chosen``, as their places there."""
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    for batch in batches:
        for lo, to in text_slices(batch.column(1), SLICE):
            part = batch.slice(lo, to - lo)
            words, doc, word = words_of(part.column(1))
            of, bucket = ngram_buckets(words)
            has = place[bucket] >= 0
            of, col = of[has], place[bucket[has]]
            order = np.argsort(of, kind="stable")
            of, col = of[order], col[order]
            marked = np.bincount(of, minlength=len(words))[word] > 0
            doc, word = each_once(doc[marked], word[marked], len(words))
            starts = np.searchsorted(of, np.arange(len(words) + 1))
            length = np.diff(starts)[word]
            first = np.repeat(starts[:-1][word] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            pairs, counts = np.unique(np.repeat(doc, length) * max(len(chosen), 1) + col[first], return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(pairs // max(len(chosen), 1), minlength=part.num_rows))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array((pairs % max(len(chosen), 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], names=["toxic", "cols", "counts"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, smoothing: float = 10.0, least_z: float = 6.0, least_ratio: float = 0.7, decay: float = 0.1, rounds: int = 250, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> ToxicityModel:
    """A model of ``labels`` (id, toxic 0 or 1) over the texts of ``docs``.

    It is fitted on ``sample_rows`` labelled documents at most, chosen by a hash of their id, which bounds what is broadcast and what reaches
    the driver: their ids, one row of counts for each of the buckets, and the counts of the buckets that the ratios leave. Labels without an
    id, or other than 0 and 1, are not used; of several for one id the greatest counts. Without labels every score is one half or less.
    """
    rated = labels.where(f"{id_col} is not null and toxic in (0, 1)").groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, rated.count()))
    picked = rated.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), id_col).select("toxic", "text")
    sums = rows.mapInArrow(_counts, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = write_table(sums, "counts").toPandas()  # one row for each bucket at most
    toxic, clean = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    seen = sums[sums["bucket"] >= 0]
    toxic[seen["bucket"]], clean[seen["bucket"]] = seen["toxic"], seen["clean"]
    ratios = log_count_ratios(toxic, clean, smoothing, least_z, least_ratio)
    chosen = np.flatnonzero(ratios)
    table = rows.mapInArrow(partial(_chosen_features, chosen=chosen), "toxic int, cols array<int>, counts array<int>").toArrow()
    lists = table.column("cols").combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    values = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False) * ratios[chosen][cols]
    x = fit_logistic(np.repeat(np.arange(len(n)), n), cols, values, table.column("toxic").to_numpy().astype(np.float64), len(chosen), decay, rounds)
    return ToxicityModel(chosen, x[:-1] * ratios[chosen], float(x[-1]))


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel, least: float) -> Iterator[pa.RecordBatch]:
    table = model.table()
    for batch in batches:
        for lo, to in text_slices(batch.column(1), SLICE):
            part = batch.slice(lo, to - lo)
            score = model.score(part.column(1), table)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, where it is. Only the text is looked at; null texts count as empty, which score as texts without any
    marked word do; rows that repeat an id are separate; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_scored, model=model, least=least), "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where(~held_out()))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
