"""Operator 2: quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(score - threshold_k), with one weight vector over hashed text features for all grades and increasing thresholds. The
sum of these over k is the expected grade; the last is the probability of the top grade, by which documents are selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from plotwise.llm.wordtok import per_text, text_slices

BUCKETS = 1 << 18
#: The last buckets are kept for shares; each share has this many steps.
STEPS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
SHARES = ("odd endings", "bars", "capitals", "neighbours equal", "repeated words", "digits", "long words")
EDGE = ".,;:!?\"'()*&%$#|"


def word_buckets(words: pa.Array) -> np.ndarray:
    """Buckets of each distinct word, in columns: lower case and without punctuation around it; its first four letters; its first five.
    The stems catch words that come with many endings."""
    plain = pc.utf8_lower(pc.utf8_trim(words, characters=EDGE))
    room = BUCKETS - len(SHARES) * (len(STEPS) + 1)
    out = np.empty((len(plain), 3), np.int64)
    for k, letters in enumerate((None, 4, 5)):
        coded = (pc.utf8_slice_codeunits(plain, 0, letters) if letters else plain).dictionary_encode()
        hashed = np.fromiter((zlib.crc32(w.encode(), k) % room for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        out[:, k] = hashed[coded.indices.to_numpy()]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, each once: the words and stems that occur and, for each share of odd words, its step."""
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy()
    offsets = (offsets - offsets[0]).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(doc * max(len(distinct), 1) + codes)
    of, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
    buckets = word_buckets(distinct)
    flag = {
        "odd endings": pc.match_substring_regex(distinct, r"([*&%$#]{2,}|!!)$"),
        "bars": pc.match_substring(distinct, "|"),
        "capitals": pc.match_substring_regex(distinct, r"^\PL*\p{Lu}{2}[^\p{Ll}]*$"),
        "digits": pc.match_substring_regex(distinct, r"[0-9]"),
        "long words": pc.greater(pc.utf8_length(distinct), 24),
    }
    many = np.maximum(n, 1)
    share = {k: per_text(v.to_numpy(zero_copy_only=False).astype(np.int64)[codes], offsets) / many for k, v in flag.items()}
    same = np.r_[False, (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])] if len(codes) else np.zeros(0, bool)
    share["neighbours equal"] = per_text(same.astype(np.int64), offsets) / many
    share["repeated words"] = np.where(n >= 20, 1 - np.bincount(of, minlength=len(n)) / many, 0) ** 3
    docs, found = [np.repeat(of, 3)], [buckets[word].ravel()]
    for i, name in enumerate(SHARES):
        docs.append(np.arange(len(n)))
        found.append(BUCKETS - (i + 1) * (len(STEPS) + 1) + np.searchsorted(STEPS, share[name]))
    pairs = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Shared weights by bucket and increasing thresholds, one less than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, docs: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(docs, self.weights[buckets], n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return _sigmoid(scores[:, None] - self.thresholds)


def fit_arrays(docs: np.ndarray, buckets: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 250, rate: float = 0.05, decay: float = 1.0, least_z: float = 6.0) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by full-batch Adam.

    Every bucket has a weight. Its penalty is ``decay`` where its documents' grades differ from the others' by ``least_z`` standard errors or more, at
    one of the thresholds, and grows with the eighth power of what lacks: chance differences of the many rare words would otherwise add
    up in long documents. Adam works on the weights over their scale, so steps are as large as the penalty lets them be.

    The thresholds are a first one and positive steps (as exponentials), so their order holds throughout. Grades are weighted so
    that each has the same total.
    """
    size, errors = np.bincount(buckets, minlength=BUCKETS), np.zeros(BUCKETS)
    for k in range(n_grades - 1):
        above = grades > k
        p = above.mean() if len(grades) else 0.0
        off = np.abs(np.bincount(buckets, above[docs], BUCKETS) - size * p)
        errors = np.maximum(errors, off / np.sqrt(np.maximum(size * p * (1 - p), 1e-12)))
    names, cols = np.unique(buckets, return_inverse=True)
    # below half an error the penalty is over 10^8 times as large, so there is no weight to speak of
    scale = np.minimum(1.0, np.maximum(errors[names], 0.5) / least_z) ** 4
    n, f = len(grades), len(names)
    share = np.bincount(grades, minlength=n_grades)
    weight = n / np.maximum(share, 1)[grades] / np.count_nonzero(share)
    start = np.log(np.clip(np.cumsum(share)[:-1], 0.5, n - 0.5) / np.clip(n - np.cumsum(share)[:-1], 0.5, n - 0.5)) if n else np.arange(n_grades - 1.0)
    start = np.maximum.accumulate(start + np.arange(n_grades - 1) * 1e-2)
    x = np.concatenate([np.zeros(f), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1 if n else 1):
        w, theta = x[:f], x[f] + np.concatenate([[0.0], np.cumsum(np.exp(x[f + 1 :]))])
        s = np.bincount(docs, (w * scale)[cols], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(edge[grades + 1] - s), _sigmoid(edge[grades] - s)
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = weight * (slope_low - slope_high)  # of the log likelihood
        by_theta = np.array([(weight * (slope_high * (grades == k) - slope_low * (grades == k + 1))).sum() for k in range(n_grades - 1)])
        grad = np.concatenate([np.bincount(cols, by_score[docs], f) * scale - decay * w, [by_theta.sum()], np.exp(x[f + 1 :]) * np.cumsum(by_theta[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[names] = x[:f] * scale
    return OrdinalModel(weights, x[f] + np.concatenate([[0.0], np.cumsum(np.exp(x[f + 1 :]))]))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, to in text_slices(batch.column(1)):
            part = batch.slice(lo, to - lo)
            docs, buckets = features(part.column(1))
            ends = np.r_[0, np.cumsum(np.bincount(docs, minlength=part.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.astype(np.int32)))], names=["grade", "buckets"])


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> OrdinalModel:
    """A model fitted on about ``sample_rows`` rated documents at most, chosen by a hash of their id; ``ratings`` has the id and an int ``grade``.

    The bound is on training rows alone: what reaches the driver is the feature buckets of those documents. Ratings without an id
    or grade, or outside the scale, are not used; of several for one id the least counts.
    """
    rated = ratings.where(f"{id_col} is not null and grade between 0 and {n_grades - 1}").groupBy(id_col).agg(F.min("grade").cast("int").alias("grade"))
    share = min(1.0, sample_rows / max(1, rated.count()))
    chosen = rated.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about sample_rows pairs of numbers, so the broadcast has a fixed bound
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select("grade", "text")
    table = rows.mapInArrow(_features_of, "grade int, buckets array<int>").toArrow()
    lists = table.column("buckets").combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_arrays(np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().astype(np.int64), table.column("grade").to_numpy().astype(np.int64), n_grades)


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.schema.names[1:]
        for lo, to in text_slices(batch.column(0)):
            part = batch.slice(lo, to - lo)
            docs, buckets = features(part.column(0).fill_null(""))
            score = model.score(docs, buckets, part.num_rows)
            tails = model.tails(score)
            kept = pa.array(tails[:, -1] >= least)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), kept], names=[*rest, "quality_score", "expected_grade", "tail_probability", "kept"])


MADE = StructType([StructField(n, DoubleType()) for n in ("quality_score", "expected_grade", "tail_probability")] + [StructField("kept", BooleanType())])


def quoted(name: str) -> str:
    """A column name that is taken as it is, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def score_quality(docs: DataFrame, model: OrdinalModel, columns: list[str], least: float = 0.4, text_col: str = "text") -> DataFrame:
    """``columns`` of every row with quality_score, expected_grade, tail_probability and kept (tail_probability of ``least`` or more).

    Rows are scored where they are; a column of docs with one of the four names is replaced; any other column name is legal. Null texts count as empty; empty texts
    get the score of a text without words; an empty table gives an empty table.
    """
    columns = [c for c in columns if c not in MADE.fieldNames()]
    rows = docs.select(F.col(text_col).cast("string").alias("text of the row"), *[F.col(quoted(c)) for c in columns])
    schema = StructType([*rows.schema.fields[1:], *MADE.fields])
    return rows.mapInArrow(partial(_score, model=model, least=least), schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from two yes/no ratings: 0 poor, 1 readable but toxic, 2 clean; null where the quality is null."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit_quality(docs, graded(labels), 3), ["doc_id"])
