"""Operator 4: near-duplicate vectors by randomised-rotation binary codes.

Each unit vector is rotated ``rotations`` times and stored as sign bits with a correction factor: the inner product of the rotated
vector with its own code. The product of another vector with the code, divided by that factor, is an unbiased estimate of the cosine;
its spread is known, so a pair whose confidence bound stays below the threshold is dropped, one whose bound stays above is taken, and only
the others are recomputed in double precision. Candidates share a band of sign bits in one of the rotations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.components import connected_components
from plotwise.scratch import write_table


@lru_cache(8)
def rotation(dim: int, which: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, which]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _by_dim(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; null components are NaN."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        at = np.flatnonzero(n == dim)
        flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), dim)


def _codes(batches: Iterator[pa.RecordBatch], rotations: int, bits: int, bands: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [None] * batch.num_rows
        for at, x in _by_dim(batch.column(1)):
            dim = x.shape[1]
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(x, axis=1) if dim else np.zeros(len(at))
                fine = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0)
                unit = x[fine] / norm[fine, None]
            if not fine.any():
                continue
            width = min(bits, dim)
            words, factors, keys = [], [], []
            for r in range(rotations):
                turned = unit @ rotation(dim, r, seed)
                sign = turned >= 0
                factors.append(np.abs(turned).sum(axis=1) / math.sqrt(dim))
                padded = np.zeros((len(unit), -(-dim // 64) * 64), np.uint8)
                padded[:, :dim] = sign
                words.append(np.packbits(padded, axis=1, bitorder="little").view("<i8"))
                for b in range(min(bands, dim // width)):
                    keys.append(sign[:, b * width : (b + 1) * width] @ (1 << np.arange(width)))
            made = zip(unit.tolist(), np.concatenate(words, axis=1).tolist(), np.stack(factors, 1).tolist(), np.stack(keys, 1).tolist())
            for i, (v, w, f, k) in zip(at[fine].tolist(), made):
                out[i] = (dim, v, w, f, k)
        dim, vec, code, factor, key = zip(*[x or (None,) * 5 for x in out]) if out else [()] * 5
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((dim, vec, code, factor, key), kinds))], names=["id", "dim", "unit", "code", "factor", "keys"])


def estimates(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine, its standard error) of each unit vector with the vector behind each code, averaged over the rotations."""
    n, dim = unit.shape
    rotations = factor.shape[1]
    wide = code.reshape(n, rotations, -1)
    total, spread = np.zeros(n), np.zeros(n)
    for r in range(rotations):
        bits = np.unpackbits(np.ascontiguousarray(wide[:, r]).view(np.uint8), axis=1, bitorder="little")[:, :dim]
        f = factor[:, r]
        total += ((unit @ rotation(dim, r, seed)) * (bits * 2.0 - 1)).sum(axis=1) / math.sqrt(dim) / f
        spread += np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)
    return total / rotations, np.sqrt(spread) / rotations


def _estimated(batches: Iterator[pa.RecordBatch], threshold: float, z: float, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sure, drop = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        for at, unit in _by_dim(batch.column(2)):
            take = pa.array(at)
            code = batch.column(3).take(take).flatten().to_numpy().reshape(len(at), -1)
            factor = batch.column(4).take(take).flatten().to_numpy().reshape(len(at), -1)
            guess, error = estimates(unit, code, factor, seed)
            sure[at], drop[at] = guess - z * error >= threshold, guess + z * error < threshold
        keep = pa.array(~drop)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sure).filter(keep)], names=["a", "b", "sure"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cosine = np.zeros(batch.num_rows)
        for at, a in _by_dim(batch.column(2)):
            b = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(a.shape)
            cosine[at] = np.einsum("ij,ij->i", a, b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])


def _linked(pairs: DataFrame, vectors: DataFrame, threshold: float, z: float, seed: int) -> DataFrame:
    """(a, b, cosine) of those distinct candidate pairs that reach the threshold; where the bound decides, cosine is null."""
    pairs = write_table(pairs.select("a", "b").distinct(), "candidates")
    left = vectors.select(F.col("uid").alias("a"), F.col("unit").alias("of_a"))
    coded = vectors.select(F.col("uid").alias("b"), "code", "factor")
    right = vectors.select(F.col("uid").alias("b"), F.col("unit").alias("of_b"))
    rows = pairs.hint("merge").join(left, "a").hint("merge").join(coded, "b").select("a", "b", "of_a", "code", "factor")
    open_ = write_table(rows.mapInArrow(partial(_estimated, threshold=threshold, z=z, seed=seed), "a long, b long, sure boolean"), "undecided")
    again = open_.where("not sure").hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "of_a", "of_b")
    exact = again.mapInArrow(_exact, "a long, b long, cosine double").where(F.col("cosine") >= threshold)
    taken = open_.where("sure").select("a", "b", F.lit(None).cast("double").alias("cosine"))
    return write_table(exact.unionByName(taken), "links")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, rotations: int = 12, bits: int = 16, bands: int = 4, z: float = 6.0, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``; other columns are not read.

    Two vectors share a band of ``bits`` signs with probability (1 - angle / pi) ** bits for each of ``rotations * bands`` bands: at a
    cosine of exactly 0.95 a pair is missed once in 16,000 at the defaults, at 0.97 once in 4 million. Every pair that is
    reported is checked. In a bucket, members are first compared with its least member only. A member within half the threshold's angle
    of its leader is linked with all others like it (the angles add up to at most the threshold's), so such groups, however large,
    are counted and never expanded; only pairs with at least one other member are enumerated, by a sort-merge join whose skewed keys
    AQE splits.

    Rows that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different length do not link; repeated
    ids are separate rows; a component's id is its least non-null id; kept is false where the id is null; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    made = read.mapInArrow(partial(_codes, rotations=rotations, bits=bits, bands=bands, seed=seed), "id long, dim int, unit array<double>, code array<long>, factor array<double>, keys array<long>")
    everything = write_table(made.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    vectors = everything.where("dim is not null")
    limit = math.acos(threshold)
    p = limit / math.pi
    words = F.ceil(F.col("dim") / 64).cast("int")
    # each row keeps the first 64 signs of its band's rotation: pairs that differ there in far more places than the threshold's angle allows go
    first = F.least(F.col("dim"), F.lit(64))
    per_rotation = F.greatest(F.lit(1), F.least(F.lit(bands), F.floor(F.col("dim") / F.least(F.lit(bits), F.col("dim"))))).cast("int")
    most = first * p + z * F.sqrt(first * (p * (1 - p)))
    banded = vectors.select("uid", "dim", words.alias("words"), per_rotation.alias("per"), "code", most.alias("most"), F.posexplode("keys").alias("band", "key"))
    banded = write_table(banded.select("uid", "dim", "band", "key", "most", F.get("code", (F.floor(F.col("band") / F.col("per")) * F.col("words")).cast("int")).alias("signs")), "bands")
    bucket = ["dim", "band", "key"]
    centres = banded.groupBy(bucket).agg(F.min(F.struct("uid", "signs")).alias("c"), F.count("*").alias("n")).where("n > 1").select(*bucket, F.col("c.uid").alias("a"), F.col("c.signs").alias("signs_a"))
    near = F.bit_count(F.col("signs_a").bitwiseXOR(F.col("signs"))) <= F.col("most")
    stars = _linked(banded.hint("merge").join(centres, bucket).where((F.col("a") < F.col("uid")) & near).select("a", F.col("uid").alias("b")), vectors, threshold, z, seed)

    # a leader that the bounds alone link has no known angle, so it is counted as loose
    angle = F.acos(F.least(F.lit(1.0), F.coalesce("cosine", F.lit(threshold))))
    led = stars.groupBy("b").agg(F.min(F.struct(F.col("a").alias("leader"), angle.alias("angle"))).alias("m")).select(F.col("b").alias("uid"), "m.leader", (F.col("m.angle") <= limit / 2 - 1e-9).alias("tight"))
    of_self = stars.select(F.col("a").alias("uid")).distinct().join(led, "uid", "left_anti").select("uid", F.col("uid").alias("leader"), F.lit(True).alias("tight"))
    leaders = write_table(led.unionByName(of_self), "leaders")

    known = banded.hint("merge").join(centres.select(bucket), bucket, "left_semi").hint("merge").join(leaders, "uid", "left").withColumn("group", F.when(F.col("tight"), F.col("leader")))
    known = write_table(known, "grouped")
    main = known.where("group is not null").groupBy(*bucket, "group").count().groupBy(bucket).agg(F.max(F.struct("count", "group")).alias("m")).select(*bucket, F.col("m.group").alias("main"))
    # rows of the bucket's largest tight group meet only rows outside of it
    split = write_table(known.hint("merge").join(main, bucket, "left").withColumn("core", F.coalesce(F.col("group") == F.col("main"), F.lit(False))), "split")
    outer = split.where("not core").select(*bucket, F.col("uid").alias("x"), F.col("signs").alias("signs_a"), F.col("group").alias("group_x"))
    once = F.col("core") | (F.col("x") < F.col("uid"))
    apart = ~F.coalesce(F.col("group_x") == F.col("group"), F.lit(False))
    found = outer.hint("merge").join(split, bucket).where(once & apart & near & (F.col("x") != F.col("uid"))).select(F.least("x", "uid").alias("a"), F.greatest("x", "uid").alias("b"))
    others = _linked(found.join(stars, ["a", "b"], "left_anti"), vectors, threshold, z, seed)

    tight = leaders.where("tight").select("uid", "leader")
    of_group = tight.groupBy("leader").agg((F.count("*") - 1).alias("inner"))
    links = stars.select("a", "b").unionByName(others.select("a", "b"))
    # star links between tight members of one group are among the counted ones
    both = links.hint("merge").join(tight.select(F.col("uid").alias("a"), F.col("leader").alias("la")), "a", "left").hint("merge").join(tight.select(F.col("uid").alias("b"), F.col("leader").alias("lb")), "b", "left")
    single = both.where("not coalesce(la = lb, false)").select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("outer"))
    counted = tight.hint("merge").join(of_group, "leader").select("uid", "inner")
    nodes = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = everything.select("uid", "id").hint("merge").join(nodes.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = named.hint("merge").join(single, "uid", "left").hint("merge").join(counted, "uid", "left").hint("merge").join(least, "component")
    return out.select(F.col("id").alias("vec_id"), (F.coalesce("outer", F.lit(0)) + F.coalesce("inner", F.lit(0))).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
