"""Operator 7: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the ``k`` least distinct 64-bit hashes of a text's five-word shingles. Sketches of parts merge into the sketch of the whole; from two
sketches come estimates of resemblance and containment, from one the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
K = 128


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of ``size`` words. A text of fewer words, but some, is one shingle; one without has none.

    A shingle's hash chains the hashes of its words, so each word's text is read once: the hashes of the words are put side by side, shifted by
    0 ... size - 1 places.
    """
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def chained(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(hashed), chained), 1)


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def text_sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The sketch of a text; of null as of an empty text."""
    return sketch(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return sketch(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; exact while both have at most k/2; 1 for two empty ones."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """A sketch as text: its hashes in hex, 16 digits each, comma-joined."""
    return F.concat_ws(",", F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows (id, text, bucket, ghost): ranges of descending ids, each followed by a ghost of what comes next.

    Buckets are ranges between quantiles of the ids, so that no task gets the whole order. A ghost is a copy of the first row (all rows with its
    id) of the next bucket below; of the last bucket: of the first row of all. Null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    found = rows.agg(F.percentile_approx("id", shares, 10 * buckets).alias("e")).first().e if shares else None
    edges = F.array(*[F.lit(e).cast("long") for e in sorted(set(found or []))]).cast("array<bigint>")
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(edges, lambda e: e < F.col("id")))))
    # as many rows as there are buckets
    tops = sorted(((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect()), reverse=True)
    parts = [rows.withColumn("ghost", F.lit(False))]
    if tops:
        before = {tops[i][0]: tops[i - 1][0] for i in range(len(tops))}
        above = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))
        named = [t for _, t in tops if t is not None]
        if named:
            parts.append(rows.where(F.col("id").isin(named)).withColumns({"bucket": above, "ghost": F.lit(True)}))
        if tops[-1][0] == -1:
            parts.append(rows.where("id is null").orderBy("text").limit(1).withColumns({"bucket": above, "ghost": F.lit(True)}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """Each row's sketch against that of its edited text and of the next document by descending id (after the last: the first).

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated),
    held_by_edited (estimated containment). The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next text. Null texts count as empty; rows with the same id follow each other by text; null ids come last; a table of
    one row is its own next; an empty table gives an empty result; other columns are not read. Texts move once, dealt by ranges of ids.
    """
    spark = docs.sparkSession
    rows = in_order(docs, id_col, text_col, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    step = rows.withColumn("next", F.coalesce(F.lead("text").over(w), F.lit(""))).withColumn("edited", F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.left("next", half)))
    step = step.select("id", "bucket", "ghost", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_sketch(F.col("text"), k, size).alias("own"), text_sketch(F.col("edited"), k, size).alias("edit"))
    step = step.withColumn("after", F.lead("own").over(w)).where("not ghost")
    own, edit, after = F.col("own"), F.col("edit"), F.col("after")
    return step.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(edit).alias("edited_fingerprint"), resemblance(own, edit, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"), distinct_shingles(own, k).alias("n_shingles"), containment(own, edit, k).alias("held_by_edited"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
