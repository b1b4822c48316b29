"""Operator 5: near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment.

For each of ``sketches`` random orders, the ``keep`` least of a text's occurrence-labelled shingles are taken and their hashes, in text
order, make one key. Texts collide if they share those shingles in the same order, which follows the edit distance, not the set. Texts with
a common key are candidates; they are linked if a banded alignment of their words finds an edit similarity (1 - distance / longer
length) of ``similarity`` or more. Classes are the connected components of the links.

An edit similarity of 0.8 with the edits spread evenly leaves a third of the five-word shingles of a text, an overlap of only 0.2. So many
orders with short keys are used: two texts with a shingle overlap J have a common key with probability 1 - (1 - J**keep)**sketches, which for
the defaults is 0.94 at J = 0.2 and 0.9999 at 0.35.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import text_slices
from plotwise.operators.components import connected_components
from plotwise.scratch import write_table

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a text's bag of words, and how many occurrences of a word have a bit; later ones are counted.
BAG, LABELS = 4096, 8
#: Texts of one key that are compared with as many others at a time.
BLOCK = 512
#: Bits of the bucket in which an element of a text is counted, and how many rare elements two texts must share.
BITS, SHARED = 18, 3
#: Up to so many others that a text meets by its rare elements, on average, texts are brought together by them; beyond it, in blocks.
MET = 16.0


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each white-space word of all texts, words of each text)."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = pc.dictionary_encode(words.flatten())
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    offsets = words.offsets.to_numpy()
    codes = coded.indices.to_numpy()
    empty = np.fromiter((w == "" for w in coded.dictionary.to_numpy(zero_copy_only=False)), bool, len(hashed))[codes] if len(codes) else np.zeros(0, bool)
    total = np.r_[0, np.cumsum(~empty)]
    at = offsets - offsets[0]
    return hashed[codes[~empty]] if len(codes) else np.zeros(0, np.uint64), total[at[1:]] - total[at[:-1]]


def occurrences(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each hash stood before in the same text."""
    own = mixed(hashes + doc.astype(np.uint64) * ODD)  # equal only for the same hash in the same text
    order = np.argsort(own, kind="stable")
    run = own[order]
    index = np.arange(len(run))
    began = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], index, 0)) if len(run) else index
    seen = np.empty(len(run), np.uint64)
    seen[order] = (index - began).astype(np.uint64)
    return seen


def labelled_shingles(words: np.ndarray, n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle with the count of its earlier occurrences in the text, shingles of each text). A text of fewer than
    ``size`` words, but some, is one shingle."""
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n_words) - n_words
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    length = np.repeat(np.minimum(n_words, size), n)
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        more = length > k
        h = np.where(more, mixed(h * ODD + words[np.minimum(first + k, max(len(words) - 1, 0))] + np.uint64(k + 1)), h) if len(words) else h
    return mixed(h + occurrences(h, doc) * np.uint64(0xD6E8FEB86659FD93)), n


def order_min_hash(shingles: np.ndarray, n: np.ndarray, sketches: int, keep: int, seed: int) -> np.ndarray:
    """(texts, sketches) keys; a text with fewer than ``keep`` shingles uses all. Rows of texts without shingles are zero."""
    rng = np.random.default_rng(seed)
    salts = rng.integers(1, 1 << 63, sketches, dtype=np.uint64) | np.uint64(1)
    adds = rng.integers(0, 1 << 63, sketches, dtype=np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), sketches), np.uint64)
    # of a text's values, as many as are surely needed lie below this share of the range
    share = np.minimum(1.0, (keep + 6 * np.sqrt(keep) + 6) / np.maximum(n, 1))
    limit = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (np.minimum(share, 0.999) * 2.0**64).astype(np.uint64))
    limits = limit[doc]
    need = np.minimum(n, keep)
    for s in range(sketches):
        value = (shingles ^ adds[s]) * salts[s]
        value ^= value >> np.uint64(32)
        value *= salts[s]
        at = np.flatnonzero(value <= limits)
        few = np.bincount(doc[at], minlength=len(n)) < need
        if few.any():
            at = np.flatnonzero((value <= limits) | few[doc])
        of = doc[at]
        rank_order = np.lexsort((value[at], of))
        at, of = at[rank_order], of[rank_order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        chosen = np.sort(at[place < keep])  # back in text order
        of = doc[chosen]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        key = np.zeros(len(n), np.uint64)
        for k in range(keep):
            here = place == k
            key[of[here]] = mixed(key[of[here]] * ODD + shingles[chosen[here]] + np.uint64(k + 1))
        out[:, s] = mixed(key + np.uint64((s + 1) * int(ODD) % (1 << 64)))
    return out


def _signatures(batches: Iterator[pa.RecordBatch], size: int, sketches: int, keep: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, to in text_slices(batch.column(1), 2_000_000):
            part = batch.slice(lo, to - lo)
            words, n_words = word_hashes(part.column(1))
            keys = order_min_hash(*labelled_shingles(words, n_words, size), sketches, keep, seed)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * sketches), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words.astype(np.int32)), keys], names=["id", "h", "n_words", "keys"])


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits, more): of each text, bits of its occurrence-labelled words, and how many words have a label too high for a bit.

    An edit adds at most one labelled word to a text and takes at most one from it, so two texts are at least as many edits apart as either has
    bits, and further words, that the other lacks.
    """
    words, n_words = word_hashes(texts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    seen = occurrences(words, doc)
    low = seen < np.uint64(LABELS)
    bits = np.zeros((len(n_words), BAG), bool)
    bits[doc[low], mixed(words[low] + (seen[low] + np.uint64(1)) * ODD) % np.uint64(BAG)] = True
    return np.packbits(bits, axis=1), np.bincount(doc[~low], minlength=len(n_words))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, to in text_slices(batch.column(1), 2_000_000):
            for at in range(lo, to, 1000):
                part = batch.slice(at, min(1000, to - at))
                bits, more = bags(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(more)], names=["uid", "bits", "more"])


def _lacks(bits: np.ndarray, more: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number of labelled words of each text i that its text j lacks."""
    return np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64) + np.maximum(more[i] - more[j], 0)


def _blocks_met(rows: pd.DataFrame, held: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The pairs of all block pairs in ``rows`` that may be alike: in different components, with lengths and bags that allow the similarity, and
    under the first of their common keys, so that no pair comes twice. ``held`` has the bag and the keys of each text in ``rows``."""
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "most")})
    if not len(rows):
        return none
    held = held.sort_values("uid")
    bits = np.frombuffer(b"".join(held["bits"]), np.uint64).reshape(len(held), -1)
    keys, uid, more = np.stack(held["keys"].to_numpy()), held["uid"].to_numpy(), held["more"].to_numpy()
    text = np.searchsorted(uid, rows["uid"].to_numpy())
    key, right, n, component = (rows[c].to_numpy() for c in ("key", "right", "n_words", "component"))
    order = np.lexsort((rows["j"], rows["i"], key))
    meets = rows["i"].to_numpy()[order], rows["j"].to_numpy()[order], key[order]
    new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in meets], axis=0)])
    out = [none]
    for lo, to in zip(new, np.r_[new[1:], len(order)]):
        own = order[lo:to]
        left, other = own[~right[own]], own[right[own]]
        same = meets[0][lo] == meets[1][lo]  # a block that meets itself comes once
        other = left if same else other
        step = max(1, 100_000 // max(len(other), 1))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            most = np.floor(np.maximum(n[part][:, None], n[other][None]) * (1 - similarity) + 1e-9)
            may = (component[part][:, None] != component[other][None]) & (np.abs(n[part][:, None] - n[other][None]) <= most)
            if same:
                may &= text[part][:, None] < text[other][None]
            i, j = np.nonzero(may)
            limit, i, j = most[i, j], text[part[i]], text[other[j]]
            for k in range(0, len(i), 5_000):
                a, b, m = i[k : k + 5_000], j[k : k + 5_000], limit[k : k + 5_000]
                common = keys[a] == keys[b]
                here = keys[a, common.argmax(axis=1)] == key[own[0]]
                a, b, m = a[here], b[here], m[here]
                near = _lacks(bits, more, a, b) <= m
                a, b, m = a[near], b[near], m[near]
                near = _lacks(bits, more, b, a) <= m
                x, y = uid[a[near]], uid[b[near]]
                out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "most": m[near].astype(np.int64)}))
    return pd.concat(out)


def _bucket_counts(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, n): the elements of all texts of a task, counted by bucket; kind is the number of words of an element."""
    sums = np.zeros((len(kinds), 1 << BITS), np.int64)
    for batch in batches:
        for lo, to in text_slices(batch.column(1), 2_000_000):
            words, n_words = word_hashes(batch.column(1).slice(lo, to - lo))
            for k, kind in enumerate(kinds):
                elements, _ = labelled_shingles(words, n_words, kind)
                sums[k] += np.bincount((elements >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    kind, bucket = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(kinds, np.int32)[kind]), pa.array(bucket.astype(np.int32)), pa.array(sums[kind, bucket])], names=["kind", "bucket", "n"])


def rare_elements(texts: pa.Array, counts: np.ndarray, kind: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, count of its bucket) of the rarest elements of each text: runs of ``kind`` words, labelled by occurrence.

    An edit takes at most ``kind`` elements from a text, and the more words the other text has, the more of the edits only add some. So two texts within
    ``share`` of their longer length lack at most kind * share * words of a text's elements in the other. Hence in one order of all elements, the first
    so many and SHARED more of both texts have SHARED in common; fewer only where a text has fewer to spare.
    """
    words, n_words = word_hashes(texts)
    elements, n = labelled_shingles(words, n_words, kind)
    doc = np.repeat(np.arange(len(n)), n)
    count = counts[(elements >> np.uint64(64 - BITS)).astype(np.int64)]
    order = np.lexsort((elements, count, doc))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = place < (np.floor(kind * share * n_words + 1e-9) + SHARED)[doc]
    return elements[order[first]], doc[first], count[order[first]]


def _costs(batches: Iterator[pa.RecordBatch], counts: dict, share: float) -> Iterator[pa.RecordBatch]:
    """(kind, cost, texts): how many other texts the rare elements of a task's texts occur in, about; what the usual bucket holds is put down to the many
    elements that share it by chance."""
    cost, texts = dict.fromkeys(counts, 0.0), 0
    usual = {k: float(np.median(n) + 3 * np.sqrt(np.median(n))) for k, n in counts.items()}
    for batch in batches:
        texts += batch.num_rows
        for lo, to in text_slices(batch.column(1), 2_000_000):
            for kind in cost:
                found = rare_elements(batch.column(1).slice(lo, to - lo), counts[kind], kind, share)[2]
                cost[kind] += float(np.maximum(found - 1 - usual[kind], 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(cost), pa.int32()), pa.array(list(cost.values()), pa.float64()), pa.array([texts] * len(cost))], names=["kind", "cost", "texts"])


def _rare(batches: Iterator[pa.RecordBatch], counts: np.ndarray, kind: int, share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, to in text_slices(batch.column(1), 2_000_000):
            part = batch.slice(lo, to - lo)
            elements, doc, _ = rare_elements(part.column(1), counts, kind, share)
            rest = part.drop_columns(["text"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(elements.view(np.int64)), *rest.columns], names=["element", *rest.schema.names])


def edit_distance_within(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Banded alignment with bit-parallel columns: the differences between the cells of a column that lie within ``most`` of the diagonal are
    the bits of two integers, and each column follows from the one before by a few operations on those integers.
    """
    head, short = 0, min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail, short = 0, short - head
    while tail < short and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    if not m or not n:
        return m + n
    band = min(most, m - 1)  # of rows below the diagonal; if it reaches the last row, all rows are in the window
    wide = m + n if band < most else 2 * band + 2
    if band < most:
        band = m
    full, top = (1 << wide) - 1, 1 << (wide - 1)
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << (i + wide - band - 1)
    up, down = full & ~((1 << (wide - band - 1)) - 1), 0
    score, row = band, top >> 1  # of row ``band`` before the first column
    for j, w in enumerate(b):
        match = (masks.get(w, 0) >> j) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | (full & ~(diagonal | up))
        right_down = diagonal & up
        if j < m - band:
            score += not diagonal & top
            if score > most + n - m + band:
                return None
        else:
            score += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        up, down = right_down | (full & ~((diagonal >> 1) | right_up)), (diagonal >> 1) & right_up
    return score if score <= most else None


def distance_within(a: list, b: list, most: int) -> int | None:
    """As edit_distance_within, after a look at the words alone: each word that the other side lacks costs an edit."""
    counts = Counter(a)
    counts.subtract(Counter(b))
    if sum(x for x in counts.values() if x > 0) > most or -sum(x for x in counts.values() if x < 0) > most:
        return None
    return edit_distance_within(a, b, most)


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether the edit similarity of two word lists reaches ``similarity``; two empty ones are alike."""
    return distance_within(a, b, int(max(len(a), len(b)) * (1 - similarity) + 1e-9)) is not None


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, d) of the pairs (a, b, most, text_a, text_b) whose distance is at most ``most``."""
    for batch in batches:
        for lo, to in text_slices(batch.column(4), 2_000_000):
            part = batch.slice(lo, to - lo)
            sides = []
            for c in (3, 4):
                coded = part.column(c).dictionary_encode()
                words, n = word_hashes(coded.dictionary.cast(pa.string()))
                ends = np.cumsum(n)
                sides.append((coded.indices.to_pylist(), [words[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist())]))
            (ia, wa), (ib, wb) = sides
            found = pa.array([distance_within(wa[x], wb[y], most) for x, y, most in zip(ia, ib, part.column(2).to_pylist())], pa.int64())
            keep = found.is_valid()
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), found.filter(keep)], names=["a", "b", "d"])


def _distances(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(a, b, d) of distinct pairs (a, b, most), a written table, within their distance. Only texts that a pair names are moved."""
    named = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    there = texts.join(named, "uid", "left_semi")  # broadcast only where the files of ``pairs`` are small
    left, right = (there.select(F.col("uid").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    rows = pairs.select("a", "b", F.col("most").cast("long").alias("most")).hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "most", "text_a", "text_b")
    return write_table(rows.mapInArrow(_measured, "a long, b long, d long"), name)


def _edits(x: str, y: str, similarity: float) -> Column:
    """The most edits by which texts of ``x`` and ``y`` words may differ."""
    return F.floor(F.greatest(x, y) * (1 - similarity) + 1e-9)


def _moves(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, to) of the components that ``links`` (a, b) join with a lesser one."""
    of = labels.select(F.col("uid").alias("a"), F.col("component").alias("u"))
    ends = links.hint("merge").join(of, "a").hint("merge").join(of.select(F.col("a").alias("b"), F.col("u").alias("v")), "b")
    joined = connected_components(ends.select("u", "v").where("u <> v").distinct())
    return write_table(joined.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("to")), "moves")


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with the components that they have after ``moves``."""
    return rows.hint("merge").join(moves, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")


def _pick(turn: int) -> Column:
    return F.struct(F.xxhash64("uid", F.lit(turn)).alias("by"), F.col("uid").alias("p"), F.col("n_words").alias("n_p"))


def _pivots(parts: DataFrame, turn: int) -> DataFrame:
    """(key, main, p, n_p): per key of several components, a text of its largest one and one of its smallest."""
    by = F.struct("n", F.xxhash64("component", F.lit(turn)).alias("by"), "component", f"pick_{turn}")
    ends = parts.groupBy("key").agg(F.max(by).alias("large"), F.min(by).alias("small"), F.count("*").alias("of")).where("of > 1")
    return ends.select("key", F.explode(F.array("large", "small")).alias("end")).select("key", F.col("end.component").alias("main"), F.col(f"end.pick_{turn}.p").alias("p"), F.col(f"end.pick_{turn}.n_p").alias("n_p"))


def _element_counts(asked: DataFrame, kinds: tuple) -> dict[int, np.ndarray]:
    """How often the elements of each kind occur in the texts of ``asked``, by bucket: a fixed number of counts."""
    sums = asked.select("uid", "text").mapInArrow(partial(_bucket_counts, kinds=kinds), "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(1 << BITS, np.float32) for k in kinds}
    kind, bucket, n = (sums.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    for k in kinds:
        counts[k][bucket[kind == k]] = n[kind == k]
    return counts


def _rarest_kind(asked: DataFrame, counts: dict[int, np.ndarray], share: float) -> tuple[int, float]:
    """(kind, how many others a text meets by its rare elements of that kind, on average) of the kind whose elements meet least."""
    cost = asked.select("uid", "text").mapInArrow(partial(_costs, counts=counts, share=share), "kind int, cost double, texts long").groupBy("kind").agg((F.sum("cost") / F.greatest(F.sum("texts"), F.lit(1))).alias("cost")).collect()
    best = min(cost, key=lambda r: (r["cost"], r["kind"]), default=None)
    return (best["kind"], best["cost"]) if best else (1, 0.0)


def _pairs_by_elements(asked: DataFrame, counts: np.ndarray, kind: int, similarity: float) -> DataFrame:
    """(a, b, most) of the texts in ``asked`` (uid, text, n_words, component, outer) that may be alike, are in different components and not both
    without ``outer``, by an equi-join on their rare elements, of which texts that are alike share some."""
    share = 1 - similarity
    schema = "element long, uid long, n_words int, component long, outer boolean"
    rows = write_table(asked.select("uid", "text", "n_words", "component", "outer").mapInArrow(partial(_rare, counts=counts, kind=kind, share=share), schema), "rare")
    a, b = rows.where("outer").alias("a"), rows.alias("b")
    alike = F.least("a.n_words", "b.n_words") >= F.greatest("a.n_words", "b.n_words") * (similarity - 1e-9)
    once = ~F.col("b.outer") | (F.col("a.uid") < F.col("b.uid"))
    met = a.hint("merge").join(b, F.col("a.element") == F.col("b.element")).where((F.col("a.component") != F.col("b.component")) & once & alike)
    pairs = met.select(F.least("a.uid", "b.uid").alias("a"), F.greatest("a.uid", "b.uid").alias("b"), F.least("a.n_words", "b.n_words").alias("n"), F.greatest("a.n_words", "b.n_words").alias("m"))
    spare = lambda n: F.greatest(F.col(n) - kind + 1, F.lit(1)) - F.floor(kind * share * F.col(n) + 1e-9)
    found = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.greatest(F.least(F.lit(SHARED), spare("n"), spare("m")), F.lit(1)))
    return found.select("a", "b", _edits("n", "m", similarity).cast("long").alias("most"))


def _pairs_by_blocks(outer: DataFrame, core: DataFrame, bagged: DataFrame, similarity: float) -> DataFrame:
    """(a, b, most) of the texts of one key that are in different components and may be alike, without regard to what they share: those of ``outer`` (key, uid, n_words, component)
    with each other and with those of ``core``, the largest component of each key.

    The texts of a key are dealt to blocks of about ``BLOCK`` by length class. Pairs of blocks meet in tasks, but not two blocks of ``core``, nor
    blocks of lengths too far apart. A task holds some pairs of blocks at a time, each text's bag once, and gives out only the pairs of
    texts whose bags of words allow the similarity.
    """
    both = outer.withColumn("core", F.lit(False)).unionByName(core.withColumn("core", F.lit(True)))
    named = both.withColumn("rung", F.floor(F.log(F.col("n_words").cast("double")) / F.log(F.lit(1.0001 / similarity))).cast("int"))
    held = write_table(named.groupBy("key", "core", "rung").agg(F.pow(2, F.ceil(F.log2(F.count("*") / BLOCK))).cast("int").alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1))), "held")
    block = lambda no: F.concat_ws(":", F.col("core").cast("string"), F.col("rung").cast("string"), F.col("blocks").cast("string"), no.cast("string"))
    dealt = write_table(named.hint("merge").join(held, ["key", "core", "rung"]).withColumn("block", block(F.pmod(F.xxhash64("uid"), "blocks"))).drop("core", "rung", "blocks"), "dealt")
    blocks = write_table(held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no")).select("key", "core", "rung", block(F.col("no")).alias("block")), "blocks")
    i, j = blocks.where("not core").select("key", F.col("rung").alias("rung_i"), F.col("block").alias("i")), blocks.select("key", "core", "rung", F.col("block").alias("j"))
    meets = write_table(i.hint("merge").join(j, "key").where((F.abs(F.col("rung_i") - F.col("rung")) <= 1) & (F.col("core") | (F.col("i") <= F.col("j")))).select("key", "i", "j"), "meets")
    # the same pair of blocks of many keys has much the same texts, so these come together, in parts of bounded size
    alike_blocks = meets.groupBy("i", "j").agg(F.ceil(F.count("*") / 20).cast("int").alias("parts"))
    meets = write_table(meets.hint("merge").join(alike_blocks, ["i", "j"]).select("key", "i", "j", F.xxhash64("i", "j", F.pmod(F.xxhash64("key"), "parts")).alias("group")), "groups")
    at = lambda side: dealt.hint("merge").join(meets.withColumn("block", F.col(side)), ["key", "block"]).drop("block")
    rows = write_table(at("i").withColumn("right", F.lit(False)).unionByName(at("j").where("i <> j").withColumn("right", F.lit(True))), "meeting")
    texts = write_table(rows.select("group", "uid").distinct().hint("merge").join(bagged, "uid"), "bags_met")
    return rows.groupBy("group").cogroup(texts.groupBy("group")).applyInPandas(partial(_blocks_met, similarity=similarity), "a long, b long, most long")


def near_duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5, sketches: int = 72, keep: int = 2, rounds: int = 4, seed: int = 11) -> DataFrame:
    """(doc_id, text_md5, class_id, n_class, kept) for every row of ``docs``; other columns are not read.

    Equal texts form one class by their hash before anything else, so thousands of copies cost one row each. Then come up to ``rounds`` rounds
    of linear work: under each key, one text of its largest component and one of its smallest are compared with the texts of other
    components; links join components, and keys whose texts are all in one component are done. Of the texts of the keys that are left, those in
    different components that share enough of their rarest words, as texts within the similarity must, are compared by alignment. Where even rare
    words are shared by many, as in a large group of copies near the threshold, the texts of a key meet in blocks instead, by length and bag of
    words, which leave out only pairs that cannot be alike. So the classes are those of all candidate pairs, without listing the pairs inside a
    large group or of texts that have a passage in common.

    class_id is the least doc_id of the class (null only if all are null); one row of each class is kept: the first by doc_id, nulls last.
    Null texts count as empty; empty texts, and texts of white space alone, are equal only to themselves. Texts with fewer words than
    a shingle are one shingle, so only those with the same words link. Rows with the same doc_id are separate rows. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    made = rows.select("id", "text", "h").mapInArrow(partial(_signatures, size=size, sketches=sketches, keep=keep, seed=seed), "id long, h string, n_words int, keys array<long>")
    everything = write_table(made.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid")).alias("m")
    copies = write_table(everything.groupBy("h").agg(first).select("h", F.col("m.uid").alias("rep")), "texts")
    reps = everything.hint("merge").join(copies.select(F.col("rep").alias("uid")), "uid", "left_semi").where("n_words > 0")
    keyed = reps.select("uid", "n_words", F.explode("keys").alias("key"))
    twice = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(_pick(0)).alias("pick")).where("n > 1")
    shared = write_table(keyed.hint("merge").join(twice.select("key", "n", F.col("pick.p").alias("p"), F.col("pick.n_p").alias("n_p")), "key"), "shared")
    labels = write_table(shared.select("uid").distinct().select("uid", F.col("uid").alias("component")), "labels")
    wanted = everything.select("uid", "h").hint("merge").join(labels.select("uid"), "uid", "left_semi")
    texts = write_table(rows.select("h", "text").hint("merge").join(wanted, "h").dropDuplicates(["uid"]).select("uid", "text"), "wanted")

    close = F.least("n_p", "n_words") >= F.greatest("n_p", "n_words") * (similarity - 1e-9)
    # at first a text meets the pivots of its three most frequent keys alone: a large group is joined by three pairs a text, and only what is
    # then in different components goes through all its keys
    most = F.slice(F.sort_array(F.collect_set(F.struct("n", "p", "n_p")), asc=False), 1, 3)
    first_met = shared.where((F.col("uid") != F.col("p")) & close).groupBy("uid", "n_words").agg(most.alias("most")).select("uid", "n_words", F.explode("most").alias("m")).select("uid", "n_words", "m.p", "m.n_p")
    shared = shared.select("key", "uid", "n_words")
    outer, parts, tried, pivots = shared.withColumn("component", F.col("uid")), None, None, None
    for turn in range(rounds):
        met = outer.hint("merge").join(pivots, "key").where((F.col("component") != F.col("main")) & close) if turn else first_met
        pairs = met.select(F.least("p", "uid").alias("a"), F.greatest("p", "uid").alias("b"), _edits("n_p", "n_words", similarity).alias("most")).distinct()
        pairs = write_table(pairs.hint("merge").join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        moves = _moves(_distances(pairs, texts, "links"), labels)
        labels = write_table(_moved(labels, moves), "labels")
        if parts is None:
            named = shared.hint("merge").join(labels, "uid")
            parts = named.groupBy("key", "component").agg(F.count("*").alias("n"), *[F.min(_pick(k)).alias(f"pick_{k}") for k in range(1, rounds + 1)])
        else:
            parts = _moved(parts, moves).groupBy("key", "component").agg(F.sum("n").alias("n"), *[F.min(f"pick_{k}").alias(f"pick_{k}") for k in range(turn + 1, rounds + 1)])
        parts = write_table(parts, "parts")
        # only keys whose texts are in several components go on, and of their texts only those outside the largest one
        main = parts.groupBy("key").agg(F.max(F.struct("n", F.xxhash64("component", F.lit(turn + 1)), "component")).alias("m"), F.count("*").alias("of")).where("of > 1")
        main = write_table(main.select("key", F.col("m.component").alias("main")), "main")
        outer = write_table(_moved(outer, moves).hint("merge").join(main, "key").where("component <> main").drop("main"), "outer")
        if turn + 1 == rounds or moves.isEmpty():
            break
        pivots = _pivots(parts, turn + 1)
    core = shared.hint("merge").join(main, "key").hint("merge").join(labels, "uid").where("component = main")
    sides = outer.select("uid", F.lit(True).alias("outer")).union(core.select("uid", F.lit(False))).groupBy("uid").agg(F.max("outer").alias("outer"))
    sides = write_table(sides.hint("merge").join(labels, "uid").hint("merge").join(everything.select("uid", "n_words"), "uid"), "sides")
    asked = write_table(texts.join(sides, "uid").select("uid", "text", "n_words", "component", "outer"), "asked")  # broadcast only where the files of ``sides`` are small
    counts = _element_counts(asked, (1, 2) if similarity > 0.75 else (1,))  # with more edits, two texts may have no pair of words in common
    kind, met = _rarest_kind(asked, counts, 1 - similarity)
    if met <= MET:
        near = _pairs_by_elements(asked, counts[kind], kind, similarity)
    else:
        bagged = asked.select("uid", "text").mapInArrow(_bags, "uid long, bits binary, more long")
        bagged = write_table(bagged.hint("merge").join(everything.select("uid", "keys"), "uid"), "bags")
        near = _pairs_by_blocks(outer, core.drop("main"), bagged, similarity)
    near = write_table(near, "near")
    pairs = write_table(near.hint("merge").join(tried, ["a", "b"], "left_anti"), "pairs")
    labels = write_table(_moved(labels, _moves(_distances(pairs, texts, "links"), labels)), "labels")

    classes = copies.hint("merge").join(labels.withColumnRenamed("uid", "rep"), "rep", "left").select("h", F.coalesce("component", "rep").alias("class"))
    named = write_table(everything.select("id", "uid", "h").hint("merge").join(classes, "h"), "classes")
    least = named.groupBy("class").agg(first, F.min("id").alias("class_id"), F.count("*").alias("n_class")).select("class", "class_id", "n_class", F.col("m.uid").alias("first"))
    return named.hint("merge").join(least, "class").select(F.col("id").alias("doc_id"), F.col("h").alias("text_md5"), "class_id", "n_class", (F.col("uid") == F.col("first")).alias("kept"))


def op5_edit_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
