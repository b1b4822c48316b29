"""Operator 9: document scores by prediction by partial matching (PPM) over bytes.

The trie of byte contexts up to ``order`` is counted over the training texts by Spark and then fixed (pretrained). A symbol that its
longest context has not seen costs an escape, estimated by method C (distinct successors over successors plus distinct ones), and is looked
for in the next shorter context, from which all symbols of the longer one are excluded. Texts end with an end symbol (byte 255, which
UTF-8 never uses) and begin in a context of end symbols.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import per_text, text_slices
from plotwise.scratch import write_table

END = 255
END_WORD = ""


def byte_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each symbol with the ``order`` bytes before it, symbols of each text, its end included)."""
    n = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(n + 1 + order) - (n + 1 + order)
    flat = np.full(int((n + 1 + order).sum()), END, np.uint8)
    text = np.zeros(len(flat), bool)
    symbol = np.zeros(len(flat), bool)
    edge = np.zeros(len(flat) + 1, np.int8)
    np.add.at(edge, at + order, 1)
    np.add.at(edge, at + order + n, -1)
    text[:] = np.cumsum(edge[:-1], dtype=np.int8) > 0
    symbol[text] = True
    symbol[at + order + n] = True
    flat[text] = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    keys = np.zeros(max(len(flat) - order, 0), np.int64)
    for j in range(order + 1):
        keys = (keys << 8) | flat[j : j + len(keys)]
    return keys[symbol[order:]], n + 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def gram_chances(grams: DataFrame, order: int) -> DataFrame:
    """(gram, chance, seen): the log10 probability of the last byte of every key of ``grams`` (gram, n, seen) after the ``order`` bytes before it.

    ``n`` is the count in training texts and may be 0, ``seen`` goes through. The trie is a table of (context, symbol) counts for each context
    length, and each key goes down from the longest context to the one that has its symbol, by joins on the context and on the key, for
    as long as it is not found. Tables of contexts of two bytes and fewer, and of keys of two, have 65,536 rows at most and are broadcast.
    """
    mask = lambda k: (1 << 8 * (k + 1)) - 1
    levels = {order: grams.where("n > 0").select(F.col("gram").alias("key"), "n")}
    for k in range(order - 1, -1, -1):
        levels[k] = write_table(levels[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask(k))).alias("key")).agg(F.sum("n").alias("n")), "level")
    sent = lambda table, size: F.broadcast(table) if size <= 2 else table.hint("merge")
    rows = grams.withColumns({"out": F.lit(0.0), "open": F.lit(True), "gone": F.lit(0).cast("long"), "gone_total": F.lit(0).cast("long")})
    done = []
    for k in range(order, -1, -1):
        symbols = levels[k].withColumn("context", F.shiftright("key", 8))
        if k:
            shorter = sent(levels[k - 1].select(F.col("key").alias("tail"), F.col("n").alias("below")), k)
            symbols = symbols.withColumn("tail", F.col("key").bitwiseAND(F.lit(mask(k - 1)))).join(shorter, "tail")
        else:
            symbols = symbols.withColumn("below", F.lit(0).cast("long"))
        contexts = symbols.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("below").alias("shorter"))
        contexts, hits = write_table(contexts, "contexts"), levels[k].select("key", F.col("n").alias("count"))
        own = rows.withColumn("key", F.col("gram").bitwiseAND(F.lit(mask(k)))).withColumn("context", F.shiftright("key", 8))
        own = own.join(sent(contexts, k), "context", "left").join(sent(hits, k + 1), "key", "left")
        left = F.col("distinct") - F.col("gone")
        known = F.coalesce(left > 0, F.lit(False))
        room = F.col("total") - F.col("gone_total") + left
        hit, miss = known & F.col("count").isNotNull(), known & F.col("count").isNull()
        gone = F.when(miss, F.col("distinct")).otherwise(F.col("gone"))
        # what a context has seen is excluded from the shorter one; a context that adds no symbol to the longer one has that total there too
        total = F.when(miss | (~miss & (F.col("gone") > 0) & F.col("distinct").isNotNull()), F.col("shorter")).otherwise(F.col("gone_total"))
        out = F.col("out") + F.when(hit, F.log10(F.col("count") / room)).when(miss, F.log10(left / room)).otherwise(0.0)
        own = write_table(own.select("gram", "seen", "n", out.alias("out"), (~hit).alias("open"), gone.alias("gone"), total.alias("gone_total")), "chances")
        done.append(own.where("not open").select("gram", F.col("out").alias("chance"), "seen"))
        rows = own.where("open")
    done.append(rows.select("gram", (F.col("out") - F.log10(F.greatest(256 - F.col("gone"), F.lit(1)))).alias("chance"), "seen"))
    return reduce(lambda x, y: x.unionByName(y), done)


class GramTable:
    """Values of byte keys in an open-addressed table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(2 * len(keys) + 1).bit_length())
        self.slots, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, np.nan)
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[place] == -1
            took = np.unique(place[free], return_index=True)[1]
            mine = np.flatnonzero(free)[took]
            self.slots[place[mine]], self.value[place[mine]] = keys[left[mine]], values[left[mine]]
            rest = np.ones(len(left), bool)
            rest[mine] = False
            left, place = left[rest], (place[rest] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; not a number where the table lacks a key."""
        place = self._slot(keys)
        found = self.slots[place]
        out = self.value[place]
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            place[left] = (place[left] + 1) & (len(self.slots) - 1)
            found = self.slots[place[left]]
            out[left] = self.value[place[left]]
            left = left[(found != keys[left]) & (found != -1)]
        return out


def _counts(batches: Iterator[pa.RecordBatch], order: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, gram, n, seen): counts of the words of a task's training texts, and of the byte grams of its training texts (n) and of all
    its texts (seen), added up before they leave it."""
    words: dict[str, int] = {}
    keys, counts = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def rows(word: dict, gram: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, n = list(word), np.fromiter(word.values(), np.int64, len(word))
        for lo in range(0, len(names), 100_000):
            part = n[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 100_000], pa.string()), pa.nulls(len(part), pa.int64()), pa.array(part), pa.array(part)], names=["word", "gram", "n", "seen"])
        for lo in range(0, len(gram), 100_000):
            part = gram[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part), *[pa.array(both[lo : lo + 100_000, c].copy()) for c in (0, 1)]], names=["word", "gram", "n", "seen"])

    for batch in batches:
        for lo, to in text_slices(batch.column(0)):
            part = batch.slice(lo, to - lo)
            low = pc.ascii_lower(part.column(0))
            for trains in (True, False):
                texts = low.filter(pc.invert(part.column(1)) if trains else part.column(1))
                own, n = np.unique(byte_grams(texts, order)[0], return_counts=True)
                keys, counts = summed(np.concatenate([keys, own]), np.concatenate([counts, np.stack([n * trains, n], 1)]))
                if trains:
                    coded = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(texts)))
                    for w, k in zip(coded.field("values").to_numpy(zero_copy_only=False), coded.field("counts").to_numpy().tolist()):
                        if w:
                            words[w] = words.get(w, 0) + k
                    words[END_WORD] = words.get(END_WORD, 0) + len(texts)
            if len(words) > most or len(keys) > most * 4:
                yield from rows(words, keys, counts)
                words, keys, counts = {}, keys[:0], counts[:0]
    yield from rows(words, keys, counts)


_tables: dict[str, GramTable] = {}


def _scores(batches: Iterator[pa.RecordBatch], model, frequent, order: int) -> Iterator[pa.RecordBatch]:
    name, *held = model.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = GramTable(*held)
    table, common = _tables[name], frequent.value
    for batch in batches:
        for lo, to in text_slices(batch.column(2), 2_000_000):
            part = batch.slice(lo, to - lo)
            low = pc.ascii_lower(part.column(2))
            keys, n = byte_grams(low, order)
            ends = np.r_[0, np.cumsum(n)]
            chance = table.get(keys)
            other = np.isnan(chance)
            total = np.r_[0.0, np.cumsum(np.where(other, 0.0, chance))]
            grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(other)][ends].astype(np.int32)), pa.array(keys[other]))
            words = pc.ascii_split_whitespace(low)
            coded = pc.dictionary_encode(words.flatten())
            names = coded.dictionary.to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy().astype(np.int64)
            offsets = words.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            empty = np.fromiter((not w for w in names), bool, len(names))
            count = np.fromiter((common.get(w, -1) for w in names), np.int64, len(names))
            count[empty] = -1  # what white space at the ends leaves is no word
            rare = (count < 0) & ~empty
            logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            sums = np.r_[0.0, np.cumsum(logs[codes])]
            known = per_text((count > 0).astype(np.int64)[codes], offsets)
            is_rare = rare[codes]
            cut = np.r_[0, np.cumsum(is_rare)][offsets].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), coded.dictionary.take(pa.array(codes[is_rare])))
            tokens = per_text((~empty).astype(np.int64)[codes], offsets) + 1
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]), pa.array(known), lists, grams, pa.array(total[ends[1:]] - total[ends[:-1]])], names=["doc_id", "held_out", "n_tokens", "base", "known", "rare", "grams", "score"])


def _most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the greatest counts, ``most`` at most, by a histogram of eight steps for each doubling: a few hundred rows, whatever the input."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 8)
    total, least = 0, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r.step
    return table.where(step >= least) if least is not None else table.limit(0)


def score_documents(docs: DataFrame, order: int = 4, frequent_grams: int = 1_000_000, frequent_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    All counts are over all training rows, and the order is the same at every size. The probability of each distinct key of the scored texts is
    worked out once, by joins with the trie's tables (``gram_chances``). Those of at most ``frequent_grams`` of the most frequent keys are
    sent to the workers (16 bytes each), and counts of at most ``frequent_words`` words; all other keys and words of a text are looked up by
    a join, so nothing is left out and these two bounds do not change a score. Null texts count as empty; a null id trains; repeated ids
    are separate rows; without training rows the score is uniform over bytes; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = rows.select("text", "held_out").mapInArrow(partial(_counts, order=order, most=300_000), "word string, gram long, n long, seen long")
    counts = write_table(counted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts")
    words = counts.where("word is not null").select("word", "n")
    train, distinct, end = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END_WORD, F.col("n"))), F.lit(0))).first()
    chances = write_table(gram_chances(counts.where("gram is not null").select("gram", "n", "seen"), order), "chances_of_all")
    table = _most_frequent(chances, "seen", frequent_grams).select("gram", "chance").toArrow()
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, table.column("gram").to_numpy(), table.column("chance").to_numpy()))
    frequent = spark.sparkContext.broadcast({r.word: r.n for r in _most_frequent(words.where("n > 0"), "n", frequent_words).collect()} | {END_WORD: end})
    made = rows.mapInArrow(partial(_scores, model=model, frequent=frequent, order=order), "doc_id long, held_out boolean, n_tokens long, base double, known long, rare array<string>, grams array<long>, score double")
    scored = write_table(made.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("uid", F.explode("rare").alias("word")).hint("merge").join(words, "word", "left")
    rest = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count(F.when(F.col("n") > 0, 1)).alias("seen"))
    other = scored.select("uid", F.explode("grams").alias("gram")).hint("merge").join(chances.select("gram", "chance"), "gram").groupBy("uid").agg(F.sum("chance").alias("further"))
    scale = math.log10(train + 0.5 * (distinct + 1))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + math.log10(end + 0.5) - F.col("n_tokens") * scale
    n_known = F.col("known") + F.coalesce("seen", F.lit(0)) + F.lit(int(end > 0))
    whole = scored.drop("rare", "grams").hint("merge").join(rest, "uid", "left").hint("merge").join(other, "uid", "left")
    return whole.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("further", F.lit(0.0))).alias("score"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
