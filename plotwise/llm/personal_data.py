"""Operator 8: personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions alone.

What the fixed patterns find are the seeds. The words around the seeds are lexical patterns. A graph joins each pattern with the token values seen
in it; scores go back and forth between the two sides for a few rounds, and what scores high in one round supports patterns in the next
as a seed does. Tokens that no fixed pattern covers, but whose value and pattern both score high, are added as kind ``found``. Only tokens of
five signs or more with a digit or an @ can be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.scratch import write_table

KINDS = ("email", "ip", "card", "phone")
FOUND = len(KINDS)
#: The fixed patterns, with possessive counts where giving back could never help. An address may begin inside a run of its letters only where
#: the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: five or more signs with a digit or an @, without punctuation at the end.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{4,}[^\s.,;:!?]"
SPAN = "array<struct<kind:int,start:int,end:int>>"


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, fold) -> Column:
    """Each element folded with all before it, for a fold that may be grouped at will. After round k an element has what it and the 2^k - 1 before it
    give, so the work is n log n, and no array grows element by element."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(2, k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, fold(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(rounds, values, step)


def _ends(pieces: Column, found: Column) -> Column:
    """Where each match ends, given the pieces of text between the matches."""
    return bound(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i))), lambda steps: running(steps, lambda x, y: x + y))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of all matches, in code points: the pieces between the matches give the places."""
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(x: Column) -> Column:
        found = x["found"]
        place = lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")))
        return bound(_ends(x["pieces"], found), place)

    return bound(both, placed)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) < 3) | ((F.length(number(p)) == 3) & (number(p) <= "255")))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _of_kind(matches: Column, k: int) -> Column:
    fine = F.filter(matches, lambda m: valid(KINDS[k], m["match"]))
    return F.transform(fine, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans as an array of structs, by kind, then start. Texts without a digit or an @ are not searched."""
    parts = []
    for k, kind in enumerate(KINDS):
        sign = {"email": "@", "phone": "+"}.get(kind)
        spans = _of_kind(match_spans(text, PATTERNS[kind]), k)
        parts.append(F.when(F.contains(text, F.lit(sign)), spans).otherwise(F.array().cast(SPAN)) if sign else spans)
    return F.when(text.rlike("[0-9@]"), F.concat(*parts)).otherwise(F.array().cast(SPAN))


def as_text(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "found")])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}++", "a"), "[0-9]", "0")


#: Signs before and after a token that its contexts are taken from. A token and the white space before it are six signs or more, so as many tokens back
#: and on cover them.
BEFORE, AFTER, TOKENS = 60, 40, 10


def candidates(text: Column) -> Column:
    """array<struct<start,end,value,left,around,shaped>>: identifier-like tokens and their contexts: the two words before; the word before and
    the one after; the word before and the token's shape, in which runs of letters are ``a`` and digits 0.

    The contexts are put together from the ends of the pieces of text between the tokens, so each part of a text is read once."""
    both = F.struct(F.split(text, TOKEN, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("found"))

    def edges(x: Column) -> Column:
        match = lambda i: F.coalesce(F.get(x["found"], i), F.lit(""))
        return F.struct(
            x["found"].alias("found"), _ends(x["pieces"], x["found"]).alias("ends"),
            F.transform(x["pieces"], lambda p, i: F.concat(F.when(i > 0, F.right(match(i - 1), F.lit(BEFORE))).otherwise(""), F.right(p, F.lit(BEFORE)))).alias("tails"),
            F.transform(x["pieces"], lambda p, i: F.concat(F.left(p, F.lit(AFTER)), F.left(match(i), F.lit(AFTER)))).alias("heads"))

    def contexts(x: Column) -> Column:
        def context(m: Column, i: Column) -> Column:
            first = F.greatest(i - TOKENS, F.lit(0))
            before = F.lower(F.right(F.array_join(F.slice(x["tails"], first + 1, i - first + 1), ""), F.lit(BEFORE)))
            after = F.lower(F.left(F.array_join(F.slice(x["heads"], i + 2, F.lit(TOKENS)), ""), F.lit(AFTER)))
            words = F.array_remove(F.split(before, r"\s+"), "")
            left = F.array_join(F.slice(words, -2, 2), " ")
            one, follow = F.element_at(words, -1), F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
            end = F.get(x["ends"], i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lower(m).alias("value"), F.when(F.size(words) >= 2, left).alias("left"), F.when((F.size(words) >= 1) & (follow != ""), F.concat_ws(" _ ", one, follow)).alias("around"), F.when(F.size(words) >= 1, F.concat_ws(" ", one, shape(m))).alias("shaped"))

        return F.transform(x["found"], context)

    kind = "array<struct<start:int,end:int,value:string,left:string,around:string,shaped:string>>"
    return F.when(text.rlike("[0-9@]"), bound(bound(both, edges), contexts)).otherwise(F.array().cast(kind))


def overlapping(tokens: Column, spans: Column) -> Column:
    """For each of ``tokens``, which follow one another without overlap, whether it overlaps one of ``spans``.

    Both are put in one order of starts. A span that begins no later overlaps if the greatest end so far lies beyond the token's start; one that
    begins later, if the least start from there on lies before the token's end.
    """
    marked = lambda xs, token: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(token).alias("token"), s["end"].alias("end")))

    def flags(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["token"], -1).otherwise(e["end"])), lambda x, y: F.greatest(x, y))
        back = running(F.reverse(F.transform(events, lambda e: F.when(e["token"], 2**31 - 1).otherwise(e["start"]))), lambda x, y: F.least(x, y))
        judge = lambda x: F.transform(events, lambda e, i: F.struct(e["token"].alias("token"), ((F.get(x["ends"], i) > e["start"]) | (F.get(x["starts"], F.size(events) - 1 - i) < e["end"])).alias("hit")))
        return F.transform(F.filter(bound(F.struct(ends.alias("ends"), back.alias("starts")), judge), lambda e: e["token"]), lambda e: e["hit"])

    return bound(F.sort_array(F.concat(marked(tokens, True), marked(spans, False))), flags)


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int, smoothing: float, support: int, least_value: float) -> tuple[DataFrame, DataFrame]:
    """(pattern scores, value scores) of a graph of distinct (pattern, value) edges.

    A pattern's score is the sum of its values' scores over their number plus ``smoothing``; with fewer than ``support`` values of
    ``least_value`` or more it is 0. A value's is 1 for seeds, else the chance that not all of its patterns are wrong. All sums have a map-side part, so a pattern with very many
    values is no more than a row a task.
    """
    scores = seeds.select("value", F.lit(1.0).alias("s"))
    patterns = None
    for _ in range(rounds):
        known = edges.hint("merge").join(scores, "value", "left")
        rated = known.groupBy("pattern").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("sum"), F.count("*").alias("n"), F.count_if(F.col("s") >= least_value).alias("support"))
        patterns = write_table(rated.select("pattern", F.when(F.col("support") >= support, F.col("sum") / (F.col("n") + smoothing)).otherwise(0.0).alias("p")).where("p > 0"), "patterns")
        new = edges.hint("merge").join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("s"))
        scores = write_table(new.hint("merge").join(seeds.select("value"), "value", "left_anti").select("value", "s").unionByName(seeds.select("value", F.lit(1.0).alias("s"))), "values")
    return patterns, scores


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, smoothing: float = 2.0, support: int = 3, least_pattern: float = 0.5, least_value: float = 0.5) -> DataFrame:
    """doc_id, text_md5, spans_list (array of kind, start, end), n_email, n_ip, n_card, n_phone, n_found, base_sha256 and spans of every row.

    Null texts count as empty and have no spans; null and repeated ids are kept as separate rows; an empty table gives an empty result; other
    columns are not read. The text is read once; what is kept of it are spans and the contexts of identifier-like tokens.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = rows.select("doc_id", F.md5("text").alias("text_md5"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("tokens")).withColumn("uid", F.monotonically_increasing_id())
    table = write_table(made, "spans")
    token = table.where("size(tokens) > 0").withColumn("seeds", overlapping(F.col("tokens"), F.col("base"))).select("uid", F.explode(F.arrays_zip("tokens", "seeds")).alias("t")).select("uid", "t.tokens.*", F.col("t.seeds").alias("seed"))
    token = write_table(token.select("uid", "start", "end", "value", "seed", F.explode(F.array_compact(F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("a "), "around"), F.concat(F.lit("s "), "shaped")))).alias("pattern")), "tokens")
    edges = write_table(token.select("pattern", "value").distinct(), "graph")
    seeds = write_table(token.where("seed").select("value").distinct(), "seeds")
    patterns, values = score_graph(edges, seeds, rounds, smoothing, support, least_value)
    strong = token.where("not seed").hint("merge").join(patterns.where(F.col("p") >= least_pattern), "pattern").hint("merge").join(values.where(F.col("s") >= least_value), "value")
    new = strong.select("uid", F.struct(F.lit(FOUND).alias("kind"), "start", "end").alias("span")).groupBy("uid").agg(F.collect_set("span").alias("new"))
    out = table.drop("tokens").hint("merge").join(write_table(new, "found"), "uid", "left").withColumn("new", F.coalesce("new", F.array().cast(SPAN)))
    spans = F.sort_array(F.concat("base", "new"))
    count = lambda k: F.size(F.filter("spans_list", lambda s: s["kind"] == k)).cast("long")
    return out.withColumn("spans_list", spans).select("doc_id", "text_md5", "spans_list", *[count(k).alias(f"n_{kind}") for k, kind in enumerate((*KINDS, "found"))], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans_list")).alias("spans"))


#: Code points of a text that are looked through together when a part of it is taken.
CHUNK = 1000


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets.

    The text is cut into chunks once, and what lies between the spans is taken from the chunks that hold it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "found")])
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    given = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), by_start.alias("spans"))

    def replaced(x: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
            held = F.array_join(F.slice(x["chunks"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return F.when(end > start, F.substring(held, start % CHUNK + 1, end - start)).otherwise("")

        def joined(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            heads = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(part(before(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
            rest = F.aggregate(x["chunks"], F.lit(0), lambda n, c: n + F.length(c))
            return F.concat(F.array_join(heads, ""), part(F.coalesce(F.element_at(reach, -1), F.lit(0)), rest))

        return bound(running(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined)

    return F.when(F.size(spans) > 0, bound(given, replaced)).otherwise(text)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans_list", "text_md5")
