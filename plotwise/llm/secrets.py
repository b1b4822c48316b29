"""Operator 6: secrets in text by fixed patterns and a linear-chain conditional random field.

Tokens (runs without white space) are tagged secret-begin, inside or outside. Scores of a tag come from the shape of the token, of the words
beside it and from features of the whole text; the tag sequence is decoded by Viterbi. What the fixed patterns find always stays.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.wordtok import text_slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUE = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[^\s\"'=:,;()\[\]{}<>|]+")
PARTS = re.compile(f"({TOKEN.pattern})")
OUT, BEGIN, INSIDE = range(3)


def has_cue(text: str) -> bool:
    """Whether ``CUE`` is found in a text; a look for the plain words comes first, as it is much faster."""
    low = text.lower()
    return any(w in low for w in CUES) and CUE.search(text) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, code points, by start, then kind. A run of hex digits of 24 or more is what is left
    of all runs once the shorter ones are dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if has_cue(text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...] = (*KINDS, "crf")) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- features
BUCKETS = 1 << 12
SIDES = ("p", "pp", "n")
DIGIT = re.compile(r"\d")
SWITCH = re.compile(r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")


@lru_cache(1 << 12)
def _bucket(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % BUCKETS


def shape_features(token: str) -> list[int]:
    """Buckets of what a token looks like by itself."""
    n = len(token)
    digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    other = n - digits - upper - lower
    switches = len(SWITCH.findall(token))
    made = [f"len{min(n.bit_length(), 7)}", f"long{n >= 16}{n >= 24}", f"mix{digits > 0}{upper > 0}{lower > 0}{other > 0}", f"distinct{min(len(set(token)) * 4 // max(n, 1), 4)}{min(len(set(token)) // 6, 4)}"]
    made += [f"digits{digits * 5 // max(n, 1)}", f"switch{min(switches * 6 // max(n, 1), 5)}", f"hex{n >= 8 and all(c in '0123456789abcdef' for c in token)}", f"cap{token[:1].isupper()}{upper > 1}"]
    return [_bucket("s:" + x) for x in made]


def word_features(token: str, side: str) -> list[int]:
    """Buckets of a neighbouring word: what it is, and whether it asks for a value."""
    low = token.lower()
    whole = hashlib.blake2b(low[:24].encode(), digest_size=6).digest()
    at = 2 * SIDES.index(side)
    return [int.from_bytes(whole[at : at + 2], "little") % BUCKETS, _bucket(f"{side}:cue{bool(CUE.search(low))}"), _bucket(f"{side}:num{DIGIT.search(low) is not None}")]


def gap_feature(gap: str) -> int:
    """Bucket of what stands between a token and the one before: an assignment sign, a quote, a break or white space."""
    return _bucket("g:" + ("=" if "=" in gap else ":" if ":" in gap else "") + ("q" if '"' in gap or "'" in gap else "") + ("n" if "\n" in gap else ""))


def file_features(text: str) -> list[int]:
    """Buckets of the text as a whole: size, share of digits and of signs that programs are full of, in its own coarse steps."""
    n = max(len(text), 1)
    signs = sum(map(text.count, "{}=;<>_\"")) * 200 // n
    return [_bucket(f"f:len{min(n.bit_length() // 3, 7)}"), _bucket(f"f:sign{min(signs, 5)}"), _bucket(f"f:cue{has_cue(text)}")]


def word_buckets(token: str) -> list[list[int]]:
    """What a token adds: to its own scores, to those of the next token and the one after it, and to those of the token before."""
    return [shape_features(token), *(word_features(token, side) for side in SIDES)]


IS_DIGIT, IS_UPPER, IS_LOWER, IS_DECIMAL, IS_HEX, IS_KNOWN = (1 << i for i in range(6))
_CLASSES = np.zeros(0x110000, np.uint8)


def sign_classes(codes: np.ndarray) -> np.ndarray:
    """What each code point is, as bits; worked out once for each that is met."""
    for x in np.unique(codes[_CLASSES[codes] == 0]).tolist():
        c = chr(x)
        _CLASSES[x] = IS_KNOWN | c.isdigit() * IS_DIGIT | c.isupper() * IS_UPPER | c.islower() * IS_LOWER | c.isdecimal() * IS_DECIMAL | (c in "0123456789abcdef") * IS_HEX
    return _CLASSES[codes]


@lru_cache(1)
def _shape_tables() -> list[np.ndarray]:
    """Buckets of the shape features by a small number for what each says."""
    named = [[f"len{i}" for i in range(8)], [f"long{a}{b}" for a in (False, True) for b in (False, True)]]
    named += [[f"mix{a}{b}{c}{d}" for a in (False, True) for b in (False, True) for c in (False, True) for d in (False, True)], [f"distinct{a}{b}" for a in range(5) for b in range(5)]]
    named += [[f"digits{i}" for i in range(6)], [f"switch{i}" for i in range(6)], [f"hex{a}" for a in (False, True)], [f"cap{a}{b}" for a in (False, True) for b in (False, True)]]
    return [np.array([_bucket("s:" + x) for x in names]) for names in named]


def many_word_buckets(words: list[str]) -> list[np.ndarray]:
    """``word_buckets`` of words that are not empty, all at once: four tables with a row for each word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.cumsum(n) - n
    classes = sign_classes(codes)
    digits, upper, lower, decimals, hexed = (np.add.reduceat((classes & bit != 0).astype(np.int64), starts) for bit in (IS_DIGIT, IS_UPPER, IS_LOWER, IS_DECIMAL, IS_HEX))
    decimal = classes & IS_DECIMAL
    switched = np.r_[False, decimal[1:] != decimal[:-1]].astype(np.int64)
    switched[starts] = 0
    own = np.sort(np.repeat(np.arange(len(words)), n) << 21 | codes)
    distinct = np.bincount(own[np.r_[True, own[1:] != own[:-1]]] >> 21, minlength=len(words))
    flags = lambda *bits: sum(b.astype(np.int64) << i for i, b in enumerate(reversed(bits)))
    said = [np.searchsorted([1, 2, 4, 8, 16, 32, 64], n, "right"), flags(n >= 16, n >= 24), flags(digits > 0, upper > 0, lower > 0, n - digits - upper - lower > 0)]
    said += [np.minimum(distinct * 4 // n, 4) * 5 + np.minimum(distinct // 6, 4), digits * 5 // n, np.minimum(np.add.reduceat(switched, starts) * 6 // n, 5)]
    said += [flags((n >= 8) & (hexed == n)), flags(classes[starts] & IS_UPPER != 0, upper > 1)]
    low = [w.lower() for w in words]
    whole = np.frombuffer(b"".join([hashlib.blake2b(w[:24].encode(), digest_size=6).digest() for w in low]), "<u2").reshape(-1, 3) % BUCKETS
    text = "\n".join(low)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    cue = np.zeros(len(words), np.int64)
    for w in CUES:
        at = text.find(w)
        while at >= 0:
            cue[np.searchsorted(ends, at, "right")] = 1
            at = text.find(w, at + 1)
    flag = lambda side, name: np.array([_bucket(f"{side}:{name}{x}") for x in (False, True)])
    sides = [np.stack([whole[:, i].astype(np.int64), flag(side, "cue")[cue], flag(side, "num")[(decimals > 0).astype(np.int64)]], axis=1) for i, side in enumerate(SIDES)]
    return [np.stack([table[x] for table, x in zip(_shape_tables(), said)], axis=1), *sides]


#: Tokens on each side of a match that are trained on, tokens at another place of each text, and tokens of a text at most.
AROUND, ELSEWHERE, MOST = 5, 20, 200


def training_runs(text: str, base: list[tuple[int, int, int]]) -> list[list[dict]]:
    """Runs of neighbouring tokens with their features to train on: those near the fixed patterns' matches, and as a rule others."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    starts, ends = np.array(spans).T
    at = zlib.crc32(text.encode()) % len(spans)
    kept = set(range(at, min(at + ELSEWHERE, len(spans))))
    for x, _, y in base:
        kept.update(range(max(0, int(np.searchsorted(ends, x, "right")) - AROUND), min(len(spans), int(np.searchsorted(starts, y)) + AROUND)))
        if len(kept) >= MOST:
            break
    words = ["", "", *(text[a:b] for a, b in spans), ""]
    whole, runs, last = file_features(text), [], -2
    for i in sorted(kept):
        a, b = spans[i]
        gap = text[spans[i - 1][1] if i else 0 : a]
        token = {"span": (a, b), "features": [*shape_features(words[i + 2]), *word_features(words[i + 1], "p"), *word_features(words[i], "pp"), *word_features(words[i + 3], "n"), gap_feature(gap), *whole]}
        if i == last + 1:
            runs[-1].append(token)
        else:
            runs.append([token])
        last = i
    return runs


# ---------------------------------------------------------------- the field
class ChainField:
    """Weights by feature bucket and tag, and by pair of tags (the row before the first tag is the outside)."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((BUCKETS, 3)) if emission is None else emission
        self.transition = np.zeros((3, 3)) if transition is None else transition

    def scores(self, run: list[dict]) -> np.ndarray:
        return np.array([self.emission[t["features"]].sum(axis=0) for t in run])

    def viterbi(self, run: list[dict]) -> list[int]:
        return self.best_tags(self.scores(run))

    def surely_out(self, e: np.ndarray) -> np.ndarray:
        """Which of the tokens with scores ``e`` are outside on the best path, whatever the tags beside them.

        That is so where the outside's score leads by more than any transitions from and to it can cost. If the next token were inside, it has to
        begin instead, which may cost its own scores too.
        """
        t = self.transition
        sure = np.ones(len(e), bool)
        later = np.r_[e[1:, INSIDE] - e[1:, BEGIN], -math.inf]
        for x, before in ((BEGIN, (OUT, BEGIN, INSIDE)), (INSIDE, (BEGIN, INSIDE))):
            into = max(t[s, x] - t[s, OUT] for s in before)
            alone = into + max(0.0, *(t[x, u] - t[OUT, u] for u in (OUT, BEGIN)))
            ahead = into + t[x, INSIDE] - t[OUT, BEGIN] + max(0.0, *(t[INSIDE, v] - t[BEGIN, v] for v in range(3)))
            sure &= e[:, OUT] - e[:, x] > np.maximum(alone, ahead + later) + 1e-9
        return sure

    def best_tags(self, e: np.ndarray) -> list[int]:
        """The best tags of tokens with scores ``e``, of equal ones the least. Only the runs between tokens that are surely outside are gone through."""
        unsure = np.flatnonzero(~self.surely_out(e))
        tags = [OUT] * len(e)
        if len(unsure):
            cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
            for lo, to in zip(unsure[np.r_[0, cuts]].tolist(), (unsure[np.r_[cuts - 1, len(unsure) - 1]] + 1).tolist()):
                tags[lo:to] = self._run_tags(e[lo:to], to == len(e))
        return tags

    def _run_tags(self, e: np.ndarray, last: bool) -> list[int]:
        """The best tags of a run after an outside, or at the beginning, and before an outside unless it is the ``last``. Plain numbers, as each step has
        only three."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.transition.tolist()
        rows = iter(e.tolist())
        x, y, _ = next(rows)
        o, b, i = oo + x, ob + y, -math.inf  # a secret begins with a begin
        back = []
        for x, y, z in rows:
            to_o, from_o = o + oo, OUT
            if b + bo > to_o:
                to_o, from_o = b + bo, BEGIN
            if i + io > to_o:
                to_o, from_o = i + io, INSIDE
            to_b, from_b = o + ob, OUT
            if b + bb > to_b:
                to_b, from_b = b + bb, BEGIN
            if i + ib > to_b:
                to_b, from_b = i + ib, INSIDE
            to_i, from_i = b + bi, BEGIN
            if i + ii > to_i:
                to_i, from_i = i + ii, INSIDE
            back.append((from_o, from_b, from_i))
            o, b, i = to_o + x, to_b + y, to_i + z
        ends = (o, b, i) if last else (o + oo, b + bo, i + io)
        tags = [ends.index(max(ends))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def gradient(self, run: list[dict], tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(emission residuals of each token, transition residuals): truth minus expectation, by forward and backward sums."""
        e, n = self.scores(run), len(run)
        allowed = self.transition.copy()
        allowed[OUT, INSIDE] = -30.0
        forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
        forward[0] = allowed[OUT] + e[0]
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + allowed, axis=0) + e[i]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(allowed + e[i + 1] + backward[i + 1], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        residual = -np.exp(forward + backward - total)
        residual[np.arange(n), tags] += 1
        pairs = np.zeros((3, 3))
        pairs[OUT] += residual[0]
        for i in range(1, n):
            pairs -= np.exp(forward[i - 1][:, None] + allowed + e[i] + backward[i] - total)
            pairs[tags[i - 1], tags[i]] += 1
        return residual, pairs

    def fit(self, runs: list[list[dict]], tags: list[list[int]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, dropout: float = 0.5, seed: int = 0) -> ChainField:
        """Adaptive stochastic gradient ascent of the conditional likelihood with an L2 penalty.

        Each visit hides a share of every token's features, so that no single cue (the word before, the alphabet of the value) carries all
        the weight and values beyond the fixed patterns are found by the rest.
        """
        squares, pair_squares = np.full_like(self.emission, 1e-2), np.full((3, 3), 1e-2)
        order = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in order.permutation(len(runs)):
                seen = [t | {"features": [f for f, x in zip(t["features"], order.random(len(t["features"]))) if x >= dropout]} for t in runs[i]]
                residual, pairs = self.gradient(seen, tags[i])
                for t, r in zip(seen, residual):
                    f = t["features"]
                    g = r - decay * self.emission[f]
                    squares[f] += g * g
                    self.emission[f] += rate * g / np.sqrt(squares[f])
                pairs -= decay * self.transition
                pair_squares += pairs * pairs
                self.transition += rate * pairs / np.sqrt(pair_squares)
        return self


def silver_tags(run: list[dict], base: list[tuple[int, int, int]]) -> list[int]:
    """Tags of a run by the fixed patterns: the first token that touches a match begins it, the next ones that do are inside."""
    tags, before = [], -1
    for t in run:
        a, b = t["span"]
        hit = next((i for i, (x, _, y) in enumerate(base) if x < b and a < y), -1)
        tags.append(OUT if hit < 0 else INSIDE if hit == before else BEGIN)
        before = hit
    return tags


def secret_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fixed patterns' matches without the names of what is assigned."""
    return [(ASSIGN.match(text, a).start(2) if k == 0 else a, k, b) for a, k, b in base]


def fit_field(docs: DataFrame, sample_rows: int = 400, seed: int = 5, text_col: str = "text") -> ChainField:
    """A field fitted on the tags that the fixed patterns give to about ``sample_rows`` distinct texts at most with and as many without a cue word.

    The bound is on training rows alone; which rows those are depends on a hash of the text, not on the order of the input.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    cue = reduce(lambda x, y: x | y, [F.contains(F.lower("text"), F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key", "akia")])
    kept = rows.withColumn("cue", cue)
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    sizes = {r.cue: r.n for r in kept.groupBy("cue").agg(F.approx_count_distinct("text").alias("n")).collect()}
    limit = {flag: int(min(1.0, sample_rows / max(1, sizes.get(flag, 0))) * (1 << 30)) for flag in (True, False)}
    some = kept.where(place < F.when(F.col("cue"), limit[True]).otherwise(limit[False])).select("text").distinct().orderBy("text").collect()
    runs, tags = [], []
    for r in some:
        base = base_spans(r.text)
        parts = secret_parts(r.text, base)
        for run in training_runs(r.text, base):
            runs.append(run)
            tags.append(silver_tags(run, parts))
    return ChainField().fit(runs, tags, seed=seed)


class _Places(dict):
    """Numbers strings in the order in which they come; ``new`` holds those that nothing was worked out for yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _with_room(rows: np.ndarray, n: int) -> np.ndarray:
    return rows if n <= len(rows) else np.concatenate([rows, np.zeros((max(n - len(rows), len(rows)), *rows.shape[1:]))])


class TokenScores:
    """Scores that tokens and the gaps between them add, worked out once for each that is met, many at a time; begun anew when there are many."""

    def __init__(self, field: ChainField, most: int = 1 << 18):
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        self.places, self.gaps = _Places(), _Places()
        self.parts, self.between = [np.zeros((1024, 3)) for _ in range(4)], np.zeros((16, 3))
        # place 0 is the empty word, which stands for none
        self.places[""] = 0
        for part, buckets in zip(self.parts, word_buckets("")):
            part[0] = self.field.emission[buckets].sum(axis=0)

    def meet(self, words: Iterable[str], n: int) -> np.ndarray:
        """Places of ``n`` words."""
        return np.fromiter(map(self.places.__getitem__, words), np.int64, n)

    def learn(self) -> None:
        """Work out what the words and gaps that were met add."""
        if self.places.new:
            at, self.parts = len(self.places) - len(self.places.new), [_with_room(part, len(self.places)) for part in self.parts]
            for part, buckets in zip(self.parts, many_word_buckets(self.places.new)):
                part[at : len(self.places)] = sum(self.field.emission[buckets[:, i]] for i in range(buckets.shape[1]))
            self.places.new = []
        if self.gaps.new:
            at, self.between = len(self.gaps) - len(self.gaps.new), _with_room(self.between, len(self.gaps))
            self.between[at : len(self.gaps)] = self.field.emission[list(map(gap_feature, self.gaps.new))]
            self.gaps.new = []

    def met(self, pieces: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of words, places of the gaps before them) of texts in pieces, gap and word by turns and a gap at last."""
        if len(self.places) + len(self.gaps) > self.most:
            self.clear()
        found = [(self.meet(p[1::2], len(p) // 2), np.fromiter(map(self.gaps.__getitem__, p[:-1:2]), np.int64, len(p) // 2)) for p in pieces]
        self.learn()
        return found

    def scores(self, text: str, words: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Scores of every token of a text, by tag."""
        i = np.concatenate([[0, 0], words, [0]])
        shape, p, pp, n = self.parts
        return shape.take(i[2:-1], axis=0) + p.take(i[1:-2], axis=0) + pp.take(i[:-3], axis=0) + n.take(i[3:], axis=0) + self.between.take(gaps, axis=0) + self.field.emission[file_features(text)].sum(axis=0)

    def of(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Scores of the tokens at ``spans``, by tag."""
        ends = [0, *(b for _, b in spans)]
        pieces = [x for (a, b), end in zip(spans, ends) for x in (text[end:a], text[a:b])] + [""]
        return self.scores(text, *self.met([pieces])[0])


def crf_spans(text: str, scores: TokenScores, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of decoded secrets that touch no base span. Every token of the text is in the chain."""
    return many_crf_spans([text], scores, [base])[0]


def many_crf_spans(texts: list[str], scores: TokenScores, bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """``crf_spans`` of each text; what new words add is worked out for all texts at once."""
    pieces = [PARTS.split(text) for text in texts]
    return [_decoded(text, p, scores, places, base) for text, p, places, base in zip(texts, pieces, scores.met(pieces), bases)]


def _decoded(text: str, pieces: list[str], scores: TokenScores, places: tuple[np.ndarray, np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if len(pieces) < 2:
        return []
    tags = scores.field.best_tags(scores.scores(text, *places))
    if not any(tags):
        return []
    ends = list(accumulate(map(len, pieces)))  # token k is the piece 2k + 1
    found: list[list[int]] = []
    for k, tag in enumerate(tags):
        if tag == BEGIN:
            found.append([ends[2 * k], ends[2 * k + 1]])
        elif tag == INSIDE:
            found[-1][1] = ends[2 * k + 1]
    # base spans by start; the greatest end so far says whether one of those that begin before the end reaches into a span
    starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    before = [(a, b, bisect_left(starts, b)) for a, b in found]
    return [(a, len(KINDS), b) for a, b, n in before if n == 0 or reach[n - 1] <= a]


def _scan(batches: Iterator[pa.RecordBatch], emission: np.ndarray, transition: np.ndarray) -> Iterator[pa.RecordBatch]:
    scores = TokenScores(ChainField(emission, transition))
    for batch in batches:
        for lo, to in text_slices(batch.column(1)):
            part = batch.slice(lo, to - lo)
            counts, digests, spans = [], [], []
            texts = part.column(1).to_pylist()
            bases = list(map(base_spans, texts))
            for base, more in zip(bases, many_crf_spans(texts, scores, bases)):
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(n[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, in place.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; ``crf`` spans are the field's. Null texts count as empty
    and have none; null and repeated ids are kept; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_scan, emission=field.emission, transition=field.transition), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, fit_field(docs))
