"""Token ids of many texts at once: each distinct word of a batch is encoded once, the rest is array gathers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(texts: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that hold about ``limit`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, to
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1 ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class RowTable:
    """Rows of numbers by name, in one flat array. Past ``most`` names, those that were asked for only once go."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.row: dict = {}
        self.start, self.length, self.hits, self.flat, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.int32), 0, 0

    def _keep_frequent(self) -> None:
        names, keep = list(self.row), np.flatnonzero(self.hits[: self.n] > 1)
        if len(keep) > self.most // 2:
            keep = keep[np.argsort(-self.hits[keep], kind="stable")[: self.most // 2]]
        flat, lengths = self.take(keep)
        self._clear()
        self._add([names[i] for i in keep], flat, lengths)

    def _add(self, names: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(names), self.used + len(flat)
        if n > len(self.start):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.start, self.length, self.hits))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.int32)])
        self.flat[self.used : used] = flat
        self.length[self.n : n] = lengths
        self.start[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.row.update(zip(names, range(self.n, n)))
        self.n, self.used = n, used

    def rows(self, names: list, encode) -> np.ndarray:
        """Row of each of the distinct names; ``encode(names) -> (flat, lengths)`` gives those that are not yet there."""
        if self.n > self.most:
            self._keep_frequent()
        found = np.fromiter(map(self.row.get, names, itertools.repeat(-1)), np.int64, len(names))
        if len(absent := np.flatnonzero(found < 0)):
            first = self.n
            self._add(missing := [names[i] for i in absent], *encode(missing))
            found[absent] = np.arange(first, self.n)
        self.hits[found] += 1
        return found

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[rows]
        return self.flat[ranges(self.start[rows], lengths)], lengths


def per_text(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` over the words between the offsets of a list array."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[offsets[1:]] - total[offsets[:-1]]


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts, without special tokens.

    Where the tokenizer treats white space as a border that leaves no id (tried out on a probe), ids of a text are the ids of its words,
    and each distinct word goes to the library once; otherwise whole texts go to it. Where it also cuts between letters and a tail of
    punctuation (tried out too), the letters and the tail go there apart, many in one call.
    """

    PROBE = "It's a Probe,of 12 wÖrds\nand  'quotes' <|endoftext|>x don't"
    TAIL = ".,;:!?*&%$#|()"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        one = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.by_word = one(self.PROBE) == [i for w in self.PROBE.split() for i in one(w)]
        self.by_core = self.by_word and all(one(f"Ünder{t}") == one("Ünder") + one(t) for t in (*self.TAIL, self.TAIL, ".,***", "!!"))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.table, self.cores = RowTable(), RowTable(300_000)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def _cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library, with words of letters alone joined by spaces: each is then one word of the library's own count."""
        alpha = np.fromiter(map(str.isalpha, words), bool, len(words))
        letters = [w for w, x in zip(words, alpha) if x]
        if not letters:
            return self._library(words)
        ids, ends = [], []
        for lines in [letters[i : i + 64] for i in range(0, len(letters), 64)]:
            found = self.library.encode(" ".join(lines), add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            of = np.array(found.word_ids, np.int64)
            if len(of) == 0 or of[-1] != len(lines) - 1:
                return self._library(words)
            ends.append(np.bincount(of, minlength=len(lines)))
        flat, lengths = np.concatenate(ids), np.concatenate(ends)
        if len(letters) == len(words):
            return flat, lengths
        other, of_other = self._library([w for w, x in zip(words, alpha) if not x])
        total = np.zeros(len(words), np.int64)
        total[alpha], total[~alpha] = lengths, of_other
        out = np.empty(int(total.sum()), np.int32)
        from_letters = np.repeat(alpha, total)
        out[from_letters], out[~from_letters] = flat, other
        return out, total

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_core:
            return self._library(words)
        whole = pa.array(words)
        core = pc.utf8_rtrim(whole, characters=self.TAIL)
        tail = pc.subtract(pc.utf8_length(whole), pc.utf8_length(core)).to_numpy()
        cut = (tail > 0) & pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        names = pc.if_else(pa.array(cut), core, whole)
        n = 1 + cut
        at = np.cumsum(n) - n
        coded = pc.dictionary_encode(pa.concat_arrays([names, pa.array([words[i][-tail[i] :] for i in np.flatnonzero(cut)], pa.string())]))
        order = np.empty(len(words) + int(cut.sum()), np.int64)
        order[at], order[at[cut] + 1] = np.arange(len(words)), np.arange(len(words), len(order))
        rows = self.cores.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._cores)
        flat, lengths = self.cores.take(rows[coded.indices.to_numpy()[order]])
        return flat, np.add.reduceat(lengths, at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text); the array has no nulls."""
        if not self.by_word:
            return self._library(texts.to_pylist())
        words = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(words.flatten())
        rows = self.table.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._words)[coded.indices.to_numpy()]
        ids, lengths = self.table.take(rows)
        offsets = words.offsets.to_numpy()
        return ids, per_text(lengths, offsets - offsets[0])


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder for each path in a worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
