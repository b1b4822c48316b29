import random

import numpy as np

from plotwise.llm.edit_dups import alike, edit_distance_within, near_duplicate_documents
from plotwise.llm.embedding_dups import estimates, near_duplicate_vectors, rotation


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    random.seed(3)
    for _ in range(3000):
        a = [random.randint(0, random.choice([1, 3, 8])) for _ in range(random.randint(0, 14))]
        b = [x for x in a if random.random() < 0.9] if random.random() < 0.6 else [random.randint(0, 3) for _ in range(random.randint(0, 14))]
        d = levenshtein(a, b)
        for most in range(9):
            assert edit_distance_within(a, b, most) == (d if d <= most else None)


def test_near_duplicate_documents(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    docs = []
    for _ in range(12):
        first = [word() for _ in range(random.randint(30, 200))]
        docs.append(first)
        for _ in range(random.randint(0, 6)):
            copy = list(first)
            for _ in range(len(copy) // 40):
                copy[random.randrange(len(copy))] = word()
            docs.append(copy)
    passage = [word() for _ in range(60)]
    docs += [[word() for _ in range(60)] + passage for _ in range(15)]
    made = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, " ".join(docs[0])), (900, " ".join(docs[0])), (901, ""), (902, None), (903, "  "), (904, "two words"), (905, "two  words"), (None, " ".join(docs[1])), (906, "big " * 30000)]
    got = near_duplicate_documents(spark.createDataFrame([(i, t, "k") for i, t in made], "doc_id long, text string, kept string")).collect()
    assert len(got) == len(made)
    of = {r.doc_id: r.class_id for r in got}
    parent = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if alike(docs[a], docs[b], 0.8):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert [of[i] for i in range(len(docs))] == parent
    assert of[900] == 0 and of[901] == 901 and of[902] == 901 and of[903] == 903 and of[905] == 904
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.kept)
    assert all(sum(v) == 1 for v in classes.values())
    assert near_duplicate_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    dim, n, r = 64, 400, 6
    a, b = rng.standard_normal((2, n, dim))
    b = 0.7 * a + 0.5 * b
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    turned = np.stack([b @ rotation(dim, k, 7) for k in range(r)], 1)
    code = np.packbits(turned >= 0, axis=2, bitorder="little").reshape(n, -1).view("<i8")
    guess, error = estimates(a, code, np.abs(turned).sum(axis=2) / 8, 7)
    truth = (a * b).sum(axis=1)
    assert abs((guess - truth).mean()) < 0.01 and (np.abs(guess - truth) < 6 * error).all()


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [x for b in base for x in [b, *(b + 0.09 * rng.standard_normal((rng.integers(0, 5), 16)))]] + [base[0] * 3] * 20 + list(base[1] + 0.02 * rng.standard_normal((40, 16)))
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(link)):
        p, q = root[a], root[b]
        root = [min(p, q) if r in (p, q) else r for r in root]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, []), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (None, [float(v) for v in -base[5]])]
    made = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(made)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum() - 1, root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd if i)
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def edited(rng, words, rate, mode):
    """``words`` with a share ``rate`` of edits: words replaced, taken out or put in."""
    out = []
    hit = set(rng.choice(len(words), int(rate * len(words)), replace=False))
    for i, w in enumerate(words):
        new = f"n{rng.integers(1 << 40)}"
        kind = mode if mode != "mixed" else rng.choice(["replace", "remove", "insert"])
        out += [w] if i not in hit else {"replace": [new], "remove": [], "insert": [w, new]}[kind]
    return out


def test_candidates_by_edit_rate():
    """Of pairs that the alignment accepts, at least nine in ten have a common key, at every edit rate up to the threshold."""
    import pyarrow as pa

    from plotwise.llm.edit_dups import labelled_shingles, order_min_hash, word_hashes

    rng = np.random.default_rng(9)
    for mode in ("replace", "mixed"):
        for rate in (0.05, 0.1, 0.15, 0.18, 0.2):
            pairs = []
            for _ in range(300):
                a = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
                pairs += [a, edited(rng, a, rate, mode)]
            words, n = word_hashes(pa.array([" ".join(p) for p in pairs]))
            keys = order_min_hash(*labelled_shingles(words, n, 5), 72, 2, 11)
            met = (keys[::2] == keys[1::2]).any(axis=1)
            linked = np.array([alike(a, b, 0.8) for a, b in zip(pairs[::2], pairs[1::2])])
            assert linked.mean() > 0.9
            print(mode, rate, round(met[linked].mean(), 3))
            assert met[linked].mean() >= 0.9


def test_groups_near_the_threshold(spark):
    """A large group of copies whose edits put pairs about the threshold, texts that share one long passage, and texts filled up with one phrase:
    classes are the components of all pairs by brute force."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(1 << 40)}"
    base, passage = [word() for _ in range(100)], [word() for _ in range(50)]
    docs = [edited(rng, base, 0.11, "replace") for _ in range(60)]
    docs += [[word() for _ in range(60)] + passage for _ in range(40)]
    docs += [[word() for _ in range(int(k))] + ["so", "on."] * 60 for k in rng.integers(5, 60, 80)]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if alike(docs[a], docs[b], 0.8):
                x, y = root[a], root[b]
                root = [min(x, y) if p in (x, y) else p for p in root]
    assert 1 < len(set(root[:60])) + len(set(root[100:])) < 120
    rows = spark.createDataFrame([(i, " ".join(d), "x") for i, d in enumerate(docs)], "doc_id long, text string, `a.b` string")
    got = {r.doc_id: r.class_id for r in near_duplicate_documents(rows, rounds=1).collect()}
    assert [got[i] for i in range(len(docs))] == root


def rare_pairs(texts, similarity, kind, counts=None):
    """Pairs that share enough rare elements, by numpy alone."""
    import pyarrow as pa

    from plotwise.llm import edit_dups as e

    share = 1 - similarity
    elements, doc, _ = e.rare_elements(pa.array(texts), np.zeros(1 << e.BITS) if counts is None else counts, kind, share)
    n = np.array([len(t.split()) for t in texts])
    own = [set(elements[doc == i].tolist()) for i in range(len(texts))]
    spare = np.maximum(n - kind + 1, 1) - np.floor(kind * share * n + 1e-9)
    return {(i, j) for i in range(len(n)) for j in range(i) if len(own[i] & own[j]) >= max(1, min(e.SHARED, spare[i], spare[j]))}


def test_texts_that_are_alike_share_rare_elements():
    """The filter loses no pair within the similarity, for any order of the elements."""
    rng = random.Random(5)
    for trial in range(60):
        words = [f"w{rng.randrange(rng.choice([6, 60, 2000]))}" for _ in range(rng.randint(1, 90))]
        texts = [" ".join(words)]
        for _ in range(12):
            made = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                at = rng.randrange(len(made) + 1)
                made[at : at + rng.randint(0, 1)] = [rng.choice([*words, "new"])] * rng.randint(0, 1)
            texts.append(" ".join(made or ["x"]))
        near = {(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i].split(), texts[j].split(), 0.8)}
        counts = np.random.default_rng(trial).integers(0, 50, 1 << 18)
        for kind in (1, 2):
            assert near <= rare_pairs(texts, 0.8, kind, counts), (trial, kind)


def test_a_common_passage_brings_no_texts_together(spark):
    """Texts that have half of their words in common, none alike: pairs that are compared grow with their number, not its square."""
    import plotwise.llm.edit_dups as module

    rng, made = random.Random(9), {}
    passage = " ".join(f"p{i}" for i in range(50))
    for n in (500, 2000):
        rows = spark.createDataFrame([(i, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(n)], "doc_id long, text string")
        seen, kept = [], module._pairs_by_elements

        def counted(*args, seen=seen, kept=kept):
            pairs = kept(*args)
            seen.append(pairs.count())
            return pairs

        module._pairs_by_elements = counted
        try:
            assert near_duplicate_documents(rows).where("kept").count() == n
        finally:
            module._pairs_by_elements = kept
        made[n] = sum(seen)
    assert made[2000] <= 4 * made[500] + 50
