import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plotwise.llm.bpe import BatchedBPE, decode_documents, encode_documents
from plotwise.llm.packing import pack_documents
from plotwise.llm.token_files import NO_ID, TokenFiles, read_token_files, write_token_files
from plotwise.llm.wordtok import LibraryEncoder, default_tokenizer

WORD, BYTE = default_tokenizer("word_bpe_49k.json"), default_tokenizer("byte_bpe_50k.json")
ODD = ["", "  ", "a", "a  b", "\n", "a\n", "\na", "x \n y", "tab\there", " lead", "<|endoftext|>", "a <|endoftext|> b", "aaaaaaa", "don't I'll", "é à ü 中文字 😀😀", "1234 12", "a   c\r\nd", "\x1c x", "word.,*** next!!", "ABC aBc"]


def texts():
    random.seed(1)
    parts = ["a", "b", " ", "\n", "é", "1", "'s", ".", "<|endoftext|>", "\t", "the", "ing", "　", "_"]
    return ODD + ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(300)] + ["long word " * 3000]


def rows(spark, extra=()):
    made = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, None), (3, "again"), (3, "again"), *extra]
    return spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id long, text string, start string"), made


def split(ids, n):
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library_encoder_is_the_library(path):
    t = Tokenizer.from_file(path)
    assert split(*LibraryEncoder(path).encode(pa.array(texts()))) == [x.ids for x in t.encode_batch(texts(), add_special_tokens=False)]


def test_batched_bpe_is_the_library():
    t, m = Tokenizer.from_file(BYTE), BatchedBPE(BYTE)
    ids, n = m.encode(pa.array(texts()))
    want = [x.ids for x in t.encode_batch(texts(), add_special_tokens=False)]
    assert split(ids, n) == want
    assert m.decode(ids, n) == [t.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_round_trip(spark):
    df, made = rows(spark)
    back = decode_documents(encode_documents(df, BYTE), BYTE).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in made), key=key)
    assert encode_documents(df.limit(0), BYTE).count() == 0


def test_token_files(spark):
    df, made = rows(spark)
    files = write_token_files(df, WORD, shards=3)
    assert TokenFiles.load(files.folder) == files
    t = Tokenizer.from_file(WORD)
    want = {}
    for i, x in made:
        want.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    got = sorted(read_token_files(spark, files).collect(), key=lambda r: r.start)
    order = [NO_ID if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(made)
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 in [zlib.crc32(np.array(x, "<u4")) for x in want[r.doc_id]]
        at += r.n_tokens
    assert at == sum(len(x) for v in want.values() for x in v)
    assert read_token_files(spark, write_token_files(df.limit(0), WORD, shards=2)).count() == 0


def test_packing(spark):
    df, made = rows(spark)
    got = pack_documents(df.where("doc_id is null or doc_id <> 3"), WORD, window=64, open_windows=4, max_pad=4, fan_in=2).toPandas()
    t = Tokenizer.from_file(WORD)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in made if i != 3}
    for i, own in got.assign(doc_id=got.doc_id.astype("Int64").astype(object).where(got.doc_id.notna(), None)).groupby("doc_id", dropna=False):
        i = None if i is None or i != i else int(i)
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids[i])
        assert all(zlib.crc32(np.array(ids[i][s : s + n], "<u4")) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    sizes = got.groupby("sequence_id").length.sum()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
    assert sizes.max() <= 64 and all(64 - n <= 4 or n & (n - 1) == 0 for n in sizes)
    assert pack_documents(df.limit(0), WORD).count() == 0
