import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spectrafold.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def samples():
    rng = random.Random(3)
    out = ["", "a" * 700, "ab" * 200, "x" + " " * 300 + "y", "=-" * 150, "<|endoftext|>", "a<|endoftext|><|endoftext|> b"]
    for base in range(0, 0x30000, 48):
        said = [chr(i) for i in range(base, base + 48) if not 0xD800 <= i < 0xE000]
        out += [" ".join(said), "a".join(said), "1".join(said)]
    pool = [" ", "  ", "\n", "\x1c", "\x85", " ", "　", "'s", "'S", "a", "é", "ﬁ", "1", "²", "!", "<|endoftext|>", "the", " The", "\t", "\r\n", "aaaa", "​", "😀", "你好", "\x00"]
    out += ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(1500)]
    out += ["".join(rng.choices("abcdeaeiou etshrn", k=60)) for _ in range(1500)]
    return out


def test_equals_the_library(vocabulary, library):
    texts = samples()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    codec = bpe.Codec(vocabulary)
    assert codec.encode(texts) == want
    assert 0 < codec.merged < len(codec.keys)
    assert [codec.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_long_text_is_cut_where_words_end(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 64)
    rng = random.Random(4)
    pool = ["  ", "\n\n", " ", "'s", "word", "größe", "12", "!!", "<|endoftext|>", "x" * 90]
    texts = ["".join(rng.choices(pool, k=600)) for _ in range(5)]
    assert bpe.Codec(vocabulary).encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_memo(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    texts, codec = samples()[:300], bpe.Codec(vocabulary)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.encode([t])[0] for t in texts] == want


def test_operator(spark, vocabulary, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (4, "long " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.digests(docs, vocabulary).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)
    assert bpe.digests(docs.limit(0), vocabulary).count() == 0
