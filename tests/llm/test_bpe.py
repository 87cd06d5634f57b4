"""BPE against the tokenizers library, which the operator must equal."""

import collections
import hashlib
import os
import random
import sys

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import corpus  # noqa: E402

from cadastra.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        return bpe.Bpe(file.read())


def encoded(own, text):
    return own.encode_all([text])[0].as_py()


def decoded(own, ids):
    return own.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_character_is_encoded_as_the_library_does(library, own):
    for i in [*range(0x3200), *range(0xA000, 0xD800, 7), *range(0xE000, 0x11000), *range(0x1C80, 0x1CC0), *range(0x11000, 0x30000, 41)]:
        text = f"a{chr(i)}b'{chr(i)}1"
        assert encoded(own, text) == ids_of(library, text), hex(i)


def test_mixed_texts_and_memory_that_overflows(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "_KNOWN", 50)
    parts = ["a", "B", "'s", "'LL", "é", "é", "Σ", "İ", "\x1c", "\x00", "\t", "\x85", "­", "​", "<|endoftext|>", "<|startoftext|>", "<|EndofText|>", "<|", "1", "½", "😀", "漢", "the", "ing", " ", "  ", "!!", "…", "ﬁ", "Å", "Ɤ"]
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = ids_of(library, text)
        assert encoded(own, text) == want, text
        assert decoded(own, want) == library.decode(want, skip_special_tokens=False)


def test_a_very_long_word_and_stale_entries(library, own):
    rng = random.Random(5)
    for letters in ("ab", "aaab", "abcdefgh", "the"):
        word = "".join(rng.choice(letters) for _ in range(60_000))
        assert encoded(own, word) == ids_of(library, word)


def test_plain_text_comes_back(spark, own):
    docs = spark.createDataFrame([(1, "Hello  wörld,\n 漢字 12 <|endoftext|>x"), (2, None)], "doc_id long, text string")
    plain = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs), plain=True).collect()}
    assert plain == {1: "hello wörld , 漢字 1 2 <|endoftext|>x", 2: ""}
    apart = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(apart) == sorted(bpe.encode(docs, decoded=True).collect())
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
    with pytest.raises(pa.ArrowIndexError):
        decoded(own, [10**6])


def test_every_row_of_a_table_with_awkward_rows(spark, library):
    want = []
    for row in corpus.rows():
        ids = ids_of(library, row[1])
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = bpe.digests(corpus.frame(spark))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(found.dtypes)["n_tokens"] == "bigint"
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
    assert bpe.digests(corpus.empty(spark)).count() == 0
