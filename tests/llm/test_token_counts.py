"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from braidflow.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   ", "\n\n a", "a  b\t\tc \n", "don't we'll I'M they've", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "<|endof<|endoftext|>text|>", "ß Ünï 中文 😀 é", "x" * 5000, "ab" * 3000, "١٢٣ Ⅷ ²³", "   a\u0085b\x1c", "�͸﷐", "same", "same", "ʼn ՙ", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(library):
    of = token_counts.Counter(PATH)
    rng = random.Random(3)
    # Code points of all planes, those of newer Unicode versions than the library's among them.
    points = [c for c in (*range(0x20, 0x3000), *range(0xA000, 0xABFF), *range(0x10000, 0x12000), *range(0x2EBF0, 0x2EC00), *range(0x323B0, 0x323C0)) if not 0xD800 <= c < 0xE000]
    texts = [t or "" for t in ODD]
    for _ in range(400):
        some = [chr(rng.choice(points)) for _ in range(rng.randint(1, 12))]
        texts.append("".join(rng.choice((*some, " ", "  ", "a", "1", "'s", "\n", ".", "the ")) for _ in range(rng.randint(1, 60))))
    for t in texts:
        assert of(t) == expected(library, t), t


def test_every_character_alone_and_among_letters(library):
    of = token_counts.Counter(PATH)
    for first in range(0x80, 0x3400, 7):
        text = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)}! " for c in range(first, first + 7))
        assert of(text) == expected(library, text), hex(first)


def test_merging_is_that_of_the_plain_loop():
    rng = random.Random(5)
    rank = {(a, b): i for i, (a, b) in enumerate([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "aa"), ("c", "ab"), ("bc", "bc")])}
    for _ in range(500):
        word = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        plain = list(word)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in rank]
            if not pairs:
                break
            _, i = min(pairs)
            plain[i : i + 2] = ["".join(plain[i : i + 2])]
        assert token_counts.merges(word, rank) == len(word) - len(plain), word


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    of = token_counts.Counter(PATH)
    text = "one two three four five one two three four five " * 5
    assert of(text) == expected(library, text)
    assert len(of.by_word) <= 3


def test_rows(spark, library):
    rows = [(i if i != 4 else None, t, 5, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    found = token_counts.token_counts(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(tuple, found.collect()), key=str)
    want = [(i, len((t or "").encode()), n := expected(library, t), n > 512) for i, t, _, _ in rows]
    assert got == sorted(want, key=str)
    assert any(r[3] for r in got) and not all(r[3] for r in got)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_other_kinds_of_vocabulary_are_an_error():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
