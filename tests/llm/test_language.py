"""Language ID against brute force, and as a function of the text alone."""

import math
import random

import numpy as np

from braidflow.llm import lang_id

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}


def prose(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def slot(window):
    """Of an n-gram, as 32-bit arithmetic on its code points."""
    h = 0
    for k, (c, factor) in enumerate(zip(window, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))):
        h = (h + ord(c) * factor + k) % (1 << 32)
    return ((h ^ h >> 15) * 0x2C1B3C6D) % (1 << 32) >> 20


def counts_of(text):
    out = {}
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    for n in (1, 2, 3):
        for at in range(len(t) - n + 1):
            window = t[at : at + n]
            if any(c.isalpha() for c in window):
                out[slot(window)] = out.get(slot(window), 0) + 1
    return out


def model(rng):
    langs = [lang for lang in ALPHABETS for _ in range(12)]
    texts = [prose(rng, rng.randint(5, 40), ALPHABETS[lang]) for lang in langs]
    return lang_id.fit_arrays(langs, *lang_id.ngram_counts(texts))


TEXTS = ["", "abc", "xyz", "a", "É é", "12 !", "zzz the", "A b C 中文", "İstanbul", "\n\n", "the and of", "a b c"]


def test_counts_are_those_of_the_text_alone():
    counts, letters = lang_id.ngram_counts(TEXTS)
    for text, row, n in zip(TEXTS, counts, letters):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == counts_of(text)
        assert n == sum(c.isalpha() for c in text.lower())
    assert lang_id.ngram_counts([])[0].shape == (0, lang_id.DIM)


def test_a_text_scores_the_same_alone_and_in_any_batch():
    rng = random.Random(1)
    m = model(rng)
    texts = [*TEXTS, *(prose(rng, rng.randint(1, 30), rng.choice([*ALPHABETS.values(), "abchijopq"])) for _ in range(80))]
    alone = [tuple(x[0] for x in m.predict([t])) for t in texts]
    for size in (3, 17, len(texts)):
        order = rng.sample(range(len(texts)), len(texts))
        got = {}
        for at in range(0, len(order), size):
            part = order[at : at + size]
            got |= dict(zip(part, zip(*m.predict([texts[i] for i in part]))))
        assert [got[i] for i in range(len(texts))] == alone


def test_predictions_are_those_of_the_nearest_centroid():
    rng = random.Random(2)
    m = model(rng)
    texts = [prose(rng, rng.randint(1, 12), rng.choice(["abchij", "opqabc", "hijopq", *ALPHABETS.values()])) for _ in range(60)]
    langs, _, cosines, _ = m.predict(texts)
    for text, lang, cosine in zip(texts, langs, cosines):
        v = {k: math.log1p(n) * m.idf[k] for k, n in counts_of(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x / norm * c[k] for k, x in v.items()) for c in m.centroids]
        assert abs(max(near) - cosine) < 1e-5
        best = {}
        for own, x in zip(m.owner, near):
            best[m.languages[own]] = max(x, best.get(m.languages[own], -1))
        assert best[lang] > max(near) - 1e-5


def test_far_texts_are_rejected_and_texts_like_the_training_ones_are_not():
    rng = random.Random(3)
    m = model(rng)
    near = [prose(rng, rng.randint(5, 40), letters) for letters in ALPHABETS.values() for _ in range(40)]
    assert not any(m.predict(near)[3])
    far = ["Это предложение написано на русском языке, которого модель не знает.", "这是一个用中文写的句子，模型从来没有见过这种语言的任何文字，因此应该被拒绝接受。", prose(rng, 20, "vwxyz")]
    assert all(m.predict(far)[3])


def test_too_many_languages_are_an_error_and_none_is_left_out(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20, ALPHABETS[lang]), lang) for i, lang in enumerate(list(ALPHABETS) * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = lang_id.F.lit(True)
    fitted = lang_id.fit(docs, every, sample_docs=6)
    assert fitted.languages == sorted(ALPHABETS)
    again = lang_id.fit(docs.repartition(7), every, sample_docs=6)
    assert (again.centroids == fitted.centroids).all()
    clash = docs.select("doc_id", "text", lang_id.F.lit("old").alias("Lang_Pred"))
    assert [r.lang_pred == lang for r, (_, _, lang) in zip(lang_id.predict(clash, fitted, clash.columns, text_too=True).orderBy("doc_id").collect(), rows)]
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 2)
    import pytest

    with pytest.raises(ValueError):
        lang_id.fit(docs, every)
