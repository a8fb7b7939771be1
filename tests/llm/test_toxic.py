"""Multiple-instance learning against brute force."""

import random

import numpy as np
import pyarrow as pa

from braidflow.llm import common, toxicity


def bags_of(text):
    (_, data, off), = common.blocks(pa.array([text]))
    return toxicity.bags(data, off)


def test_noisy_or_is_one_minus_the_product():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(0, 6, 8)
        first = np.concatenate(([0], np.cumsum(sizes)))
        p = rng.uniform(0, 1, first[-1])
        want = [1 - np.prod(1 - p[a:b]) for a, b in zip(first, first[1:])]
        assert np.allclose(toxicity.noisy_or(p, first), want, atol=1e-12)


def test_sentences_and_scores_by_hand():
    rng = random.Random(2)
    vocabulary = ["bad", "worse", "a", "grobian", "grobs", "fine", "Ünï"]
    weights = {"bad": 3.0, "gro": 1.5, "grob": 2.0, "grobian": -1.0}
    hashed = {}
    for feature in weights:
        b = bags_of(feature)
        whole = feature in ("bad", "grobian")
        kinds = [0] if whole else [1 + toxicity.BEGINNINGS.index(len(feature))]
        hashed[int(b.features[kinds[0]][0])] = weights[feature]
    keys = np.sort(np.array(list(hashed), np.uint64))
    model = toxicity.Model(keys, np.array([hashed[int(k)] for k in keys]), -2.0)
    for _ in range(60):
        sentences = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        text = "".join(" ".join(s) + rng.choice((". ", "!\n", "? ")) for s in sentences)
        b = bags_of(text)
        want = []
        for s in sentences:
            z = -2.0
            for w in s:
                z += weights.get(w, 0.0) if w in ("bad", "grobian") else 0.0
                z += (weights["gro"] + weights["grob"]) if w.startswith("grob") else 0.0
            want.append(1 / (1 + np.exp(-z)))
        assert len(b.start) == len(sentences)
        assert np.allclose(model.sentence_scores(b), want)
        assert np.isclose(toxicity.noisy_or(model.sentence_scores(b), b.first)[0], 1 - np.prod(1 - np.array(want)))


def test_fitting_follows_the_likelihoods_gradient_and_stops():
    """Document labels alone: one feature marks the toxic sentence of each toxic document."""
    rng = np.random.default_rng(3)
    label = (np.arange(120) % 3 == 0).astype(int)
    n = rng.integers(2, 7, 120)
    doc, sentence, feature = [], [], []
    for d in range(120):
        for s in range(n[d]):
            for f in rng.choice([1, 2, 3], 2):
                doc.append(d), sentence.append(s), feature.append(f)
        if label[d]:
            doc.append(d), sentence.append(0), feature.append(0)
    arrays = [np.array(x) for x in (doc, sentence, feature)]
    model = toxicity.fit_arrays(np.arange(4, dtype=np.uint64), label, n, *arrays)

    def loss(w, b, decay=1e-4):
        total = 0.0
        balance = {1: 0.5 / label.sum() * 120, 0: 0.5 / (120 - label.sum()) * 120}
        for d in range(120):
            z = np.full(n[d], b)
            for k in np.flatnonzero(arrays[0] == d):
                z[arrays[1][k]] += w[arrays[2][k]]
            none = np.prod(1 - 1 / (1 + np.exp(-z)))
            total -= balance[label[d]] * np.log(max(none if not label[d] else 1 - none, 1e-12))
        return total / 120 + decay / 2 * w @ w

    assert abs(loss(model.weights, model.bias) - model.loss) < 0.05 * model.loss + 1e-3
    assert model.rounds < 600 and model.weights[0] > 5 > max(model.weights[1:])
    rng = np.random.default_rng(4)
    for _ in range(20):  # no small move is much better
        assert loss(model.weights + rng.normal(0, 0.05, 4), model.bias) > 0.9 * loss(model.weights, model.bias)


def test_the_sample_is_bounded_whatever_the_rows(spark):
    rows = [(1, "same id, many rows")] * 300 + [(2, "x " * 40_000), (3, "short"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    got = sorted(map(tuple, toxicity._labelled(docs, labels, toxicity.F.lit(True), 10).collect()))
    assert got == [(0, ""), (1, "same id, many rows"), (1, "short")]
