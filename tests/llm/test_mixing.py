"""Budgets of leaves by windows against the dealing on the driver."""

import random

import pytest

from braidflow.llm import mixing

LEVELS = ("lang", "source")


def planned(spark, tokens, weights, share, epochs=2):
    rows = [(lang, source, i, n) for i, ((lang, source), n) in enumerate(tokens.items())]
    df = spark.createDataFrame(rows, "k0 string, k1 string, id long, n_tokens long")
    return {(r.k0, r.k1): r.budget for r in mixing.plan(df, share, weights, LEVELS, epochs).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_leaf_budgets_are_those_that_fill_deals(spark, seed):
    rng = random.Random(seed)
    langs = ["en", "de", "it"]
    tokens = {(lang, f"s{k}"): rng.choice((1, 5, 50, 500, 5000)) for lang in langs for k in range(rng.randint(1, 9))}
    weights = {"lang": {"en": 0.5, "de": 0.2}, "source": {"s0": 2.0, "s1": 0.0, "s2": 0.3}} if seed % 2 else {}
    share = rng.choice((0.2, 0.9, 1.7))
    leaves = [mixing.Leaf(path, n) for path, n in tokens.items()]
    mixing.budgets(leaves, share * sum(tokens.values()), weights, LEVELS, 2)
    got = planned(spark, tokens, weights, share)
    assert set(got) == set(tokens)
    for leaf in leaves:
        assert abs(got[leaf.path] - leaf.budget) < 1e-6 * max(1, leaf.budget), leaf


def test_plans_of_any_length_and_families_of_a_stated_number(spark, monkeypatch):
    rows = [(i, "a b c", "en", f"s{i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(map(tuple, mixing.mix_digest(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 2)
    assert sorted(map(tuple, mixing.mix_digest(docs).collect())) == want
    monkeypatch.setattr(mixing, "MAX_FAMILIES", 1)
    with pytest.raises(ValueError):
        mixing.mix_digest(docs)
