"""The pipeline's stages together, against what brute force says of its result."""

import os
import re

import pytest

import corpus_pipeline
from braidflow.llm import common, decontaminate, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = common.read_table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_are_the_five_in_order_and_keep_the_columns(spark, stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    columns = common.read_table(spark, SF, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_each_stage_does_its_work_on_what_the_last_one_kept(spark, stages):
    docs = {r.doc_id: r.text for r in common.read_table(spark, SF, "documents").collect()}
    first = {r.doc_id for r in stages[0].collect()}
    assert first == {d for d, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    second = {r.doc_id for r in stages[1].collect()}
    sets = {d: shingles(docs[d]) for d in first}
    parent = {d: d for d in first}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(first)
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            same = docs[x] == docs[y]
            if (same or sets[x] & sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])) and root(x) != root(y):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    assert second == {root(d) for d in first}
    items = [decontaminate.normalised(__import__("numpy").frombuffer(r.text.encode(), "u1"))[0] for r in common.read_table(spark, SF, "benchmark").collect()]
    plain = {d: decontaminate.normalised(__import__("numpy").frombuffer(docs[d].encode(), "u1"))[0] for d in second}
    third = {r.doc_id for r in stages[2].collect()}
    assert {d for d in second if any(i in plain[d] for i in items)} <= second - third
    assert len(second - third) <= 0.1 * len(second)
    fourth = [r.doc_id for r in stages[3].collect()]
    assert set(fourth) <= third and len(fourth) > 0.5 * len(third)
    rows = sorted(stages[4].collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(fourth)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens


def test_registered_queries_need_no_limits():
    assert set(queries.queries()) >= {f"op{n}_{x}" for n, x in ((1, "html_extract"), (2, "license_scan"), (3, "secret_scan"), (4, "media_columns"), (5, "decontaminate"), (6, "token_output"), (7, "mixing"), (8, "near_dup"), (9, "lang_id"), (10, "toxicity"))}
    folder = os.path.dirname(queries.__file__)
    assert not re.search(r"localCheckpoint|\.cache\(\)", "".join(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".py")))
