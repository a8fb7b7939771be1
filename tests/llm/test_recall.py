"""Near duplicates: both stated rules against all pairs, on documents with repeated lines."""

import random

import numpy as np
import pyarrow as pa
import pytest

from braidflow.llm import common, near_dup

SF = "/root/testdata/sf0.001"


def with_repeated_lines(rows, n, rng):
    """Beside the rows: copies with one line of theirs many times more (alike as plain sets),
    and texts of much the same lines under little of their own (alike by weight)."""
    out = list(rows)
    usable = [r for r in rows if 200 < len(r[1]) < 4000]
    for k, (_, text) in enumerate(rng.sample(usable, min(n, len(usable)))):
        lines = [x for x in text.split("\n") if len(x) > 40] or [text]
        for m in (1, 4):
            out.append((10_000_000 + 10 * k + m, text + ("\n" + rng.choice(lines)) * m * 3))
        line = " ".join(text.split()[:20])
        for m in (5, 6):
            own = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randint(10, 50)))
            out.append((20_000_000 + 10 * k + m, own + f"\n{line}" * 40))
    return out


def true_links(texts, nodes, idf):
    """(a, b, weighted, plain) of all pairs of which either similarity is THRESHOLD or more."""
    duckdb = pytest.importorskip("duckdb")
    node, key, times = [], [], []
    for row, data, off in common.blocks(pa.array(texts)):
        for k, (keys, n) in enumerate(near_dup.text_shingles(data, off), row):
            node.append(np.full(len(keys), nodes[k]))
            key.append(keys)
            times.append(n)
    key = np.concatenate(key)
    weight = idf[(key >> np.uint64(64 - near_dup.BITS)).astype(np.int64)].astype(float)
    sets = pa.table({"node": np.concatenate(node), "key": key.view(np.int64), "n": np.concatenate(times).astype(float), "w": weight})
    con = duckdb.connect()
    con.register("s", sets)
    return con.execute(f"""WITH t AS (SELECT node, sum(n * w) AS w, count(*) AS c FROM s GROUP BY 1),
        p AS (SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n) * x.w) AS w, count(*) AS c FROM s x JOIN s y ON x.key = y.key AND x.node < y.node GROUP BY 1, 2),
        l AS (SELECT a, b, p.w / (ta.w + tb.w - p.w) AS weighted, p.c / (ta.c + tb.c - p.c) AS plain FROM p JOIN t ta ON ta.node = a JOIN t tb ON tb.node = b)
        SELECT * FROM l WHERE weighted >= {near_dup.THRESHOLD} OR plain >= {near_dup.THRESHOLD}""").fetchall()


def measured(spark, sf, n):
    """Of each rule: links, those in one class, and the same of links by that rule alone; and
    how many rows have another class than that of all true links."""
    rows = [(r.doc_id, r.text or "") for r in common.read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = with_repeated_lines(rows, n, random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    node = {}
    for i, t in sorted(rows):
        node.setdefault(t, i)
    links = true_links(list(node), list(node.values()), near_dup.idf_table(docs))
    found = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    report = {}
    for rule, k in (("weighted", 2), ("plain", 3)):
        own = [r for r in links if r[k] >= near_dup.THRESHOLD]
        alone = [r for r in own if r[5 - k] < near_dup.THRESHOLD]
        report[rule] = tuple(x for part in (own, alone) for x in (len(part), sum(found[r[0]] == found[r[1]] for r in part)))
    parent = {i: i for i in node.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return report, sum(found[i] != root(node[t]) for i, t in rows), len(rows)


def test_recall_of_both_rules(spark):
    report, other, rows = measured(spark, SF, 60)
    for total, caught, alone, alone_caught in report.values():
        assert total >= 50 and alone >= 20 and caught >= 0.95 * total and alone_caught >= 0.95 * alone
    assert other <= 0.01 * rows


def classes_by_row(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own string, doc_id_copy long, node long, key string, label int")
    return docs, near_dup.keep_one(docs)


def test_near_copies_without_doc_id_are_linked(spark):
    """Against brute force: rows with and without ids, all of whose texts are compared."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    groups = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for g, base in enumerate(groups):
        for k in range(25 if g == 0 else 3):  # the first group fills whole buckets
            text = " ".join([*base, *(word() for _ in range(k % 3))]) if k else " ".join(base)
            doc_id = None if g % 2 == 0 or k == 1 else 100 * g + k
            rows += [(doc_id, text, f"own{g}", 1, 2, "k", 3)] * (2 if k == 2 else 1)
    docs, kept = classes_by_row(spark, rows)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r["__own"] for r in got) == [f"own{g}" for g in range(6)]
    for r in got:
        g = int(r["__own"][3:])
        assert r.doc_id == (None if g % 2 == 0 else 100 * g) and (r.doc_id_copy, r.node, r.key, r.label) == (1, 2, "k", 3)
    found = near_dup.classes(docs).collect()
    assert len(found) == len(rows) and all(r.class_id is not None for r in found)
    by_class = {}
    for r in found:
        by_class.setdefault(r.class_id, []).append(r)
    assert sorted(map(len, by_class.values())) == sorted(sum(1 for x in rows if x[2] == f"own{g}") for g in range(6))
    assert sum(c >= near_dup.UNNAMED for c in by_class) == 3


def test_contraction_of_long_ways(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 400)
    edges = [(a, b) for a, b in zip(names[:300], names[1:300])] + [(names[300], x) for x in names[301:360]] + [(names[360], names[361])]
    want = {**dict.fromkeys(names[:300], min(names[:300])), **dict.fromkeys(names[300:360], min(names[300:360])), **dict.fromkeys(names[360:362], min(names[360:362]))}
    assert dict(map(tuple, near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).collect() == []
