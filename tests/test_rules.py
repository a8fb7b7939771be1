"""Patterns, rules, freshness by files."""

import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

import braidflow as b
from braidflow.functions import fill_special, has_wildcards, literal_root, match, substitute, to_regex, wildcards


def test_patterns():
    assert match("data/{kind}/{id}.fq", "data/raw/sample01.fq") == {"kind": "raw", "id": "sample01"}
    assert match("data/{kind}.fq", "data/a/b.fq") is None
    assert match("{a}_{b}_{c}", "x_45_1") == {"a": "x", "b": "45", "c": "1"}
    assert match("a+b({x}).c", "a+b(1).c") == {"x": "1"}
    assert wildcards("{b}/{a}", "{a}{c}") == ["b", "a", "c"] and has_wildcards("x{y}") and not has_wildcards("{input[1]}")
    assert literal_root("a/b/{x}.c") == "a/b" and literal_root("{x}") == "." and literal_root("/{x}") == "/"
    assert fill_special("c {input} {input[2]} > {output[1]}", ["i", "j"], ["o"]) == "c i j j > o"
    assert substitute("awk '{{print}}' {x}", {"x": 1}) == "awk '{print}' 1"
    with pytest.raises(ValueError):
        substitute("{missing}", {})


def test_expand():
    assert b.expand("{s}.{ext}", s=["A", "B"], ext=["bam", "bai"]) == ["A.bam", "A.bai", "B.bam", "B.bai"]
    assert b.expand("step_{n}.txt", n=range(1, 4)) == ["step_1.txt", "step_2.txt", "step_3.txt"]
    assert b.expand(["{a}", "{b}{a}"], a=[1], b="x", unused=[3]) == ["1", "x1"]
    assert b.expand(["as", "is"]) == ["as", "is"]
    with pytest.raises(ValueError):
        b.expand("{a}{b}", a=[1])


@given(st.dictionaries(st.sampled_from("abc"), st.text("xyz.01-+", min_size=1, max_size=6), min_size=3, max_size=3))
def test_what_substitute_makes_matches(values):
    path = substitute("root/{a}/{b}/{c}.txt", values)
    assert match("root/{a}/{b}/{c}.txt", path) == values
    assert to_regex("root/{a}/{b}/{c}.txt")[1] == ["a", "b", "c"]


@pytest.fixture
def chain(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for d in ("raw", "out"):
        os.mkdir(d)
    (tmp_path / "raw/sampleA_1.txt").write_text("hello")
    (tmp_path / "raw/sampleA_101.txt").write_text("skip")
    upper = b.rule("raw/{s}_{rep}.txt", "out/upper-{s}_{rep}.txt", name="upper")("tr a-z A-Z < {input} > {output}")
    loud = b.rule("out/upper-{s}_{rep}.txt", "out/loud-{s}_{rep}.txt", name="loud")(lambda i, o: open(o, "w").write(open(i).read() + "!"))
    return tmp_path, upper, loud


def test_forward_chain_with_a_filter(chain):
    path, upper, loud = chain
    (path / "out/upper-sampleA_1.txt").write_text("stale")
    os.utime(path / "out/upper-sampleA_1.txt", (1, 1))
    r = b.run(upper.then(loud), wildcards_filter=lambda w: int(w["rep"]) < 100)
    assert r.success and (path / "out/loud-sampleA_1.txt").read_text() == "HELLO!"
    assert not (path / "out/upper-sampleA_101.txt").exists()
    os.utime(path / "raw/sampleA_1.txt", (10, 10))
    os.utime(path / "out/upper-sampleA_1.txt", (20, 20))
    os.utime(path / "out/loud-sampleA_1.txt", (30, 30))
    again = b.run(upper.then(loud), wildcards_filter=lambda w: int(w["rep"]) < 100)
    assert [x.skipped for x in again] == [True, True]
    os.utime(path / "out/loud-sampleA_1.txt", (20, 20))  # a tie is stale
    assert [x.skipped for x in b.run(upper.then(loud), wildcards_filter=lambda w: int(w["rep"]) < 100)] == [True, False]
    assert not any(x.skipped for x in b.run(upper.then(loud), force=True))


def test_backward_resolution_shares_needs_and_finds_faults(chain):
    path, upper, loud = chain
    calls = []
    prep = b.rule((), "shared.txt", name="prep")(lambda o: calls.append(1) or open(o, "w").write("s"))
    a = b.rule("shared.txt", "a.out", name="a")("cp {input} {output}")
    c = b.rule("shared.txt", "b.out", name="c")("cp {input} {output}")
    w = b.Workflow("w").add([prep, a], c, ["a.out", "b.out"])
    assert b.run(w).success and calls == [1] and (path / "b.out").read_text() == "s"
    assert isinstance(b.plan(w), b.NoWork)
    with pytest.raises(b.NoRule):
        b.resolve([a], "nothing.out")
    x, y = b.rule("x", "y")("cp x y"), b.rule("y", "x")("cp y x")
    with pytest.raises(b.RuleCycle):
        b.resolve([x, y], "x")
    with pytest.raises(ValueError):
        b.rule("{a}.txt", "out.txt")("true")
    with pytest.raises(ValueError):
        b.plan(b.Workflow("empty"))
    with pytest.raises(TypeError):
        b.Workflow().add(3)


def test_check_and_explain_call_no_user_code(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    os.mkdir("tsv")
    for i in range(1, 26):
        (tmp_path / f"tsv/sample_{i}.tsv").write_text("x")

    def never(*args):
        raise AssertionError("called")

    keep = b.rule("tsv/sample_{i}.tsv", "out/{i}.tsv", name="keep", mode="builder")(never)
    found = b.check(keep, limit=3)
    assert len(found.previews) == 3 and found.runnable == 25 and "25 runnable" in found.note
    assert b.check(keep, "out/7.tsv").previews[0].inputs == ("tsv/sample_7.tsv",)
    with pytest.raises(b.NoRule):
        b.check(keep, "elsewhere")
    index = b.rule("out/{i}.tsv", "{i}.idx", name="index")("mk {input} {output}")
    found = b.explain([index, keep], "3.idx")
    assert [p.rule for p, _ in found] == ["keep", "index"] and found[1][0].command == "mk out/3.tsv 3.idx" and found[1][1] == ("out/3.tsv",)


def test_rules_into_a_sink(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    os.mkdir("raw")
    os.mkdir("out")
    for n, t in (("a", "one"), ("b", "two")):
        (tmp_path / f"raw/{n}.txt").write_text(t)
    copy = b.rule("raw/{s}.txt", "out/{s}.txt", name="copy")("cp {input} {output}")
    r = b.run(copy.then(lambda outs: sorted(p for ps in outs for p in ps)))
    assert r.last == ["out/a.txt", "out/b.txt"]
    mark = b.rule("out/{s}.txt", "out/{s}.end", name="mark")("cp {input} {output}")
    r = b.run(copy.then(mark).then(lambda outs: [p for ps in outs for p in ps]), force=True)
    assert sorted(r.last) == ["out/a.end", "out/b.end"]


def test_a_builder_makes_nodes_and_steps_with_wildcards_are_rules(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.in").write_text("v")
    made = b.step(lambda i, o: open(o, "w").write("w"), name="w", inputs="{s}.in", outputs="{s}.out")
    assert isinstance(made, b.Rule)
    assert b.run(made).success and (tmp_path / "a.out").read_text() == "w"
    built = b.rule("{s}.in", "{s}.got", mode="builder")(lambda ins, outs, w: f"printf {w['s']} > {outs[0]}")
    assert b.run(built).success and (tmp_path / "a.got").read_text() == "a"


def test_deep_and_wide_graphs_resolve_without_recursion(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p0").write_text("x")
    deep = [b.rule(f"p{i}", f"p{i + 1}", name=f"r{i}")("cp {input} {output}") for i in range(3000)]
    found = b.explain(deep, "p3000")
    assert len(found) == 3000 and [p.rule for p, _ in found][:2] == ["r0", "r1"]
    assert len(b.steps(b.resolve(deep[:40], "p40"))) == 40
    # every level needs the one before it twice: 2^40 ways
    wide = [b.rule((f"q{i}", f"w{i}"), (f"q{i + 1}", f"w{i + 1}"), name=f"d{i}")("true") for i in range(1, 41)] + [b.rule("p0", ("q1", "w1"), name="d0")("true")]
    assert [p.rule for p, _ in b.explain(wide, "q41")] == [f"d{i}" for i in range(41)]
    assert len(b.steps(b.resolve(wide, ["q41", "w41"]))) == 41
    loop = [b.rule("c", "a")("x"), b.rule("a", "b")("x"), b.rule(("b", "p0"), "c")("x"), b.rule("a", "d")("x")]
    with pytest.raises(b.RuleCycle) as e:
        b.resolve(loop, "d")
    assert sorted(str(e.value).split(" -> ")[:-1]) == ["a", "b", "c"]


def test_shared_needs_are_explained_once_or_each_time():
    base = b.rule("raw", "base", name="base")("mk")
    left, right = b.rule("base", "l", name="left")("mk"), b.rule("base", "r", name="right")("mk")
    top = b.rule(("l", "r"), "top", name="top")("join {input}")
    rules = [top, left, right, base]
    once = b.explain(rules, "top")
    assert sorted(p.rule for p, _ in once) == ["base", "left", "right", "top"] and once[0][0].rule == "base" and once[3][1] == ("l", "r")
    assert [p.rule for p, _ in b.explain(rules, "top", repeats=True)] == ["base", "left", "base", "right", "top"]
    assert str(once).splitlines()[0] == "top: 4 step(s)" and "join l r" in str(once) and "needs l, r" in str(once)


def test_checks_and_results_read_well(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.in").write_text("v")
    keep = b.rule("{s}.in", "{s}.out", name="keep")("cp {input} {output}")
    assert str(b.check(keep)) == "1 runnable\n  keep (s = a)\n    a.in -> a.out\n    cp a.in a.out"
    r = b.run(keep)
    assert str(r).splitlines()[0].startswith("1/1 steps succeeded") and "  from a.in" in str(r) and "  to a.out" in str(r)
    assert re.match(r"FAILED bad \(\d+\.\d\d s\)\n  exception: ZeroDivisionError", str(b.run(b.step(lambda: 1 / 0, name="bad"))[0]))


def test_files_with_odd_names_are_found(spark, tmp_path):
    for n in ("a b", "c+d", "e%20f", "ü"):
        (tmp_path / f"in {n}.txt").write_text("x\n")
    got = b.read_pattern(spark, f"{tmp_path}/in {{s}}.txt")
    assert sorted(r.s for r in got.collect()) == ["a b", "c+d", "e%20f", "ü"]
    from braidflow.sources import files

    assert files.discover(f"{tmp_path}/in {{s}}.txt") == sorted(f"{tmp_path}/in {n}.txt" for n in ("a b", "c+d", "e%20f", "ü"))


def test_remote_files_are_found_and_read(spark, tmp_path):
    """Through a path that only Hadoop's API can open."""
    from braidflow.sources import files

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    assert [p.rsplit("/in/", 1)[1] for p in files.discover("viewfs://box/in/{x}.txt")] == ["b.txt", "sub/a.txt"]
    assert files.discover("viewfs://box/in/none/{x}") == []
    assert b.materialize(b.FilePath("viewfs://box/in/b.txt")) == b"two"
    assert files.exists("viewfs://box/in/sub/a.txt") and not files.exists("viewfs://box/in/c")
    assert [m for _, m in files.find_matches("viewfs://box/in/{d}/{x}.txt")] == [{"d": "sub", "x": "a"}]
