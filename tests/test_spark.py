"""Tables through the algebra, sources and sinks, state, streams, and the queries' SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import braidflow as b
from braidflow import operators, sources
from braidflow.plans.state import StateTable
from braidflow.streaming import process_new_files

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_chain_of_steps_is_one_plan(spark):
    r = b.run(b.step(lambda: spark.read.parquet(f"{SF}/lineitem.parquet")) >> (lambda df: df.where("l_quantity > 30")) >> (lambda df: df.select("l_orderkey")), spark)
    text = plan_of(r.last)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert r.to_df(spark).where("success").count() == 3


def test_guards_see_failures_of_lazy_tables(spark):
    lazy = b.step(lambda: spark.range(3).select(F.raise_error(F.lit("late")).alias("x")))
    assert b.run(lazy, spark).success  # nothing has run yet
    r = b.run(lazy | (lambda: spark.range(2)), spark)
    assert r.last.count() == 2
    assert not b.run(lazy, spark, materialize="step").success
    assert not b.run(lazy**2, spark).success


def test_sql_steps_take_tables(spark):
    both = b.step(lambda: spark.range(5)) & (lambda: spark.range(3, 9))
    assert [r.id for r in b.run(both.pipe(b.sql("SELECT id FROM {0} JOIN {1} USING (id) ORDER BY id")), spark).last.collect()] == [3, 4]
    assert b.run(b.sql("SELECT :n AS n", n=4), spark).last.first().n == 4


def test_outputs_are_written_swapped_and_remembered(spark, tmp_path):
    out = str(tmp_path / "t.parquet")
    make = b.step(lambda: spark.range(4), name="make", outputs=out)
    r = b.run(make >> (lambda paths: spark.read.parquet(*paths).count()), spark)
    assert r.last == 4
    sources.write_table(spark.read.parquet(out).where("id > 1"), out)  # reads what it replaces
    assert spark.read.parquet(out).count() == 2
    state = str(tmp_path / "state")
    calls = []
    once = b.step(lambda: calls.append(1), name="once", inputs=out)
    b.run(once, spark, state_dir=state)
    r = b.run(once, spark, state_dir=state)
    assert calls == [1] and r[0].skipped
    b.run(b.Force(once), spark, state_dir=state)
    assert calls == [1, 1]
    with pytest.raises(RuntimeError):
        b.run(b.step(lambda: calls.append(2), name="two", inputs=out), spark, state_dir=state, report=lambda *a, **k: (_ for _ in ()).throw(RuntimeError()))
    table = StateTable(spark, state)
    assert table.table().select("step_hash").distinct().count() == 2
    table.compact()
    assert table.table().count() == 2
    table.clear()
    assert table.table().count() == 0


def test_csv_and_patterns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert b.materialize_table(b.FilePath(str(tmp_path / "t.csv")), spark).collect() == [(1, 2)]
    assert b.materialize(b.FilePath(str(tmp_path / "t.csv"))) == b"a,b\n1,2\n"
    for s in "AB":
        (tmp_path / f"in-{s}_1.tsv").write_text(f"id\tV_errors\n1\t0\n2\t{'2' if s == 'A' else '1'}\n")
    df = b.read_pattern(spark, f"{tmp_path}/in-{{s}}_{{rep}}.tsv", "csv", sep="\t", header=True, inferSchema=True)
    assert sorted(map(tuple, df.where("V_errors <= 1").select("s", "rep", "id").collect())) == [("A", "1", 1), ("B", "1", 1), ("B", "1", 2)]
    assert sources.matched_listing(spark, f"{tmp_path}/in-{{s}}_{{rep}}.tsv").count() == 2
    keep = b.rule(f"{tmp_path}/in-{{s}}_1.tsv", f"{tmp_path}/{{s}}.parquet", mode="table")(lambda df: df.where("V_errors <= 1"))
    assert b.run(keep, spark).success and spark.read.parquet(f"{tmp_path}/A.parquet").count() == 1


def test_shell_tables(spark):
    assert [r.value for r in sources.shell_lines(spark, "printf 'b\\na\\n' | sort").collect()] == ["a", "b"]
    lines = spark.createDataFrame([("x",), ("y",)], "value string")
    assert sorted(r.value for r in b.through_shell(lines, "tr a-z A-Z").collect()) == ["X", "Y"]


def test_timeout_cancels_the_spark_job(spark):
    slow = b.step(lambda: spark.range(4).select(F.expr("reflect('java.lang.Thread', 'sleep', CAST(20000 AS BIGINT))")).collect())
    r = b.run(b.Timeout(slow, 1.0), spark)
    assert r[0].failure.kind == "timed_out"


def test_only_new_files_are_processed(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    run = lambda: process_new_files(spark, f"{tmp_path}/in/{{s}}.txt", str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.select("s", F.upper("value").alias("v")))
    (tmp_path / "in/a.txt").write_text("x\n")
    run()
    (tmp_path / "in/b.txt").write_text("y\n")
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", "X"), ("b", "Y")]


def test_line_operators(spark):
    t = spark.createDataFrame([("1", "95.0", "99"), ("2", "oops", "99"), ("3", "91", "90.5")], "id string, v string, j string")
    assert [r.id for r in operators.threshold(t, v=90, j=90).collect()] == ["1", "3"]
    lines = spark.createDataFrame([("a\t1",), ("b\t40",), ("b",)], "value string")
    assert [r.value for r in operators.field_above(lines, 2, 30).collect()] == ["b\t40"]
    assert operators.byte_count(lines).first().bytes == 11
    assert [r.value[0] for r in operators.sorted_lines(lines, descending=True).collect()] == ["b", "b", "a"]


@pytest.mark.parametrize("name", sorted(__import__("braidflow.queries").queries.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry_point.queries()[name](spark, SF)
    want = con.sql(entry_point.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({entry_point.oracle_sql()[name]})").fetchall())


def test_a_fault_inside_the_optional_parts_is_not_hidden(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(entry_point.__file__))
    shutil.copytree(os.path.join(here, "braidflow"), tmp_path / "braidflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry_point.__file__, tmp_path)
    count = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    n = len(entry_point._core.QUERIES)
    assert count().stdout.split() == [str(n), str(n)]
    (tmp_path / "corpus_pipeline.py").write_text("from braidflow.llm import queries\n")
    assert count().stdout.split() == [str(n), str(n)]  # the subpackage alone is missing
    (tmp_path / "braidflow/llm").mkdir()
    (tmp_path / "braidflow/llm/__init__.py").write_text("")
    (tmp_path / "braidflow/llm/queries.py").write_text("import no_such_library\n")
    assert "no_such_library" in count().stderr
    (tmp_path / "braidflow/llm/queries.py").write_text("from braidflow.plans import no_such_name\n")
    assert "no_such_name" in count().stderr


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("on_driver", [0, 100_000])
def test_lineage_is_by_levels_and_names_cycles(spark, monkeypatch, on_driver):
    monkeypatch.setattr(operators.branching, "DRIVER_EDGES", on_driver)

    def edges(*pairs):
        return spark.createDataFrame(pairs, "output string, input string")

    diamonds = [p for i in range(5) for p in ((f"n{i}", f"a{i}"), (f"n{i}", f"b{i}"), (f"a{i}", f"n{i + 1}"), (f"b{i}", f"n{i + 1}"))]
    got = {r.path: r.depth for r in operators.lineage(edges(*diamonds), "n0").collect()}
    assert len(got) == 16 and got["n5"] == 10 and got["a4"] == 9
    assert {r.path: r.depth for r in operators.lineage(edges(("t", "a"), ("t", "b"), ("b", "a"), ("x", "t"), (None, "t"), ("a", None)), "t").collect()} == {"t": 0, "a": 2, "b": 1}
    assert operators.lineage(edges(("t", "a")), "none").collect() == [("none", 0)]
    with pytest.raises(operators.LineageCycle, match="a cycle over b, c"):
        operators.lineage(edges(("t", "b"), ("b", "c"), ("c", "b"), ("c", "d")), "t", depth=6)
    with pytest.raises(ValueError, match="over 5 levels"):
        operators.lineage(edges(*((f"p{i}", f"p{i + 1}") for i in range(9))), "p0", depth=5)


def test_the_first_matching_rule_is_a_projection_or_a_bounded_broadcast(spark, monkeypatch):
    targets = spark.createDataFrame([("a1", 1), ("a1", 1), ("b", 2), ("zz", 3), (None, 4)], "t string, n int")
    rules = spark.createDataFrame([(2, "any", "^[ab]"), (1, "a", "^a"), (1, "a2", "^a1")], "pos int, name string, rx string")
    want = [("a1", 1, 1, "a", "^a"), ("a1", 1, 1, "a", "^a"), ("b", 2, 2, "any", "^[ab]")]
    folded = operators.first_match(targets, "t", rules, "rx", "pos")
    assert sorted(map(tuple, folded.collect())) == want and "Join" not in plan_of(folded)
    assert operators.first_match(targets, "t", rules.limit(0), "rx", "pos").collect() == []
    monkeypatch.setattr(operators.branching, "FOLDED_RULES", 1)
    joined = operators.first_match(targets, "t", rules, "rx", "pos")
    assert sorted(map(tuple, joined.select("t", "n", "pos", "name", "rx").collect())) == want and "BroadcastNestedLoopJoin" in plan_of(joined)
    monkeypatch.setattr(operators.branching, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        operators.first_match(targets, "t", rules, "rx", "pos")


def test_joined_values_are_bounded(spark, monkeypatch):
    t = spark.createDataFrame([(" b ",), ("a",), ("b",), (None,)], "v string")
    assert operators.stripped_join(t, "v").first().joined == "a,b,b"
    assert operators.stripped_join(t, "v", distinct=True).first().joined == "a,b"
    monkeypatch.setattr(operators.lines, "MOST_JOINED", 1)
    with pytest.raises(ValueError):
        operators.stripped_join(t, "v")


def test_branches_stay_lazy_and_results_let_go_of_their_tables(spark):
    def persisted():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before = persisted()
    looked = b.step(lambda: spark.range(1000)) >> b.branch(lambda df: df.limit(3).count() > 2, lambda df: df.where("id < 5"), lambda df: df)
    r = b.run(looked, spark)
    assert r.last.count() == 5 and persisted() == before
    with b.run(b.step(lambda: spark.range(7)) ** 2, spark) as r:
        assert r.last.count() == 7 and persisted() == before + 1
    assert persisted() == before
    kept = b.run(b.step(lambda: spark.range(9)) >> b.branch(lambda df: True, lambda df: df, lambda df: df, keep=True), spark)
    assert kept.last.count() == 9
    kept.release()


def test_a_swap_leaves_a_whole_result_at_any_time(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t.parquet")
    sources.write_table(spark.range(3), out)
    sources.write_table(spark.range(5), out)
    assert spark.read.parquet(out).count() == 5 and os.listdir(tmp_path) == ["t.parquet"]
