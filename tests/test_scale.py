"""What must not grow with the number of files, items, rules or steps."""

import os
import random
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

import braidflow as b
from braidflow import functions, operators, sources
from braidflow.plans.state import StateTable


def jobs_of(spark, fn):
    """Spark jobs that a call starts."""
    group = f"count-{time.monotonic_ns()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- keyed rules


def lines(folder, names, rows=3):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(f"{folder}/{n}.csv", "w") as f:
            f.write("v,w\n" + "".join(f"{i},{n}\n" for i in range(rows)))


def a_chain(folder):
    clean = b.rule(f"{folder}/raw/{{s}}.csv", f"{folder}/clean/{{s}}.parquet", mode="keyed", name="clean")(lambda df: df.where("v > 0"))
    sums = b.rule(f"{folder}/clean/{{s}}.parquet", f"{folder}/sums/{{s}}.parquet", mode="keyed", name="sums")(lambda df: df.groupBy("s").agg(F.sum("v").alias("total"), F.max("w").alias("w")))
    return clean, sums


def test_a_chain_over_a_thousand_files_has_as_many_jobs_as_over_a_hundred(spark, tmp_path):
    counted = []
    for n in (100, 1000):  # both beyond the number of paths that Spark lists without a job
        folder = str(tmp_path / str(n))
        lines(f"{folder}/raw", [f"s{i}" for i in range(n)])
        clean, sums = a_chain(folder)
        jobs, found = jobs_of(spark, lambda: b.run(clean.then(sums), spark, raise_on_failure=True))
        counted.append(jobs)
        assert len(found) == 2 and len(found.last) == n
        out = sources.read_keyed(spark, sums.outputs[0], [{"s": f"s{i}"} for i in range(n)])
        assert out.count() == n and out.where("total <> 3 OR w <> s").count() == 0
        assert not [x for x in os.listdir(f"{folder}/sums") if x.startswith(".")]
    assert counted[1] <= counted[0], counted


def test_only_stale_assignments_run_again(spark, tmp_path):
    folder = str(tmp_path)
    lines(f"{folder}/raw", ["a", "b", "c d%e=1"])
    seen = []

    def work(df):
        seen.append(sorted(r["s"] for r in df.select("s").distinct().collect()))
        return df.where("v > 0")

    rule = b.rule(f"{folder}/raw/{{s}}.csv", f"{folder}/out/{{s}}.csv", mode="keyed")(work)
    time.sleep(0.05)
    assert b.run(rule, spark, raise_on_failure=True).success
    b.run(rule, spark, raise_on_failure=True)
    assert seen == [["a", "b", "c d%e=1"]]
    time.sleep(0.05)
    lines(f"{folder}/raw", ["b"], 5)
    b.run(rule, spark, raise_on_failure=True)
    assert seen[1:] == [["b"]]
    assert {n: spark.read.csv(f"{folder}/out/{n}.csv", header=True).count() for n in ("a", "b")} == {"a": 2, "b": 4}
    b.run(rule, spark, force=True, raise_on_failure=True)
    assert seen[2:] == [["a", "b", "c d%e=1"]]
    os.remove(f"{folder}/raw/a.csv")
    b.run(rule, spark, raise_on_failure=True)
    assert len(seen) == 3 and os.path.isdir(f"{folder}/out/a.csv")


def test_assignments_without_rows_strange_rows_and_failures(spark, tmp_path):
    folder = str(tmp_path)
    lines(f"{folder}/raw", ["a", "b"])
    some = b.rule(f"{folder}/raw/{{s}}.csv", f"{folder}/some/{{s}}.parquet", mode="keyed")(lambda df: df.where("s = 'a'"))
    b.run(some, spark, raise_on_failure=True)
    assert spark.read.parquet(f"{folder}/some/a.parquet").count() == 3
    assert spark.read.parquet(f"{folder}/some/b.parquet").count() == 0 and spark.read.parquet(f"{folder}/some/b.parquet").columns == ["v", "w"]
    strange = b.rule(f"{folder}/raw/{{s}}.csv", f"{folder}/some/{{s}}.parquet", mode="keyed")(lambda df: df.withColumn("s", F.lit("x")))
    found = b.run(strange, spark, force=True)
    assert not found.success and "weren't asked for" in found[0].result.message
    assert spark.read.parquet(f"{folder}/some/a.parquet").count() == 3 and not [x for x in os.listdir(f"{folder}/some") if x.startswith(".")]
    without = b.rule(f"{folder}/raw/{{s}}.csv", f"{folder}/some/{{s}}.parquet", mode="keyed")(lambda df: df.select("v"))
    assert "no columns ['s']" in b.run(without, spark, force=True)[0].result.message
    clash = b.rule(f"{folder}/raw/{{v}}.csv", f"{folder}/clash/{{v}}.parquet", mode="keyed")(lambda df: df)
    assert "names of its wildcards" in b.run(clash, spark)[0].result.message
    with pytest.raises(ValueError):
        b.rule(f"{folder}/a.csv", f"{folder}/b.csv", mode="keyed")(lambda df: df)


def test_keyed_and_other_rules_resolve_together(spark, tmp_path):
    folder = str(tmp_path)
    lines(f"{folder}/raw", ["a", "b", "c"])
    clean, sums = a_chain(folder)
    two = b.rule([f"{folder}/clean/{{s}}.parquet", f"{folder}/sums/{{s}}.parquet"], [f"{folder}/x/{{s}}.parquet", f"{folder}/y/{{s}}.parquet"], mode="keyed", name="two")(lambda c, s: (c.join(s.select("s", "total"), "s"), s.select("s", "total")))
    report = b.rule([f"{folder}/x/{{s}}.parquet"], [f"{folder}/report/{{s}}.txt"], name="report")(lambda i, o: open(o, "w").write(os.path.basename(i)))
    os.makedirs(f"{folder}/report")
    flow = b.Workflow().add(clean, sums, two, report).expand(f"{folder}/report/{{s}}.txt", s=["a", "b"]).add(f"{folder}/sums/c.parquet")
    node = b.plan(flow)
    names = [s.name for s in b.steps(node)]
    assert sorted(n for n in names if "assignments" in n) == ["clean(3 assignments)", "sums(3 assignments)", "two(2 assignments)"]
    b.run(node, spark, raise_on_failure=True)
    assert sorted(os.listdir(f"{folder}/report")) == ["a.txt", "b.txt"]
    assert spark.read.parquet(f"{folder}/x/a.parquet").select("v", "w", "total").orderBy("v").collect() == [(1, "a", 3), (2, "a", 3)]
    assert isinstance(b.plan(flow), b.NoWork)


def test_a_wildcards_filter_and_missing_inputs(spark, tmp_path):
    folder = str(tmp_path)
    lines(f"{folder}/raw", ["1", "2", "10"])
    clean, sums = a_chain(folder)
    found = b.run(clean.then(sums), spark, wildcards_filter=lambda w: int(w["s"]) < 5, raise_on_failure=True)
    assert [os.path.basename(p) for p in found.last] == ["1.parquet", "2.parquet"]
    node = b.plan(clean)
    os.remove(f"{folder}/raw/10.csv")
    assert b.run(node, spark, force=True)[0].result.kind == "missing_input"
    with pytest.raises(b.NoRule):
        b.plan(b.rule(f"{folder}/none/{{s}}.csv", f"{folder}/no/{{s}}.csv", mode="keyed")(lambda df: df))


def test_a_filter_on_wildcards_opens_only_what_it_needs(spark, tmp_path):
    folder = str(tmp_path)
    lines(folder, ["a1", "a2", "b1"])
    with open(f"{folder}/b1.csv", "wb") as f:
        f.write(b"\xff" * 10)
    os.chmod(f"{folder}/b1.csv", 0o000)
    found = sources.read_pattern(spark, f"{folder}/{{k}}.csv", "csv", header=True, schema="v int, w string", where="k LIKE 'a%'")
    assert found.count() == 6 and len(found.inputFiles()) == 2
    assert sources.read_pattern(spark, f"{folder}/{{k}}.csv", "csv", header=True, schema="v int, w string", where="k = 'none'").collect() == []


# ---------------------------------------------------------------- items and folds


def test_a_block_per_item_sees_all_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(operators.grouped, "PIECE_ROWS", 700)
    n = 20_000
    df = spark.range(n, numPartitions=5).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id").withColumn("k", F.when(F.col("id") % 1000 != 7, F.col("k")))

    def part(item, rows):
        assert rows.num_rows <= 700 and set(rows["k"].to_pylist()) == {item["k"]}
        return [{"k": item["k"], "n": rows.num_rows, "s": sum(rows["id"].to_pylist())}]

    got = operators.each_item(df, "k", part, "k string, n long, s long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

    def whole(item, pieces):
        sizes = [p.num_rows for p in pieces]
        yield [{"k": item["k"], "n": sum(sizes), "s": 1}]

    again = operators.each_item(df, ["k"], whole, "k string, n long, s long", whole=True)
    assert sorted((r.k or "", r.n) for r in again.collect()) == sorted((r.k or "", r.n) for r in want.collect())
    assert operators.each_item(df.limit(0), "k", part, "k string, n long, s long").collect() == []


def test_blocks_give_tables_frames_and_nothing(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 4.0)], "k int, v double")

    def block(item, rows):
        if item["k"] == 1:
            return None
        return rows.to_pandas() if item["k"] == 2 else pa.table({"v": rows["v"], "k": rows["k"]})

    assert sorted(map(tuple, operators.each_item(df, "k", block, "k int, v double").collect())) == [(2, 3.0), (3, 4.0)]


def test_one_plan_for_a_hundred_thousand_items(spark):
    items = spark.range(200_000).select((F.col("id") % 100_000).alias("k"), "id")
    node = b.for_each(items, operators.TableBlock(("k",), lambda item, rows: [{"k": item["k"], "n": rows.num_rows}], "k long, n long"))
    jobs, found = jobs_of(spark, lambda: b.run(node, spark, raise_on_failure=True))
    assert jobs == 0 and found.last.groupBy("k").agg(F.sum("n").alias("n")).agg(F.count("*").alias("k"), F.min("n"), F.max("n")).first() == (100_000, 2, 2)


def test_one_scan_for_all_files_of_a_pattern(spark, tmp_path):
    counted = []
    for n in (50, 200):
        folder = str(tmp_path / str(n))
        lines(folder, [f"s{i}" for i in range(n)], rows=4)
        block = operators.TableBlock((), lambda item, rows: [{**item, "n": rows.num_rows, "w": rows["w"][0].as_py()}], "s string, n long, w string")
        jobs, found = jobs_of(spark, lambda: b.run(b.for_each(f"{folder}/{{s}}.csv", block), spark, raise_on_failure=True))
        counted.append(jobs)
        assert sorted(map(tuple, found.last.groupBy("s", "w").agg(F.sum("n")).collect())) == sorted((f"s{i}", f"s{i}", 4) for i in range(n))
    assert counted[0] == counted[1]
    assert b.run(b.for_each(f"{tmp_path}/none/{{s}}.csv", block), spark)[0].result.kind == "no_matches"


def variance(n):
    """Welford sums as a fold: count, mean and squared deviations."""

    def add(state, rows):
        out = state or (0, 0.0, 0.0)
        for x in rows["x"].to_pylist():
            out = merge(out, (1, x, 0.0))
        return out

    def merge(a, c):
        m = a[0] + c[0]
        d = c[1] - a[1]
        return m, a[1] + d * c[0] / m, a[2] + c[2] + d * d * a[0] * c[0] / m

    return add, merge, lambda item, s: [{**item, "n": s[0], "mean": s[1], "var": s[2] / s[0]}]


def test_a_fold_of_the_users_own(spark, monkeypatch):
    df = spark.range(60_000, numPartitions=7).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 400).cast("int").alias("k"), (F.sin("id") * 10 + 1e4).alias("x"))
    monkeypatch.setattr(operators.grouped, "HELD_STATES", 50)
    got = operators.fold(df, *variance(0), "k int, n long, mean double, var double", "k").collect()
    want = {r.k: r for r in df.groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).collect()}
    assert len(got) == len(want) == 201
    for r in got:
        w = want[r.k]
        assert r.n == w.n and abs(r["mean"] - w["mean"]) < 1e-6 and abs(r["var"] - w["var"]) < 1e-6
    everything = operators.fold(df, *variance(0), "n long, mean double, var double").collect()
    assert len(everything) == 1 and everything[0].n == 60_000
    assert operators.fold(df.limit(0), *variance(0), "n long, mean double, var double").collect() == []


# ---------------------------------------------------------------- order


def test_files_of_exactly_so_many_lines(spark, tmp_path):
    for n, rows in ((25, 10), (30, 10), (1, 10), (0, 10), (1000, 7)):
        out = str(tmp_path / f"{n}-{rows}")
        df = spark.range(n, numPartitions=4).select(F.format_string("%05d", "id").alias("value"))
        assert operators.split_files(df, out, rows, F.col("value")) == -(-n // rows)
        names = sorted(x for x in os.listdir(out) if x.startswith("part-") and os.path.getsize(f"{out}/{x}"))
        parts = [open(f"{out}/{x}").read().splitlines() for x in names]
        assert [len(p) for p in parts] == [rows] * (n // rows) + ([n % rows] if n % rows else [])
        assert [v for p in parts for v in p] == [f"{i:05d}" for i in range(n)]


def test_ordinals_are_places_in_the_order(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 300) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(6)
    placed = operators.with_ordinals(df, "v", F.desc("i"))
    assert "Window" not in plan_of(placed)
    want = sorted(enumerate(values), key=lambda p: (p[1] is not None, p[1] or 0, -p[0]))
    assert [(r.i, r.ordinal) for r in placed.orderBy("ordinal").collect()] == [(i, k) for k, (i, _) in enumerate(want)]
    with pytest.raises(ValueError):
        operators.with_ordinals(placed, "v")


# ---------------------------------------------------------------- rules by their index


def test_many_patterns_meet_targets_by_equi_joins(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    patterns = []
    for _ in range(400):
        segments = [rng.choice((rng.choice(words), "{x}", f"{rng.choice(words)}-{{y}}", "{a}.{b}")) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            segments[-1] += rng.choice((".csv", ".tar.gz", "+(x)[1]"))
        patterns.append("/".join(segments))
    targets = []
    for _ in range(1500):
        p = functions.patterns.WILDCARD.sub(lambda m: rng.choice((*words, "q.r", "é")), rng.choice(patterns)) if rng.random() < 0.8 else "/".join(rng.choice(words) for _ in range(3))
        targets.append(p)
    rules = spark.createDataFrame([(p, i % 37, f"r{i}") for i, p in enumerate(patterns)], "p string, pos int, `a name` string")
    asked = spark.createDataFrame([(t, i) for i, t in enumerate([*targets, None, ""])], "t string, pos2 int")
    found = operators.first_rule(asked, "t", rules, "p", "pos")
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    order = sorted(range(len(patterns)), key=lambda i: (i % 37, patterns[i]))
    want = []
    for i, t in enumerate(targets):
        hit = next((k for k in order if functions.match(patterns[k], t) is not None), None)
        if hit is not None:
            want.append((t, i, patterns[hit], hit % 37))
    assert sorted((r.t, r.pos2, r.p, r.pos) for r in found.collect()) == sorted(want)


# ---------------------------------------------------------------- state


def test_state_is_asked_for_the_steps_at_hand(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "state"))
    assert state.completed([1, 2]) == set()
    state.append_table(spark.range(100_000).select(F.col("id").alias("step_hash")))
    state.compact()
    assert state.completed([5, 7, 100_001]) == {5, 7} and state.completed(range(99_990, 100_050)) == set(range(99_990, 100_000))
    steps = spark.range(0, 1_000_000, 7).select(F.col("id").alias("step_hash"))
    assert state.pending(steps).count() == steps.count() - len(range(0, 100_000, 7))
    made = [b.step(lambda: None, name=f"n{i}", inputs=str(tmp_path)) for i in range(40)]
    kept = str(tmp_path / "run")
    assert b.run(b.Parallel.of(*made), spark, state_dir=kept).success
    jobs, again = jobs_of(spark, lambda: b.run(b.Parallel.of(*made), spark, state_dir=kept))
    assert all(r.skipped for r in again) and jobs <= 6


_HASHED = """
import sys; sys.path.insert(0, {root!r})
import braidflow as b
from braidflow.plans.state import step_hash
def mk(n, d={{"k": {{"x", "yy", "zzz"}}}}):
    return lambda df, k=3: df if n in {{"alpha", "beta", "gamma"}} else [d, k]
print([step_hash(b.step(mk(n), name="s")) for n in ("alpha", 1)])
"""


def test_a_steps_hash_is_the_same_in_every_process():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = [subprocess.run([sys.executable, "-c", _HASHED.format(root=root)], env=os.environ | {"PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2", "77")]
    assert len(set(got)) == 1 and len(set(eval(got[0]))) == 2


def test_a_steps_hash_follows_closures_and_defaults():
    from braidflow.plans.state import step_hash

    def mk(n, limit=5):
        def work(df, most=limit):
            return df, n, most

        return work

    def cyclic():
        def f():
            return f

        return f

    of = lambda w: step_hash(b.step(w, name="s"))
    assert of(mk(1)) == of(mk(1)) and len({of(mk(1)), of(mk(2)), of(mk("1")), of(mk(1, 6)), of(mk([1])), of(mk({1: 2}))}) == 6
    assert of(mk({"b": 1, "a": 2})) == of(mk({"a": 2, "b": 1})) and of(mk(object())) == of(mk(object()))
    assert of(cyclic()) == of(cyclic())
    seen = []
    step = b.step(lambda: seen.append(1), name="s")
    before = step_hash(step)
    step.work()
    assert step_hash(step) == before and step_hash(b.step(step.work, name="s")) != before


# ---------------------------------------------------------------- threads, budgets, stores


def test_a_fan_out_has_as_many_threads_as_jobs(spark):
    most, lock = [0], threading.Lock()
    before = threading.active_count()

    def note():
        with lock:
            most[0] = max(most[0], threading.active_count() - before)

    found = b.run(b.for_each(range(500), lambda i: lambda: note() or i), spark, jobs=4)
    assert [r.result for r in found] == list(range(500)) and most[0] <= 4


def test_branches_have_pools_of_their_own_under_fair_scheduling(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
import braidflow as b
spark = SparkSession.builder.master("local[2]").config("spark.scheduler.mode", "FAIR").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
def pool():
    spark.range(10).count()
    return spark.sparkContext.getLocalProperty("spark.scheduler.pool")
found = b.run(b.Parallel.of(*(b.step(pool) for _ in range(6))), spark, jobs=3)
print("pools", sorted(set(r.result for r in found)), spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    line = next(x for x in out.stdout.splitlines() if x.startswith("pools"))
    assert set(eval(line[6 : line.index("]") + 1])) <= {"branch-0", "branch-1", "branch-2"} and line.endswith("None")


def test_a_request_leaves_what_it_does_not_name_to_those_inside():
    peak, now, lock = [0], [0], threading.Lock()

    def work():
        with lock:
            now[0] += 1
            peak[0] = max(peak[0], now[0])
        time.sleep(0.15)
        with lock:
            now[0] -= 1

    fan = lambda mb: b.for_each(range(4), lambda i: b.with_resources(work, memory_mb=mb))
    assert b.run(b.with_resources(fan(100), threads=4), memory_mb=1000, threads=8, jobs=8).success and peak[0] == 4
    peak[0] = 0
    assert b.run(b.with_resources(fan(600), threads=4), memory_mb=1000, threads=8, jobs=8).success and peak[0] == 1
    peak[0] = 0
    both = b.with_resources(fan(400), threads=4) & b.with_resources(fan(400), threads=4)
    assert b.run(both, memory_mb=1000, threads=8, jobs=0).success and peak[0] == 2


def test_paths_without_a_scheme_belong_to_the_default_file_system(spark, tmp_path):
    from braidflow.sources import files

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("v\n1\n")
    where = f"{tmp_path}/x/{{s}}.csv"
    assert files.exists(f"file:{tmp_path}/x/a.csv") and files.exists(f"file://{tmp_path}/x/a.csv") and not files.exists(f"file:{tmp_path}/x/b.csv")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.test.link./data", f"file://{tmp_path}/x")
    conf.set("fs.defaultFS", "viewfs://test/")
    try:
        assert files.local_path("/data/a.csv") is None and files.exists("/data/a.csv") and not files.exists("/data/b.csv")
        assert not files.exists(f"{tmp_path}/x/a.csv") and files.exists(f"file:{tmp_path}/x/a.csv")
        assert files.find_matches("/data/{s}.csv") == [("/data/a.csv", {"s": "a"})]
        assert list(files.times_of(spark, "/data/{s}.csv")) == [("a",)]
        assert abs(files.file_times("/data/a.csv").newest - files.file_times(f"file:{tmp_path}/x/a.csv").newest) < 0.01
        rule = b.rule("/data/{s}.csv", "/data/out/{s}.parquet", mode="keyed")(lambda df: df)
        b.run(rule, spark, raise_on_failure=True)
        assert spark.read.parquet("/data/out/a.parquet").collect() == [(1,)]
    finally:
        conf.set("fs.defaultFS", before)
    assert files.find_matches(where)[0][1] == {"s": "a"}
