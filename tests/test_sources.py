"""Archives, the pattern source, rules on streams, counts of what was made."""

import os
import random
import subprocess
import sys
import tarfile
import time

import pytest
from pyspark.sql import functions as F

import braidflow as b
from braidflow import sources, streaming
from braidflow.sources import archives
from braidflow.sources.pattern_source import PatternReader, PatternSource

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# ---------------------------------------------------------------- tar


def test_rows_to_archives_and_back(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(f"d{i % 3}/{'n' * (i % 150)}{i}.bin", rng.randbytes(rng.choice((0, 1, 511, 512, 513, 5000)))) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    out = str(tmp_path / "out")
    made = sources.write_tars(df, out).collect()
    assert sum(r.members for r in made) == 200 and sorted(os.listdir(out)) == [os.path.basename(r.archive) for r in sorted(made)]
    for r in made:
        assert len(tarfile.open(r.archive).getmembers()) == r.members
    back = sources.read_tar(spark, out)
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == sorted(rows)
    index = sources.tar_index(spark, out)
    assert "content" not in index.columns and index.agg(F.sum("size")).first()[0] == sum(len(c) for _, c in rows)
    few = sources.tar_contents(index.where("name LIKE 'd1/%'"))
    assert few.count() == sum(n.startswith("d1/") for n, _ in rows)
    again = sources.write_tars(df, out).count()
    assert again == len(made) and len(os.listdir(out)) == len(made)


def test_a_large_archive_is_read_in_parts(spark, tmp_path):
    path = str(tmp_path / "a.tar")
    with tarfile.open(path, "w") as tar:
        for i in range(30):
            (tmp_path / "m").write_bytes(bytes([i]) * 1000)
            tar.add(tmp_path / "m", f"m{i}")
        tar.add(tmp_path, "folder", recursive=False)
    monkey = archives.PART_BYTES
    try:
        archives.PART_BYTES = 4000
        found = sources.read_tar(spark, path)
        # Reads of one part are in a task of their own key: the archive's bytes are dealt out.
        assert sorted((r.name, r.size, bytes(r.content)[0]) for r in found.collect()) == sorted((f"m{i}", 1000, i) for i in range(30))
    finally:
        archives.PART_BYTES = monkey
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 20_000)
    with pytest.raises(Exception):
        sources.read_tar(spark, path).collect()


# ---------------------------------------------------------------- format("pattern")


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for day in ("01", "02", "03"):
        for host in ("a", "b-1", "ü"):
            os.makedirs(folder / f"d={day}" / "sub", exist_ok=True)
            (folder / f"d={day}" / f"{host}.log").write_text(f"{day} {host}")
            (folder / f"d={day}" / "_hidden.log").write_text("x")
    return str(folder)


def test_wildcards_are_columns(spark, logs):
    sources.register_pattern(spark)
    df = spark.read.format("pattern").load(f"{logs}/d={{day}}/{{host}}.log")
    assert df.columns == ["day", "host", "path", "size", "content"]
    got = df.collect()
    assert sorted((r.day, r.host, bytes(r.content).decode()) for r in got) == sorted((d, h, f"{d} {h}") for d in ("01", "02", "03") for h in ("a", "b-1", "ü"))
    assert all(r.size == len(r.content) and r.path.endswith(f"d={r.day}/{r.host}.log") for r in got)
    assert spark.read.format("pattern").load(f"file://{logs}/d=01/{{host}}.log").count() == 3
    assert spark.read.format("pattern").load(f"{logs}/none/{{host}}.log").count() == 0
    with pytest.raises(Exception, match="can't be named"):
        spark.read.format("pattern").load(f"{logs}/{{path}}.log").collect()


def test_filters_reach_the_listing(spark, logs):
    sources.register_pattern(spark)
    closed = f"{logs}/d=03/a.log"
    os.chmod(closed, 0)
    try:
        df = spark.read.format("pattern").load(f"{logs}/d={{day}}/{{host}}.log").where("day = '02' AND host IN ('a', 'ü') AND size > 1")
        assert sorted(r.host for r in df.collect()) == ["a", "ü"]
        assert spark.read.format("pattern").load(f"{logs}/d={{day}}/{{host}}.log").where("day < '02' AND host LIKE 'b%'").count() == 1
    finally:
        os.chmod(closed, 0o644)
    reader = PatternReader(f"{logs}/d={{day}}/{{host}}.log", PatternSource({"path": f"{logs}/d={{day}}/{{host}}.log"}).schema())
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("day",), "02"), GreaterThan(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)]
    os.chmod(f"{logs}/d=03", 0)  # a folder that the filter rules out isn't listed
    try:
        assert len(list(reader.listed())) == 3
    finally:
        os.chmod(f"{logs}/d=03", 0o755)


def test_files_are_grouped_into_partitions(logs, monkeypatch):
    from braidflow.sources import pattern_source

    monkeypatch.setattr(pattern_source, "PART_FILES", 4)
    source = PatternSource({"path": f"{logs}/d={{day}}/{{host}}.log"})
    parts = source.reader(source.schema()).partitions()
    assert [len(p.files) for p in parts] == [4, 4, 1]


# ---------------------------------------------------------------- rules on streams


_MAKER = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import braidflow as b, os
from braidflow import streaming
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {folder!r} + "/wh").config("spark.sql.shuffle.partitions", "2").getOrCreate()
made = []
def work(df):
    with open({folder!r} + "/calls", "a") as f:
        f.write(",".join(sorted(r["s"] for r in df.select("s").distinct().collect())) + "\\n")
    return df
rule = b.rule({folder!r} + "/in/{{s}}.csv", {folder!r} + "/out/{{s}}.parquet", mode="keyed", name="copy")(work)
twice = b.rule({folder!r} + "/out/{{s}}.parquet", {folder!r} + "/two/{{s}}.parquet", mode="keyed", name="two")(lambda df: df.selectExpr("v * 2 AS v", "s"))
if sys.argv[1] == "die":
    from braidflow.plans import rules
    inner = rules.made_from
    def made_from(x, values):
        node = inner(x, values)
        class Dying:
            def run(self, *a, **k):
                node.run(*a, **k)
                os._exit(7)  # the targets are made; the batch isn't recorded
        return Dying()
    rules.made_from = made_from
streaming.make_from_new_files(spark, rule.then(twice), {folder!r} + "/seen")
print("rows", sorted((r["v"]) for r in spark.read.parquet({folder!r} + "/two/*.parquet").collect()))
"""


def test_targets_are_made_once_also_after_a_crash(tmp_path):
    folder = str(tmp_path)
    os.makedirs(f"{folder}/in")

    def put(name, v):
        with open(f"{folder}/in/.{name}", "w") as f:
            f.write(f"v\n{v}\n")
        os.rename(f"{folder}/in/.{name}", f"{folder}/in/{name}.csv")

    def go(how):
        return subprocess.run([sys.executable, "-c", _MAKER.format(root=ROOT, folder=folder), how], capture_output=True, text=True, timeout=180)

    put("a", 1), put("b", 2)
    time.sleep(0.1)
    assert go("die").returncode == 7
    calls = open(f"{folder}/calls").read().split()
    assert calls == ["a,b"]
    put("c", 3)
    time.sleep(0.1)
    done = go("live")
    assert "rows [2, 4, 6]" in done.stdout, done.stderr[-2000:]
    calls = open(f"{folder}/calls").read().split()
    assert sorted(x for c in calls for x in c.split(",")) == ["a", "b", "c"]
    assert "rows [2, 4, 6]" in go("live").stdout and len(open(f"{folder}/calls").read().split()) == len(calls)


def test_a_plain_rule_on_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    os.makedirs(f"{folder}/in"), os.makedirs(f"{folder}/out")
    rule = b.rule(f"{folder}/in/{{s}}.txt", f"{folder}/out/{{s}}.txt")("tr a-z A-Z < {input} > {output}")
    for k in range(2):
        for i in range(3):
            (tmp_path / "in" / f"f{k}{i}.txt").write_text(f"x{k}{i}")
        (tmp_path / "in" / "other.csv").write_text("no")
        streaming.make_from_new_files(spark, rule, f"{folder}/seen")
        assert sorted(os.listdir(f"{folder}/out")) == [f"f{j}{i}.txt" for j in range(k + 1) for i in range(3)]
    assert (tmp_path / "out" / "f12.txt").read_text() == "X12"


# ---------------------------------------------------------------- counts


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    out = str(tmp_path / "out.parquet")
    step = b.step(lambda: spark.range(1000).where("id % 3 = 0"), name="thirds", outputs=out)
    found = b.run(step >> (lambda paths: spark.read.parquet(*paths)) >> b.Retry(b.step(lambda df: df.limit(7)), 1), spark, raise_on_failure=True)
    assert [r.rows for r in found] == [334, None, 7] and found[0].bytes == sources.total_size(out) > 0 and "341 rows in 2 tables" in found.summary()
    table = found.to_df(spark)
    assert [(r.done, r.total) for r in table.orderBy("ordinal").collect()] == [(1, 3), (2, 3), (3, 3)]
    dry = b.run(step, spark, dry_run=True)
    assert list(dry) == [] and dry.plan_df(spark).collect() == [(0, "thirds", [], [out], "<lambda>")]
    assert b.run(step, spark, force=True).to_df(spark).first().rows == 334
