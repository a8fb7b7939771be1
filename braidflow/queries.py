"""Queries that witness the operators on the sample tables, and their SQL for DuckDB.

Wherever an operator of the algebra is the point, the query builds a pipeline and runs it;
its tables stay lazy, so what is returned is one plan.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions, operators, plans, sources, streaming
from .plans import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str) -> plans.Step:
    return plans.step(lambda: table(spark, sf_dir, name), name=f"scan_{name}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a query that writes files."""
    return f"{sources.scratch_dir(spark, '-queries')}/{name}-{uuid.uuid4().hex[:12]}"


def last(node: Any, spark: SparkSession, **options: Any) -> DataFrame:
    return node.run(spark, raise_on_failure=True, **options).last


def revenue(df: DataFrame) -> DataFrame:
    return df.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def revenue_by_flag(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = scan(spark, sf_dir, "lineitem") >> (lambda df: df.where("l_quantity > 30")) >> revenue >> revenue_by_flag
    return last(pipeline, spark)


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_returnflag")
def seq_filter_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 30")
def seq_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last(scan(spark, sf_dir, "lineitem") >> (lambda df: df.where("l_quantity > 30")) >> revenue, spark)


@query("SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1")
def par_last_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = plans.step(lambda: table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    b = plans.step(lambda: table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")))
    return last((a & b) >> (lambda df: df.groupBy("name").agg(F.count("*").alias("n"))), spark)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def par_pipe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def flag(f: str) -> plans.Step:
        return plans.step(lambda: table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == f) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber", "l_returnflag"))

    return last((flag("A") & flag("R")).pipe(lambda dfs: fold(DataFrame.unionByName, dfs)), spark)


@query("SELECT o_orderpriority AS branch, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def broadcast_per_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(p: str) -> plans.Step:
        return plans.step(lambda: table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == p).withColumn("branch", F.lit(p)))

    total = plans.step(lambda df: df.groupBy("branch").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    return last(plans.Reduce(lambda found: operators.concat(*found[1::2]), (part("1-URGENT") & part("2-HIGH")).broadcast(total)), spark)


@query("SELECT 'customers' AS what, count(*) AS n FROM customer UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment) FROM customer")
def same_input_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = plans.step(lambda df: df.agg(F.count("*").alias("n")).select(F.lit("customers").alias("what"), "n"))
    distinct = plans.step(lambda df: df.agg(F.count_distinct("c_mktsegment").alias("n")).select(F.lit("segments").alias("what"), "n"))
    found = (scan(spark, sf_dir, "customer") >> count.same_input(distinct)).run(spark, raise_on_failure=True)
    return operators.concat(found[1].result, found[2].result)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def foreach_items_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    segments = customers.select("c_mktsegment").distinct().orderBy("c_mktsegment")

    def block(segment: str) -> Callable[[], DataFrame]:
        return lambda: customers.where(F.col("c_mktsegment") == segment).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))

    return last(plans.Reduce(lambda dfs: operators.concat(*dfs), plans.for_each(segments, block)), spark)


@query("SELECT 'nation' AS tbl, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def foreach_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    def block(name: str) -> Callable[[], DataFrame]:
        return lambda: table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")

    return last(plans.Reduce(lambda dfs: operators.concat(*dfs), plans.for_each(["nation", "orders", "region"], block)), spark)


@query("SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM (SELECT s_acctbal FROM supplier UNION ALL SELECT c_acctbal FROM customer)")
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = plans.step(lambda: table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x")))
    b = plans.step(lambda: table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x")))
    return last(plans.Reduce(lambda dfs: operators.concat(*dfs).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")), a & b), spark)


@query("SELECT 3 AS branches, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) AS n")
def reduce_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    fan = plans.for_each(["region", "nation", "part"], lambda n: lambda: table(spark, sf_dir, n).select(F.lit(1).alias("one")))
    return last(plans.Reduce(lambda dfs: operators.concat(*dfs).agg(F.lit(len(dfs)).alias("branches"), F.count("*").alias("n")), fan), spark)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def fallback_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = plans.step(lambda: table(spark, sf_dir, "no_such_table")) | scan(spark, sf_dir, "orders")
    return last(source >> (lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))), spark)


@query("SELECT r_name AS name FROM region")
def branch_on_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    few, many = plans.step(lambda df: df.select(F.col("r_name").alias("name"))), plans.step(lambda df: df.select(F.lit("many").alias("name")))
    return last(scan(spark, sf_dir, "region") >> plans.branch(lambda df: df.limit(11).count() <= 10, few, many), spark)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def retry_flaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts: list[int] = []

    def flaky() -> DataFrame:
        attempts.append(1)
        if len(attempts) < 3:
            raise OSError("not yet")
        return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))

    return last(plans.step(flaky) ** 3, spark)


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def timeout_then_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    import time

    slow = plans.Timeout(plans.step(lambda: time.sleep(3)), 0.2)
    return last(slow | (lambda: table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))), spark)


@query("WITH b AS (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1) SELECT x.o_custkey, x.n, round(y.t, 2) AS total FROM b x JOIN b y USING (o_custkey) WHERE x.n > 12")
def shared_base_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = plans.step(lambda: table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("n")), name="base")
    left = base >> (lambda df: df.where("n > 12").select("o_custkey", "n"))
    right = base >> (lambda df: df.select("o_custkey", F.round("t", 2).alias("total")))
    return last(plans.Reduce(lambda found: found[1].join(found[3], "o_custkey"), left & right), spark)


@query(r"""SELECT page_id, regexp_extract(url, '^([^/]+)://([^/]+)/([^/]+)/([^/]+)$', 1) AS scheme, regexp_extract(url, '^([^/]+)://([^/]+)/([^/]+)/([^/]+)$', 2) AS host,
regexp_extract(url, '^([^/]+)://([^/]+)/([^/]+)/([^/]+)$', 3) AS lang, regexp_extract(url, '^([^/]+)://([^/]+)/([^/]+)/([^/]+)$', 4) AS rest FROM pages WHERE regexp_matches(url, '^([^/]+)://([^/]+)/([^/]+)/([^/]+)$')""")
def wildcard_match_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", functions.match_column(F.col("url"), "{scheme}://{host}/{lang}/{rest}").alias("m"))
    return found.where("m IS NOT NULL").select("page_id", *(F.col("m")[n].alias(n) for n in ("scheme", "host", "lang", "rest")))


@query("SELECT doc_id, source FROM documents WHERE CAST(regexp_extract(source, '^src([^/]+)$', 1) AS INT) < 10")
def wildcard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", "source", functions.match_column(F.col("source"), "src{rep}")["rep"].alias("rep"))
    return found.where(F.col("rep").cast("int") < 10).select("doc_id", "source")


@query("SELECT f.l_returnflag AS flag, s.l_linestatus AS status, 'out/' || f.l_returnflag || '/' || s.l_linestatus || '.parquet' AS target FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s")
def expand_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return functions.expand_table(spark, "out/{flag}/{status}.parquet", flag=lines.select("l_returnflag").distinct(), status=lines.select("l_linestatus").distinct())


@query("SELECT n_nationkey, 'cat ' || n_name || ' ' || CAST(n_regionkey AS VARCHAR) || ' > out/' || n_name || ' # ' || CAST(n_regionkey AS VARCHAR) AS command FROM nation")
def fill_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, outputs = F.array("n_name", F.col("n_regionkey").cast("string")), F.array(F.concat(F.lit("out/"), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", functions.fill_special_column("cat {input} > {output} # {input[2]}", inputs, outputs).alias("command"))


_EDGES = (
    "SELECT 'report' AS o, 'customer/' || c_custkey AS i FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'order/' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey "
    "UNION ALL SELECT 'order/' || o_orderkey, 'nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation"
)


@query(f"WITH RECURSIVE e(o, i) AS ({_EDGES}), n(path, depth) AS (SELECT 'report', 0 UNION SELECT e.i, n.depth + 1 FROM n JOIN e ON e.o = n.path) SELECT path, max(depth) AS depth FROM n GROUP BY path")
def resolve_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a report needs: customers, their orders, nations (by two ways) and regions."""
    customer, nation, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    path = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    ways = [
        customer.select(F.lit("report").alias("output"), path("customer", "c_custkey").alias("input")), customer.select(path("customer", "c_custkey").alias("output"), path("nation", "c_nationkey").alias("input")),
        bought.select(path("customer", "c_custkey").alias("output"), path("order", "o_orderkey").alias("input")), bought.select(path("order", "o_orderkey").alias("output"), path("nation", "c_nationkey").alias("input")),
        nation.select(path("nation", "n_nationkey").alias("output"), path("region", "n_regionkey").alias("input")),
    ]
    return operators.lineage(operators.concat(*ways), "report")


@query(
    "SELECT r_name AS target, ordinal, CASE ordinal WHEN 0 THEN 'prep' ELSE 'index' END AS rule, 'out/' || r_name || CASE ordinal WHEN 0 THEN '.clean' ELSE '.idx' END AS output, "
    "CASE ordinal WHEN 0 THEN 'cp raw/' || r_name || ' out/' || r_name || '.clean' ELSE 'mk out/' || r_name || '.clean out/' || r_name || '.idx' END AS command FROM region, (VALUES (0), (1)) v(ordinal)"
)
def explain_postorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps behind a target per region, needs first."""
    prep = plans.rule("raw/{s}", "out/{s}.clean", name="prep")("cp {input} {output}")
    index = plans.rule("out/{s}.clean", "out/{s}.idx", name="index")("mk {input} {output}")
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    rows = [(name, i, p.rule, p.outputs[0], p.command) for name in names for i, (p, _) in enumerate(plans.explain([index, prep], f"out/{name}.idx"))]
    return spark.createDataFrame(rows, "target string, ordinal int, rule string, output string, command string")


@query(
    "WITH r(pos, name, rx) AS (VALUES (1, 'urgent', '^1-[^/]+$'), (2, 'other', '^[^/]+-[^/]+$'), (3, 'any', '^[^/]+$')), t AS (SELECT DISTINCT o_orderpriority AS target FROM orders) "
    "SELECT target, name FROM (SELECT target, name, row_number() OVER (PARTITION BY target ORDER BY pos) AS n FROM t JOIN r ON regexp_matches(target, rx)) WHERE n = 1"
)
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [("urgent", "1-{x}"), ("other", "{x}-{y}"), ("any", "{x}")]
    rules = spark.createDataFrame([(i, n, functions.to_regex(p)[0]) for i, (n, p) in enumerate(patterns, 1)], "pos int, name string, rx string")
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("target")).distinct()
    return operators.first_match(targets, "target", rules, "rx", "pos").select("target", "name")


@query("SELECT o.o_orderkey AS step, max(o.o_orderdate) AS newest_input, min(l.l_shipdate) AS oldest_output FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1 HAVING max(o.o_orderdate) < min(l.l_shipdate)")
def fresh_by_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    ins = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_orderdate").alias("modified"))
    outs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_shipdate").alias("modified"))
    return state.fresh_steps(ins, outs)


@query("SELECT c_custkey AS step_hash, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def stale_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step_hash"), F.col("c_name").alias("name"))
    return state.stale_steps(steps, table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("step_hash")))


@query("SELECT o_custkey AS step_hash FROM orders UNION SELECT c_custkey FROM customer")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("step_hash"))
    return state.merged(old, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step_hash")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'csv')}/nation.csv"
    sources.write_table(table(spark, sf_dir, "nation"), path)
    return sources.read_table(spark, path)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders ORDER BY 1")
def sort_uniq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.unique_lines(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")))


@query("SELECT sum(len(string_split(text, chr(10)))) ::BIGINT AS lines FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.line_count(_lines(spark, sf_dir))


@query("SELECT sum(strlen(text) + 1)::BIGINT AS bytes FROM documents")
def byte_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.byte_count(table(spark, sf_dir, "documents"), "text")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1000")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return operators.head(lines, 1000, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.concat(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS name FROM part")
def upper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", operators.ascii_upper("p_name").alias("name"))


@query("SELECT round(avg(value), 6) AS mean, max(value) AS max FROM events")
def mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.mean_max(table(spark, sf_dir, "events"), "value")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 1")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.at_most(table(spark, sf_dir, "lineitem"), l_quantity=1).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE coalesce(TRY_CAST(split_part(props, ':', 2) AS DOUBLE), 0) > 90 OR value > 90")
def try_cast_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value", F.split_part("props", F.lit(":"), F.lit(2)).alias("x"))
    return operators.threshold(events, x=90).select("event_id").union(operators.threshold(events, value=90).select("event_id")).distinct()


@query("SELECT string_agg(trim(n_name) || trim(CAST(n_regionkey AS VARCHAR)), ',' ORDER BY trim(n_name) || trim(CAST(n_regionkey AS VARCHAR))) AS distinct_names, (SELECT string_agg(trim(CAST(n_regionkey AS VARCHAR)), ',' ORDER BY CAST(n_regionkey AS VARCHAR)) FROM nation) AS repeated FROM nation")
def strip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped values in order, once as they are and once with repeats."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name", F.col("n_regionkey").cast("string"), F.lit(" ")).alias("name"), F.concat(F.lit("  "), F.col("n_regionkey").cast("string")).alias("r"))
    names, repeated = operators.stripped_join(nation, "name", distinct=True), operators.stripped_join(nation, "r")
    return names.select(F.col("joined").alias("distinct_names")).crossJoin(repeated.select(F.col("joined").alias("repeated")))  # of one row each


@query("SELECT event_id, 'got_' || trim(event_type) AS got FROM events")
def prefix_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", operators.prefixed("event_type", "got_").alias("got"))


@query("SELECT count_if(o_orderstatus <> 'F') AS succeeded, count(*) AS total, bool_and(o_orderstatus <> 'F') AS all_ok, bool_or(o_orderstatus = 'F') AS any_failed, round(sum(o_totalprice), 4) AS seconds FROM orders")
def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.results_summary(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "F").alias("success"), F.col("o_totalprice").alias("duration")))


@query("SELECT o_orderkey, o_custkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 8) AS BIGINT) AS chunk FROM orders")
def jobs_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 8, ["o_custkey"], ["o_orderkey"])


@query("SELECT c_custkey, CAST(max_by(o_orderkey, o_orderkey) AS BIGINT) AS last_order FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def last_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return operators.last_by(joined.select("c_custkey", F.col("o_orderkey").alias("last_order")), ["c_custkey"], ["last_order"])


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scan(spark, sf_dir, "customer") & scan(spark, sf_dir, "nation")
    return last(both.pipe(plans.sql("SELECT n_name, count(*) AS n FROM {0} JOIN {1} ON c_nationkey = n_nationkey GROUP BY 1")), spark)


@query("SELECT array_to_string(list_sort(list_distinct(regexp_extract_all('{kind}/{id}.{kind}', '\\{(\\w+)\\}', 1))), ',') AS names, 'in/' || r_name || '.csv' AS path FROM region")
def wildcard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.array_sort(functions.wildcards_column(F.lit("{kind}/{id}.{kind}"))), ",")
    return table(spark, sf_dir, "region").select(names.alias("names"), functions.substitute_column("in/{r}.csv", {"r": F.col("r_name")}).alias("path"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return operators.existing(table(spark, sf_dir, "customer").select("c_custkey"), there, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def lacking_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return operators.lacking(table(spark, sf_dir, "customer").select("c_custkey"), there, "c_custkey")


# ---------------------------------------------------------------- files, rules and state
# These write the sample tables' parts to the shared folder, then run over what lies there.


def _segments(spark: SparkSession, sf_dir: str, folder: str, kind: str = "parquet") -> None:
    """A table per market segment, by one write, as ``<folder>/<segment>.<kind>``."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    names = customers.select("segment").distinct().collect()
    sources.write_keyed(customers, f"{folder}/{{segment}}.{kind}", [{"segment": r["segment"]} for r in names])


def _of_segment(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(F.lit(segment).alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_BY_SEGMENT = "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1"
_RICH_BY_SEGMENT = "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 5000 GROUP BY 1"


@query(_BY_SEGMENT)
def foreach_pattern_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "foreach")
    _segments(spark, sf_dir, folder)
    block = lambda segment: lambda: _of_segment(sources.read_table(spark, f"{folder}/{segment}.parquet"), segment)
    return last(plans.Reduce(lambda dfs: operators.concat(*dfs), plans.for_each(f"{folder}/{{segment}}.parquet", block)), spark)


@query("SELECT c_mktsegment AS segment, c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "scan")
    _segments(spark, sf_dir, folder, "csv")
    found = sources.read_pattern(spark, f"{folder}/{{segment}}.csv/{{part}}.csv", "csv", header=True, schema="c_custkey long, c_nationkey int, c_acctbal double")
    return found.where("c_acctbal < 0").select("segment", "c_custkey", "c_acctbal")


@query("SELECT r_name AS name, 'in/' || r_name || '.txt' AS path, CAST(length(r_name) + 1 AS BIGINT) AS size FROM region")
def listing_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "listing")
    table(spark, sf_dir, "region").select("r_name", F.col("r_name").alias("value")).repartition(1).write.partitionBy("r_name").text(f"{folder}/in")
    found = sources.matched_listing(spark, f"{folder}/in/r_name={{name}}/{{part}}.txt")
    name = F.url_decode(F.col("wildcards")["name"])
    return found.select(name.alias("name"), functions.substitute_column("in/{n}.txt", {"n": name}).alias("path"), "size")


@query("SELECT sum(strlen(s_name) + 1)::BIGINT AS bytes FROM supplier")
def bytes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "bytes")
    table(spark, sf_dir, "supplier").select("s_name").write.text(folder)
    return sources.read_bytes(spark, folder).agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def _keep_rich(spark: SparkSession, folder: str) -> plans.Rule:
    return plans.rule(f"{folder}/raw/{{segment}}.parquet", f"{folder}/rich/{{segment}}.parquet", mode="keyed", name="rich")(lambda df: df.where("c_acctbal > 5000"))


def _summed(spark: SparkSession, folder: str) -> plans.Rule:
    return plans.rule(f"{folder}/rich/{{segment}}.parquet", f"{folder}/sums/{{segment}}.parquet", mode="keyed", name="sums")(lambda df: df.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")))


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    return sources.read_pattern(spark, f"{folder}/sums/{{segment}}.parquet/{{part}}.parquet", "parquet").select("segment", "n", "balance")


@query("SELECT c_mktsegment AS segment, c_custkey FROM customer WHERE c_acctbal > 5000")
def rule_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "rule")
    _segments(spark, sf_dir, f"{folder}/raw")
    plans.run(_keep_rich(spark, folder), spark, raise_on_failure=True)
    return sources.read_pattern(spark, f"{folder}/rich/{{segment}}.parquet/{{part}}.parquet", "parquet").select("segment", "c_custkey")


@query(_RICH_BY_SEGMENT)
def rule_chain_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "chain")
    _segments(spark, sf_dir, f"{folder}/raw")
    plans.run(_keep_rich(spark, folder).then(_summed(spark, folder)), spark, raise_on_failure=True)
    return _sums(spark, folder)


@query(_RICH_BY_SEGMENT + " HAVING c_mktsegment <> 'BUILDING'")
def rule_chain_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "filtered")
    _segments(spark, sf_dir, f"{folder}/raw")
    plans.run(_keep_rich(spark, folder).then(_summed(spark, folder)), spark, raise_on_failure=True, wildcards_filter=lambda w: w["segment"] != "BUILDING")
    return _sums(spark, folder)


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 5000")
def rule_value_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipe")
    _segments(spark, sf_dir, f"{folder}/raw")
    sink = lambda paths: spark.read.parquet(*paths).agg(F.sum("n").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))
    return plans.run(_keep_rich(spark, folder).then(_summed(spark, folder)).then(sink), spark, raise_on_failure=True).last


@query(_RICH_BY_SEGMENT + " HAVING c_mktsegment IN ('BUILDING', 'MACHINERY')")
def workflow_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "workflow")
    _segments(spark, sf_dir, f"{folder}/raw")
    flow = plans.Workflow("sums").add(_summed(spark, folder), _keep_rich(spark, folder)).expand(f"{folder}/sums/{{s}}.parquet", s=["BUILDING", "MACHINERY"])
    plans.run(flow, spark, raise_on_failure=True)
    return _sums(spark, folder)


@query("SELECT c_mktsegment AS segment, 'sums' AS rule FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT c_mktsegment, 'rich' FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def resolve_missing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that targets need, some of which are there already."""
    folder = scratch(spark, "resolve")
    _segments(spark, sf_dir, f"{folder}/raw")
    names = sorted(r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect())
    sources.write_table(spark.range(1), f"{folder}/sums/BUILDING.parquet")
    goals = [f"{folder}/{kind}/{s}.parquet" for kind in ("sums", "rich") for s in names]
    found = plans.steps(plans.resolve([_keep_rich(spark, folder), _summed(spark, folder)], goals))
    return spark.createDataFrame([(v["segment"], s.work.rule.name) for s in found for v in s.work.values], "segment string, rule string")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS ordinal, c_mktsegment AS segment FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def check_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule would do, in order of paths; nothing runs."""
    folder = scratch(spark, "check")
    _segments(spark, sf_dir, f"{folder}/raw")
    found = plans.check(_keep_rich(spark, folder))
    return spark.createDataFrame([(i, p.wildcards["segment"]) for i, p in enumerate(found.previews)], "ordinal long, segment string")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def declared_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch(spark, 'output')}/counts.parquet"
    make = plans.step(lambda: table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), name="counts", outputs=out)
    return last(make >> (lambda paths: sources.read_table(spark, paths[0])), spark)


def _counting(spark: SparkSession, sf_dir: str, folder: str, calls: list[int]) -> plans.Step:
    def work() -> DataFrame:
        calls.append(1)
        return table(spark, sf_dir, "region").select("r_regionkey", F.lit(len(calls)).alias("run"))

    return plans.step(work, name="numbered", inputs=f"{folder}/in.parquet", outputs=f"{folder}/out.parquet")


@query("SELECT r_regionkey, 1 AS run, true AS skipped FROM region")
def fresh_outputs_are_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run does nothing, and what folds its results reads the output again."""
    folder, calls = scratch(spark, "skip"), []
    sources.write_table(table(spark, sf_dir, "region"), f"{folder}/in.parquet")
    _later()
    step = _counting(spark, sf_dir, folder, calls)
    plans.run(step, spark, raise_on_failure=True)
    found = plans.run(plans.Reduce(lambda values: sources.materialize_table(values[0], spark), step), spark, raise_on_failure=True)
    return found.last.withColumn("skipped", F.lit(found[0].skipped and len(calls) == 1))


@query("SELECT r_regionkey, 2 AS run FROM region")
def force_runs_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, calls = scratch(spark, "force"), []
    sources.write_table(table(spark, sf_dir, "region"), f"{folder}/in.parquet")
    _later()
    step = _counting(spark, sf_dir, folder, calls)
    plans.run(step, spark, raise_on_failure=True)
    plans.run(plans.Force(step), spark, raise_on_failure=True)
    return sources.read_table(spark, f"{folder}/out.parquet")


@query("SELECT r_regionkey, 2 AS run FROM region")
def newer_inputs_make_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, calls = scratch(spark, "stale"), []
    sources.write_table(table(spark, sf_dir, "region"), f"{folder}/in.parquet")
    step = _counting(spark, sf_dir, folder, calls)
    plans.run(step, spark, raise_on_failure=True)
    sources.write_table(table(spark, sf_dir, "region"), f"{folder}/in.parquet")
    plans.run(step, spark, raise_on_failure=True)
    return sources.read_table(spark, f"{folder}/out.parquet")


def _later() -> None:
    """Until a file's time differs from now, in whole milliseconds."""
    import time

    time.sleep(0.01)


@query("SELECT 'step ' || r_name AS name, 1::BIGINT AS completions FROM region")
def state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a run has completed are rows; a second run adds none, compacting keeps them."""
    folder = scratch(spark, "state")
    names = sorted(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect())
    sources.write_table(spark.range(1), f"{folder}/in.parquet")
    fan = plans.Parallel.of(*(plans.step(lambda: None, name=f"step {n}", inputs=f"{folder}/in.parquet") for n in names))
    for _ in range(2):
        plans.run(fan, spark, state_dir=f"{folder}/state", raise_on_failure=True)
    kept = plans.StateTable(spark, f"{folder}/state")
    kept.compact()
    return kept.table().groupBy("name").agg(F.count("*").alias("completions"))


@query("SELECT 'step ' || r_name AS name, 1::BIGINT AS before, 0::BIGINT AS after FROM region")
def state_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "clear")
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("step "), "r_name").alias("name"))
    kept = plans.StateTable(spark, f"{folder}/state")
    kept.append_table(regions.select("name", F.xxhash64("name").alias("step_hash")))
    before = {r["name"]: r["n"] for r in kept.table().groupBy("name").agg(F.count("*").alias("n")).collect()}
    kept.clear()
    counted = spark.createDataFrame(list(before.items()), "name string, before long")
    return counted.join(kept.table().groupBy("name").agg(F.count("*").alias("after")), "name", "left").select("name", "before", F.coalesce("after", F.lit(0)).cast("long").alias("after"))


@query("SELECT upper(n_name) AS name FROM nation")
def through_a_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.through_shell(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("value")), "tr a-z A-Z").select(F.col("value").alias("name"))


@query("SELECT DISTINCT p_brand AS value FROM part")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command's output as lines: here of files that Spark wrote."""
    folder = scratch(spark, "lines")
    table(spark, sf_dir, "part").select("p_brand").write.text(folder)
    return sources.shell_lines(spark, f"sort -u '{sources.local_path(folder)}'/part-*")


@query("SELECT 'large' AS arm, count(*) AS n FROM customer")
def branch_on_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm by the bytes of the files, which aren't read for it."""
    folder = scratch(spark, "size")
    _segments(spark, sf_dir, folder)
    large = lambda: sources.listing(spark, folder).agg(F.sum("size")).first()[0] > 1000
    count = lambda arm: lambda: spark.read.parquet(f"{folder}/*.parquet").agg(F.lit(arm).alias("arm"), F.count("*").alias("n"))
    return last(plans.branch(large, count("large"), count("small")), spark)


@query("SELECT c_mktsegment AS segment, c_custkey FROM customer")
def new_files_as_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over a folder that grows between them: every row once."""
    folder = scratch(spark, "stream")
    customers = table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value"), (F.col("c_custkey") % 2).alias("k"))

    def process() -> None:
        split = F.split("value", ",")
        streaming.process_new_files(spark, f"{folder}/in/{{batch}}/{{part}}.txt", f"{folder}/out", f"{folder}/seen", lambda df: df.select(split[1].alias("segment"), split[0].cast("long").alias("c_custkey")))

    for k in (0, 1):
        customers.where(F.col("k") == k).select("value").write.text(f"{folder}/in/{k}")
        process()
    process()
    return spark.read.parquet(f"{folder}/out")


# ---------------------------------------------------------------- more of the algebra


@query("SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def resourced_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = plans.with_resources(lambda df: df.groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("total")), memory_mb=200, threads=2)
    return last(scan(spark, sf_dir, "supplier") >> heavy, spark, memory_mb=100, threads=1)


@query("SELECT p_brand, max(p_retailprice) AS price FROM part WHERE p_size > 10 GROUP BY 1")
def step_of_a_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = scan(spark, sf_dir, "part") >> (lambda df: df.where("p_size > 10"))
    return last(plans.step(inner, name="large parts") >> (lambda df: df.groupBy("p_brand").agg(F.max("p_retailprice").alias("price"))), spark)


@query("SELECT r_name FROM region")
def no_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last(plans.NoWork() >> plans.NoWork() >> scan(spark, sf_dir, "region") >> (lambda df: df.select("r_name")), spark)


@query("SELECT 0 AS ordinal, 'region' AS tbl, count(*) AS n FROM region UNION ALL SELECT 1, 'orders', count(*) FROM orders UNION ALL SELECT 2, 'nation', count(*) FROM nation")
def branch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results stand in the branches' order, whichever ends first."""
    names = ("region", "orders", "nation")
    found = plans.run(plans.Parallel.of(*(plans.step(lambda n=n: table(spark, sf_dir, n).count(), name=n) for n in names)), spark, raise_on_failure=True)
    return spark.createDataFrame([(i, r.step, r.result) for i, r in enumerate(found)], "ordinal int, tbl string, n long")


@query("SELECT * FROM (SELECT 0 AS ordinal, 'count' AS step, true AS success, NULL AS kind, CAST(count(*) AS VARCHAR) AS preview FROM nation UNION ALL SELECT 1, 'fails', false, 'exception', NULL)")
def results_as_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(n: int) -> None:
        raise ValueError("no")

    count = plans.step(lambda: table(spark, sf_dir, "nation").count(), name="count")
    found = plans.run(count >> plans.step(fails) >> (lambda x: x), spark)
    shown = F.when(F.col("success"), F.col("result_preview"))
    return found.to_df(spark).select("ordinal", "step", "success", F.col("failure.kind").alias("kind"), shown.alias("preview"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def spilled_between_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = plans.step(lambda: sources.spill(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))))
    return last(kept >> sources.materialize_table, spark)


@query("SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def large_value_between_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain value over the threshold lies in a file between two steps."""
    keys = plans.step(lambda: [r[0] for r in table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey").distinct().collect()])
    found = plans.run(keys >> (lambda v: spark.createDataFrame([(len(v), sum(v))], "n long, total long")), spark, raise_on_failure=True, spill_threshold=500)
    if not isinstance(found[0].result, sources.SpilledValue):
        raise AssertionError("the value was not spilled")
    return found.last


@query("SELECT event_id || chr(9) || CAST(floor(value) AS INT) AS value FROM events WHERE floor(value) > 50")
def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat_ws("\t", "event_id", F.floor("value").cast("int")).alias("value"))
    return operators.field_above(lines, 2, 50)


@query("SELECT f AS file, count(*) AS lines, min(v) AS first, max(v) AS last FROM (SELECT v, (row_number() OVER (ORDER BY v) - 1) // 99 AS f FROM (SELECT c_name AS v FROM customer)) GROUP BY f")
def sorted_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted lines in files of exactly 99, but for the last: what each file has."""
    folder = scratch(spark, "split")
    operators.split_files(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), folder, 99)
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("name"))
    files = lines.groupBy("name").agg(F.count("*").alias("lines"), F.min("value").alias("first"), F.max("value").alias("last"))
    return files.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("file"), "lines", "first", "last")  # a row per file


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem")
def global_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return operators.with_ordinals(lines, "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("SELECT l_orderkey, count(*) AS lines, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag) AS modes, CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS squares FROM lineitem GROUP BY 1")
def foreach_table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of Python per order, all orders in one plan."""

    def block(item: dict[str, Any], pieces: Any) -> list[dict[str, Any]]:
        rows = sorted((r["l_linenumber"], r["l_returnflag"]) for t in pieces for r in t.to_pylist())
        return [{**item, "lines": len(rows), "modes": ">".join(m for _, m in rows), "squares": sum(n * n for n, _ in rows)}]

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return last(plans.for_each(items, operators.TableBlock(("l_orderkey",), block, "l_orderkey long, lines long, modes string, squares long", whole=True)), spark)


@query("SELECT l_returnflag, k AS place, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k <= 3")
def reduce_custom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold of the user's own: the three dearest lines of each flag and how many there are."""
    import heapq

    def add(state: Any, rows: Any) -> Any:
        n, best = state or (0, [])
        found = zip((-p for p in rows["l_extendedprice"].to_pylist()), rows["l_orderkey"].to_pylist(), rows["l_linenumber"].to_pylist())
        return n + rows.num_rows, heapq.nsmallest(3, [*best, *found])

    def merge(a: Any, b: Any) -> Any:
        return a[0] + b[0], heapq.nsmallest(3, [*a[1], *b[1]])

    def finish(item: dict[str, Any], state: Any) -> list[dict[str, Any]]:
        return [{**item, "place": i, "l_orderkey": o, "l_linenumber": k, "n": state[0]} for i, (_, o, k) in enumerate(state[1], 1)]

    def part(low: bool) -> plans.Step:
        lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
        return plans.step(lambda: lines.where(F.col("l_linenumber") <= 3 if low else F.col("l_linenumber") > 3))

    dearest = operators.Fold(add, merge, finish, "l_returnflag string, place long, l_orderkey long, l_linenumber long, n long", ("l_returnflag",))
    return last(plans.Reduce(dearest, part(True) & part(False)), spark)


@query(
    "WITH t AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'csv' ELSE 'txt' END AS kind FROM lineitem) SELECT 'in/' || l_suppkey || '/' || l_returnflag || '/' || l_linenumber || '.' || kind AS target, "
    "CASE WHEN kind = 'txt' AND l_suppkey % 3 <> 0 THEN 'any text' WHEN l_suppkey % 3 = 0 THEN 'of ' || l_suppkey ELSE 'any' END AS name FROM t"
)
def rules_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of many path patterns that matches each target: a rule per supplier, and
    rules without a literal segment behind them."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber").distinct()
    kind = F.when(F.col("l_linenumber") % 2 == 0, "csv").otherwise("txt")
    targets = lines.select(F.concat_ws("/", F.lit("in"), "l_suppkey", "l_returnflag", F.concat("l_linenumber", F.lit("."), kind)).alias("target"))
    own = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("of "), "s_suppkey").alias("name"), F.concat(F.lit("in/"), "s_suppkey", F.lit("/{mode}/{line}")).alias("pattern"), F.lit(1).alias("position"))
    general = spark.createDataFrame([("any text", "{a}/{b}/{mode}/{line}.txt", 2), ("any", "{a}/{b}/{mode}/{line}", 3), ("never", "{a}/{b}", 0)], "name string, pattern string, position int")
    return operators.first_rule(targets, "target", own.union(general), "pattern", "position").select("target", "name")


@query("SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS step_hash FROM lineitem WHERE l_orderkey * 8 + l_linenumber NOT IN (SELECT l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_shipdate <= DATE '1996-01-01')")
def state_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a table that no run has completed: marked, compacted and asked for on executors."""
    steps = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("step_hash"), "l_shipdate")
    kept = plans.StateTable(spark, f"{scratch(spark, 'pending')}/state")
    kept.append_table(steps.where("l_shipdate <= DATE '1996-01-01'"))
    kept.compact()
    return kept.pending(steps).select("step_hash")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS k FROM customer) WHERE k = 1")
def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.last_by(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", "c_name"), ["c_mktsegment"], ["c_acctbal", "c_custkey"])


@query("SELECT 'A' AS branch, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'R', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def per_branch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algebra over tables alone: branches as filters, one function of each."""
    lines = table(spark, sf_dir, "lineitem")
    return operators.per_branch({f: lines.where(F.col("l_returnflag") == f) for f in "AR"}, lambda df: df.agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- views of runs, archives, streams of rules


@query("SELECT 'clean ' || r_name AS step, 'raw/' || r_name AS input, 'out/' || r_name AS output FROM region")
def dry_run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would execute, as a table; nothing runs."""
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    fan = plans.Parallel.of(*(plans.step(lambda: None, name=f"clean {n}", inputs=f"raw/{n}", outputs=f"out/{n}") for n in names))
    found = plans.run(fan, spark, dry_run=True).plan_df(spark)
    return found.select("step", F.col("inputs")[0].alias("input"), F.col("outputs")[0].alias("output"))


@query("SELECT 'nation' AS step, count(*) AS n, 3 AS total FROM nation UNION ALL SELECT 'region', count(*), 3 FROM region UNION ALL SELECT 'supplier', count(*), 3 FROM supplier")
def rows_while_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each declared output, counted as it was written, and how many steps there were."""
    folder = scratch(spark, "counts")
    parts = [plans.step(lambda n=n: table(spark, sf_dir, n), name=n, outputs=f"{folder}/{n}.parquet") for n in ("nation", "region", "supplier")]
    found = plans.run(plans.Parallel.of(*parts), spark, raise_on_failure=True).to_df(spark)
    return found.where("bytes > 0 AND done BETWEEN 1 AND total").select("step", F.col("rows").alias("n"), "total")


@query("SELECT sum(done)::BIGINT AS done, max(total)::BIGINT AS total FROM (SELECT row_number() OVER () AS done, count(*) OVER () AS total FROM region)")
def progress_of_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    found = plans.run(plans.for_each(names, lambda n: plans.step(lambda: n.lower(), name=n)), spark, raise_on_failure=True)
    return found.to_df(spark).agg(F.sum("done").alias("done"), F.max("total").cast("long").alias("total"))


@query("SELECT 'sums of ' || n_name AS text, true AS called FROM nation WHERE n_regionkey = 1")
def report_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results that a report gets, before the state is saved."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name").collect()]
    seen: list[tuple[str, bool]] = []
    fan = plans.Parallel.of(*(plans.step(lambda n=n: f"sums of {n}", name=n) for n in names))
    plans.run(plans.Pipeline(fan, "sums"), spark, report=lambda results, pipeline: seen.extend((r.result, pipeline == "sums") for r in results))
    return spark.createDataFrame(seen, "text string, called boolean")


@query("SELECT n, CASE n WHEN 1 THEN 'Parallel' WHEN 2 THEN '├─ ' || a || ': <lambda>' WHEN 3 THEN '└─ ' || b || ': <lambda>' END AS line FROM (SELECT min(r_name) AS a, max(r_name) AS b FROM region), (VALUES (1), (2), (3)) v(n)")
def printed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "region").agg(F.min("r_name").alias("a"), F.max("r_name").alias("b")).first()
    tree = plans.dag(plans.step(lambda: 1, name=ends["a"]) & plans.step(lambda: 2, name=ends["b"])).splitlines()
    return spark.createDataFrame([(i, line) for i, line in enumerate(tree, 1)], "n int, line string")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def step_with_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step whose paths have wildcards is a rule: here a copy of each table folder."""
    folder = scratch(spark, "copies")
    _segments(spark, sf_dir, f"{folder}/raw", "csv")
    local = sources.local_path(folder)
    copy = plans.shell(f"mkdir -p '{local}/copy' && cp -r '{{input}}' '{{output}}'", name="copy", inputs=f"{local}/raw/{{segment}}.csv", outputs=f"{local}/copy/{{segment}}.csv")
    rule = plans.Rule(copy.name, copy.inputs, copy.outputs, copy.work.command)
    plans.run(rule, spark, raise_on_failure=True)
    found = sources.read_pattern(spark, f"{local}/copy/{{segment}}.csv/{{part}}.csv", "csv", header=True, schema="c_custkey long, c_nationkey int, c_acctbal double")
    return found.groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT 'in/' || n_name AS input, 'out/' || n_name || '.' || n_regionkey AS output, 1 AS runnable FROM nation")
def check_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule's preview for each target that is named; nothing runs, no file is looked for."""
    rule = plans.rule("in/{name}", "out/{name}.{region}", name="part")("cut {input} > {output}")
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect():
        found = plans.check(rule, f"out/{r['n_name']}.{r['n_regionkey']}")
        rows.append((found.previews[0].inputs[0], found.previews[0].outputs[0], found.runnable))
    return spark.createDataFrame(rows, "input string, output string, runnable int")


@query("SELECT LEAST(count(DISTINCT c_mktsegment), 3) AS shown, count(DISTINCT c_mktsegment) AS runnable FROM customer")
def preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "limit")
    _segments(spark, sf_dir, f"{folder}/raw")
    found = plans.check(_keep_rich(spark, folder), limit=3)
    return spark.createDataFrame([(len(found.previews), found.runnable)], "shown long, runnable long")


@query("SELECT string_agg(p, chr(10) ORDER BY p) AS summary FROM (SELECT DISTINCT 'sums/' || c_mktsegment || '.parquet' AS p FROM customer)")
def summary_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a chain has made, sorted, as one text in a file."""
    folder = scratch(spark, "summary")
    _segments(spark, sf_dir, f"{folder}/raw")
    sink = lambda paths: spark.createDataFrame([(p.removeprefix(f"{folder}/"),) for p in paths], "p string")
    made = plans.run(_keep_rich(spark, folder).then(_summed(spark, folder)).then(sink), spark, raise_on_failure=True).last
    made.agg(F.array_join(F.array_sort(F.collect_list("p")), "\n").alias("value")).write.text(f"{folder}/summary")  # a name per file
    return spark.read.text(f"{folder}/summary", wholetext=True).select(F.rtrim(F.regexp_replace("value", r"\n$", "")).alias("summary"))


@query("SELECT count(DISTINCT p_brand)::BIGINT AS lines FROM part")
def commands_in_a_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands joined by one pipe; the last one's output is the value."""
    folder = scratch(spark, "pipe")
    table(spark, sf_dir, "part").select("p_brand").write.text(folder)
    found = plans.run(plans.shell_pipe(f"cat '{sources.local_path(folder)}'/part-*", "sort -u", "wc -l"), spark, raise_on_failure=True)
    return spark.createDataFrame([(int(found.last),)], "lines long")


@query("SELECT r_name AS name, 1 AS alone, 2 AS fed FROM region")
def memo_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that two nodes share runs once; one that is fed runs for each input."""
    rows = []
    for r in table(spark, sf_dir, "region").select("r_name").collect():
        alone, fed = [], []
        base = plans.step(lambda: alone.append(1) or r["r_name"], name="base")
        double = plans.step(lambda x: fed.append(x) or x, name="double")
        plans.run((base >> double) & (base >> double), spark, raise_on_failure=True)
        rows.append((r["r_name"], len(alone), len(fed)))
    return spark.createDataFrame(rows, "name string, alone int, fed int")


@query("SELECT c_mktsegment AS segment, count(*) AS n, sum(strlen(c_name || ',' || c_custkey) + 1)::BIGINT AS bytes FROM customer GROUP BY 1")
def archives_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per segment into tar archives, and their members read again by the headers' index."""
    folder = scratch(spark, "tar")
    line = F.concat("c_name", F.lit(","), F.col("c_custkey").cast("string"))
    made = table(spark, sf_dir, "customer").groupBy(F.concat("c_mktsegment", F.lit(".csv")).alias("name")).agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\n")).cast("binary").alias("content"))  # of a sample table's few files
    sources.write_tars(made, folder).collect()
    found = sources.read_tar(spark, folder)
    text = F.decode("content", "UTF-8")
    return found.select(F.regexp_extract("name", r"^(.*)\.csv$", 1).alias("segment"), F.regexp_count(text, F.lit("\n")).cast("long").alias("n"), "size").groupBy("segment").agg(F.sum("n").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def rules_on_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of rules over a folder that grows between three runs: each target once."""
    folder = scratch(spark, "rules-stream")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    names = sorted(r["segment"] for r in customers.select("segment").distinct().collect())
    chain = _keep_rich(spark, folder).then(_summed(spark, folder))
    for some in (names[:2], names[2:], []):
        if some:
            sources.write_keyed(customers.where(F.col("segment").isin(some)), f"{folder}/raw/{{segment}}.parquet", [{"segment": n} for n in some])
        streaming.make_from_new_files(spark, chain, f"{folder}/seen")
    return _sums(spark, folder)


@query("SELECT n_regionkey AS region, n_name AS name, CAST(n_nationkey AS VARCHAR) AS content FROM nation WHERE n_regionkey IN (1, 3)")
def files_as_a_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``format("pattern")``: a condition on a wildcard lists and opens only what it needs."""
    folder = sources.local_path(scratch(spark, "format"))
    nations = table(spark, sf_dir, "nation").select(F.concat("n_regionkey", F.lit("/"), "n_name").alias("k"), F.col("n_nationkey").cast("string").alias("value"))
    split = F.split("k", "/")
    keyed = nations.select(split[0].alias("region"), split[1].alias("name"), "value")
    sources.write_keyed(keyed, f"{folder}/{{region}}/{{name}}.txt", [r.asDict() for r in keyed.select("region", "name").collect()])
    sources.register_pattern(spark)
    found = spark.read.format("pattern").load(f"{folder}/{{region}}/{{name}}.txt/{{part}}.txt").where(F.col("region").isin("1", "3"))
    return found.select(F.col("region").cast("int").alias("region"), "name", F.trim(F.regexp_replace(F.decode("content", "UTF-8"), r"\n", "")).alias("content"))


@query(_BY_SEGMENT)
def foreach_pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of Python per file of a pattern, all files in one scan."""
    folder = scratch(spark, "files")
    _segments(spark, sf_dir, folder)

    def block(item: dict[str, Any], pieces: Any) -> list[dict[str, Any]]:
        balances = [x for t in pieces for x in t["c_acctbal"].to_pylist()]
        return [{**item, "n": len(balances), "balance": round(math.fsum(balances), 2)}]

    return last(plans.for_each(f"{folder}/{{segment}}.parquet", operators.TableBlock((), block, "segment string, n long, balance double", whole=True)), spark)


@query("SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 3 ELSE 4 END AS steps FROM region")
def counted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a run can execute: of a branch the larger arm, a shared step once, a reduce one more."""
    rows = []
    for r in table(spark, sf_dir, "region").select("r_name", "r_regionkey").collect():
        base = plans.step(lambda: 1, name=r["r_name"])
        large = plans.step(lambda x: x) >> plans.step(lambda x: x)
        tail = plans.branch(lambda x: True, large, plans.step(lambda x: x))
        node = base >> tail if r["r_regionkey"] % 2 == 0 else plans.Reduce(len, (base >> tail) & base)
        rows.append((r["r_name"], plans.count_steps(node)))
    return spark.createDataFrame(rows, "name string, steps int")


@query("SELECT count(*) AS lines, sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part")
def spilled_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command's output over the threshold lies in a file, and can be read twice."""
    folder = scratch(spark, "output")
    table(spark, sf_dir, "part").select("p_name").write.text(folder)
    found = plans.run(plans.shell(f"cat '{sources.local_path(folder)}'/part-*"), spark, raise_on_failure=True, spill_threshold=100)
    if not isinstance(found.last, sources.SpilledText):
        raise AssertionError("the output was not spilled")
    lines, text = (sources.materialize(found.last) for _ in range(2))
    return spark.createDataFrame([(lines.count("\n"), len(text.encode()))], "lines long, bytes long")


@dataclass(frozen=True)
class _Sampled:
    """Work of a type of its own: every so-manieth row of a table by a key."""

    rows: DataFrame
    key: str
    every: int


@plans.execute.register
def _(work: _Sampled, step: plans.Step, ctx: Any, value: Any) -> DataFrame:
    return work.rows.where(F.col(work.key) % work.every == 0)


@dataclass(frozen=True, eq=False)
class _Twice(plans.Node):
    """A node of a type of its own: runs another one, and gives its rows twice."""

    node: plans.Node

    def children(self) -> tuple[plans.Node, ...]:
        return (self.node,)


@plans.run_node.register
def _(node: _Twice, ctx: Any, forced: bool, value: Any) -> Any:
    found = plans.run_node(node.node, ctx, forced, value)
    again = found[-1].result.unionAll(found[-1].result)
    return type(found)([*found, plans.StepResult("twice", True, 0.0, again)])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def own_work_and_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algebra extended by a work type and a node type."""
    sampled = plans.step(_Sampled(table(spark, sf_dir, "orders"), "o_orderkey", 7), name="every seventh")
    return last(_Twice(sampled) >> (lambda df: df.select("o_orderkey")), spark)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'part' ELSE 'lane,part' END AS missing FROM part")
def unbound_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards of inputs that the outputs lack: what a rule may not have."""
    kind = F.col("p_size") % 3
    inputs = F.when(kind < 2, "in/{part}.csv").otherwise("in/{lane}/{part}.csv")
    outputs = F.when(kind == 0, "out/{part}/{x}.csv").otherwise("out/{x}.csv")
    missing = F.array_except(functions.wildcards_column(inputs), functions.wildcards_column(outputs))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(missing), ",").alias("missing"))


@query("SELECT n_name AS name, true AS same FROM nation")
def values_stand_for_themselves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a value stands for: plain values are themselves, a path its bytes."""
    folder = scratch(spark, "values")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("value"))
    values = [r.asDict() for r in names.collect()]
    sources.write_keyed(names, f"{folder}/{{name}}.txt", values)
    paths = {v["name"]: path for path, v in sources.find_matches(f"{folder}/{{name}}.txt/{{part}}.txt")}
    rows = [(n, sources.materialize(n) == n and sources.materialize(sources.FilePath(paths[n])) == f"{n}\n".encode()) for n in (v["name"] for v in values)]
    return spark.createDataFrame(rows, "name string, same boolean")
