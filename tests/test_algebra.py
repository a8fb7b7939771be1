"""Composition, control flow, sharing, budgets: driver-side semantics."""

import threading
import time

import pytest

import braidflow as b
from braidflow.plans.executor import Cycle
from braidflow.plans.nodes import Fallback


def values(results):
    return [r.result for r in results]


def kinds(results):
    return [r.failure and r.failure.kind for r in results]


def test_sequence_passes_the_last_value_and_stops_at_a_failure():
    seen = []
    r = b.run(b.step(lambda: 2) >> (lambda x: x * 5) >> (lambda x: seen.append(x) or x))
    assert values(r) == [2, 10, 10] and seen == [10]
    r = b.run(b.step(lambda: 1 / 0) >> (lambda x: seen.append("never")))
    assert len(r) == 1 and kinds(r) == ["exception"] and seen == [10] and not r.success


def test_operators_flatten_and_fallback_nests_to_the_right():
    x, y, z = (b.step(lambda: 0, name=n) for n in "xyz")
    assert len(((x >> y) >> z).nodes) == len((x >> (y >> z)).nodes) == 3
    assert len(((x & y) & z).nodes) == 3
    f = (x | y) | z
    assert isinstance(f, Fallback) and isinstance(f.otherwise, Fallback)


def test_parallel_keeps_branch_order_and_gives_no_input():
    slow = b.step(lambda: time.sleep(0.15) or "slow")
    quick = b.step(lambda: "quick")
    r = b.run(b.step(lambda: "up") >> (slow & quick))
    assert values(r) == ["up", "slow", "quick"]
    r = b.run((b.step(lambda: 1 / 0) & quick) >> (lambda x: x))
    assert kinds(r) == ["exception", None]


def test_parallel_runs_at_once():
    began = time.monotonic()
    b.run((b.step(lambda: time.sleep(0.2)) & (lambda: time.sleep(0.2)) & (lambda: time.sleep(0.2))) >> (lambda x: x), jobs=4)
    assert time.monotonic() - began < 0.5


def test_pipe_collects_all_and_sequence_only_the_last():
    both = b.step(lambda: 1) & (lambda: 2)
    assert b.run(both.pipe(lambda xs: sum(xs))).last == 3
    assert b.run(both >> (lambda x: x)).last == 2
    assert b.run(b.step(lambda: 4).pipe(lambda x: x)).last == 4
    chain = b.step(lambda: 1) >> (lambda x: x + 1)
    assert b.run(chain.pipe(lambda xs: xs)).last == [1, 2]
    assert b.run(chain.pipe(lambda xs: xs, terminal_only=True)).last == 2


def test_same_input_gives_both_the_upstream_value():
    r = b.run(b.step(lambda: 7) >> b.step(lambda x: x + 1).same_input(lambda x: x * 2))
    assert values(r) == [7, 8, 14]
    assert len(b.run(b.step(lambda: 1 / 0).same_input(lambda: 1))) == 1


def test_broadcast_is_once_per_branch_and_associative():
    fan = b.for_each(["a", "b"], lambda x: lambda: x)
    assert values(b.run(fan.broadcast(lambda x: x + "1").broadcast(lambda x: x + "2"))) == ["a", "a1", "a12", "b", "b1", "b12"]
    assert values(b.run((b.step(lambda: 1) & (lambda: 2)).broadcast(lambda x: -x))) == [1, -1, 2, -2]
    assert values(b.run(b.step(lambda: 3).broadcast(lambda x: -x))) == [3, -3]


def test_retry_returns_the_last_attempt_only():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return f"ok-on-attempt-{len(calls)}"

    r = b.run(b.step(flaky) ** 3)
    assert values(r) == ["ok-on-attempt-3"]
    r = b.run(b.Retry(b.step(lambda: 1 / 0), 2, delay=0.01))
    assert len(r) == 1 and not r.success


def test_fallback_discards_the_primary():
    r = b.run(b.step(lambda: 1 / 0) | (lambda: 1 / 0) | (lambda: "third"))
    assert values(r) == ["third"]


def test_branch_sees_the_value_and_wants_a_bool():
    big, small = b.step(lambda x: f"big {x}"), b.step(lambda x: f"small {x}")
    assert b.run(b.step(lambda: 9) >> b.branch(lambda x: x > 5, big, small)).last == "big 9"
    assert b.run(b.branch(lambda: False, lambda: 1, lambda: 2)).last == 2
    with pytest.raises(TypeError):
        b.run(b.branch(lambda: 1, lambda: 1, lambda: 2))


def test_timeout_and_what_is_thrown_inside():
    r = b.run(b.Timeout(b.step(lambda: time.sleep(5)), 0.1))
    assert kinds(r) == ["timed_out"]
    assert b.run(b.Timeout(b.step(lambda: 5), 5)).last == 5
    r = b.run(b.Timeout(b.branch(lambda: 1, lambda: 1, lambda: 2), 5))
    assert kinds(r) == ["inner_exception"]


def test_reduce_folds_results_and_aborts_on_failure():
    fan = b.for_each([1, 2, 3], lambda x: lambda: x)
    assert b.run(b.Reduce(sum, fan)).last == 6
    assert b.run(b.Reduce(len, fan)).last == 3
    r = b.run(b.Reduce(sum, b.step(lambda: 1) & (lambda: 1 / 0)))
    assert r[-1].result == "Reduce aborted: upstream failed" and not r.success
    assert b.run(b.Reduce(lambda v: 1 / 0, fan))[-1].result.startswith("Reduce error: ZeroDivisionError")


def test_for_each_of_items_and_nothing():
    nested = b.for_each(["a", "b"], lambda s: b.for_each([10, 20], lambda n: lambda: f"{s}_{n}"))
    assert values(b.run(nested)) == ["a_10", "a_20", "b_10", "b_20"]
    assert kinds(b.run(b.for_each([], lambda x: x))) == ["no_matches"]
    assert kinds(b.run(b.for_each([], lambda x: x).broadcast(lambda x: x))) == ["no_matches"]
    assert len(b.run(b.NoWork() >> (lambda: 1))) == 1


def test_for_each_pattern(tmp_path):
    for p in "AB":
        (tmp_path / f"project{p}").mkdir()
        for s in (1, 2):
            (tmp_path / f"project{p}/sample{s}.csv").write_text("x")
    r = b.run(b.for_each(f"{tmp_path}/{{project}}/{{sample}}.csv", lambda p, s: lambda: f"{p}/{s}"))
    assert values(r) == ["projectA/sample1", "projectA/sample2", "projectB/sample1", "projectB/sample2"]
    assert kinds(b.run(b.for_each(f"{tmp_path}/{{x}}_none.xyz", lambda x: lambda: x))) == ["no_matches"]
    with pytest.raises(ValueError):
        b.for_each("no-wildcard.csv", lambda x: x)


def test_a_shared_step_runs_once_even_if_it_fails():
    calls = []
    shared = b.step(lambda: calls.append(1) or "v")
    r = b.run((shared >> (lambda x: x + "1")) & (shared >> (lambda x: x + "2")))
    assert len(calls) == 1 and values(r) == ["v", "v1", "v", "v2"]
    failing = b.step(lambda: calls.append(2) or 1 / 0)
    b.run(failing & failing)
    assert calls.count(2) == 1


def test_a_step_can_wrap_a_node():
    inner = b.step(lambda: 1) >> (lambda x: x + 1)
    assert values(b.run(b.step(inner, name="named"))) == [1, 2]
    assert b.run(b.with_resources(b.step(inner, name="named"), memory_mb=5)).last == 2


def peak(run):
    now, most, lock = [0], [0], threading.Lock()

    def work():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1

    assert run(work).success
    return most[0]


def test_budgets_bound_concurrency():
    def four(memory, threads):
        return lambda work: b.run(b.for_each([1, 2, 3, 4], lambda i: b.with_resources(lambda: work(), memory_mb=memory, threads=threads)), memory_mb=1000, threads=4, jobs=8)

    assert peak(four(600, 1)) == 1
    assert peak(four(400, 2)) == 2
    assert peak(four(5000, 1)) == 1
    nested = lambda work: b.run(b.with_resources(b.with_resources(lambda: work(), memory_mb=800), memory_mb=800), memory_mb=1000)
    assert peak(nested) == 1
    assert peak(lambda work: b.run(b.for_each(range(6), lambda i: lambda: work()), jobs=2)) == 2


def test_shell_steps_and_failures(tmp_path):
    assert b.run(b.shell("printf 'b\\na\\nc\\n' | sort")).last == "a\nb\nc\n"
    assert b.run(b.shell_pipe("printf 'x\\nx\\n'", "uniq", "wc -l")).last.strip() == "1"
    r = b.run(b.shell("echo bad >&2; exit 3"))
    assert kinds(r) == ["process_failed"] and "bad" in r[0].failure.detail
    assert b.run(b.shell(lambda: "echo late")).last == "late\n"
    assert kinds(b.run(b.shell(lambda: 1 / 0))) == ["exception"]
    r = b.run(b.step(lambda: 1, inputs=str(tmp_path / "none")))
    assert kinds(r) == ["missing_input"]
    r = b.run(b.step(lambda: 1, outputs=str(tmp_path / "none")))
    assert kinds(r) == ["missing_output"]
    assert kinds(b.run(b.Step(42, "odd"))) == ["invalid_step_work"]


def test_long_output_is_spilled_and_readable_twice(tmp_path):
    r = b.run(b.shell("head -c 200000 /dev/zero | tr '\\0' x"), spill_threshold=1024, spill_dir=str(tmp_path))
    assert len(b.materialize(r.last)) == 200_000 and len(b.materialize(r.last)) == 200_000
    assert b.run(b.shell("echo hi"), spill_threshold=1024, spill_dir=str(tmp_path)).last == "hi\n"


def test_declared_outputs_are_what_is_passed_on(tmp_path):
    out = str(tmp_path / "data.tsv")
    seen = []
    b.run(b.shell(f"echo row > {out}", outputs=out) >> (lambda paths: seen.append(paths)), force=True)
    assert seen == [[out]]


def test_counts_dry_run_display_and_errors(capsys):
    x, y = b.step(lambda: 1, name="x"), b.step(lambda: 2, name="y")
    assert b.count_steps((x >> y) & x) == 2 and len(b.steps((x >> y) & x)) == 2
    assert b.count_steps(b.branch(lambda: True, x >> y, x)) == 2
    assert b.count_steps(b.Reduce(len, x & y)) == 3 and b.count_steps(b.for_each([1], lambda i: x)) == 0
    called = []
    assert b.run(b.step(lambda: called.append(1)), dry_run=True, verbose=True) == [] and not called
    text = b.dag((x >> y) | b.Timeout(x**2, 3))
    assert "Fallback" in text and "Retry x2" in text and "x: <lambda>" in text
    with pytest.raises(b.PipelineError):
        b.run(b.step(lambda: 1 / 0), raise_on_failure=True)
    wide = b.Parallel.of(*(b.step(lambda i=i: i) for i in range(100)))
    assert b.count_steps(wide) == 100
    loop = b.for_each([1], lambda i: loop)
    with pytest.raises(Cycle):
        b.run(loop)


def test_report_gets_the_results():
    seen = []
    b.run(b.Pipeline(b.step(lambda: 1), "mine"), report=lambda results, pipeline: seen.append((len(results), pipeline)))
    assert seen == [(1, "mine")]


def test_nested_requests_share_what_the_outer_one_was_granted():
    def branches(n, memory):
        return lambda work: b.for_each(range(n), lambda i: b.with_resources(lambda: work(), memory_mb=memory))

    def nested(outer, inner, n=4, **budget):
        return peak(lambda work: b.run(b.with_resources(branches(n, inner)(work), memory_mb=outer), jobs=8, **budget))

    assert nested(600, 600, memory_mb=1000) == 1
    assert nested(1000, 500, memory_mb=1000, threads=8) == 1  # one thread was granted to them all
    assert peak(lambda work: b.run(b.with_resources(branches(4, 500)(work), memory_mb=1000, threads=4), memory_mb=1000, threads=8, jobs=8)) == 2
    assert nested(0, 600, memory_mb=1000) == 1  # the outer takes what is asked for inside
    both = lambda work: b.with_resources(b.with_resources(lambda: work(), memory_mb=600) & b.with_resources(lambda: work(), memory_mb=600), memory_mb=100)
    two = lambda work: b.run(both(work) & both(work), memory_mb=1000, jobs=8)
    assert peak(two) == 1
    late = lambda work: b.run(b.for_each([1, 2], lambda i: b.with_resources(b.for_each([1, 2], lambda j: b.with_resources(lambda: work(), memory_mb=900)), memory_mb=500)), memory_mb=1000, jobs=8)
    assert peak(late) == 2  # cut down to the grant of their own branch


def test_budgets_are_given_back_after_a_throw():
    bad = b.with_resources(b.branch(lambda: 1 / 0, lambda: 1, lambda: 2), memory_mb=1000, threads=2)
    good = b.with_resources(lambda: "ok", memory_mb=1000, threads=2)
    r = b.run(bad & good, memory_mb=1000, threads=2, jobs=2)
    assert kinds(r) == ["resource_exception", None] and r.last == "ok"


def test_nothing_goes_on_after_a_timeout(tmp_path):
    seen = []

    def slow():
        for _ in range(100):
            time.sleep(0.02)
        seen.append("python")

    command = b.shell(f"sleep 1; echo x > {tmp_path}/late; sleep 1 | cat")
    chain = (b.step(slow) & command & b.for_each([1], lambda i: slow)) >> (lambda x: seen.append("next"))
    began = time.monotonic()
    r = b.run(b.Timeout(chain, 0.3), jobs=8)
    assert kinds(r) == ["timed_out"] and time.monotonic() - began < 1
    time.sleep(2.5)
    assert seen == [] and not (tmp_path / "late").exists()
    inner = b.run(b.Timeout(b.Timeout(slow_step(seen), 0.2) | (lambda: "instead"), 5))
    assert inner.last == "instead"
    r = b.run(b.Timeout(b.Timeout(slow_step(seen), 5), 0.2))
    assert kinds(r) == ["timed_out"]
    time.sleep(1.2)
    assert seen == []


def slow_step(seen):
    return b.step(lambda: [time.sleep(0.05) for _ in range(20)] and seen.append("slow"))


def test_a_step_shared_with_a_timed_branch_is_not_lost():
    shared = b.step(lambda: [time.sleep(0.02) for _ in range(40)] and "v")
    r = b.run(b.Timeout(shared, 0.2) & (b.step(lambda: time.sleep(0.05)) >> b.NoWork() >> shared), jobs=4)
    assert "timed_out" in kinds(r)


def test_large_values_are_kept_in_files(tmp_path):
    big = list(range(300_000))
    r = b.run(b.step(lambda: big) >> len, spill_threshold=1_000_000, spill_dir=str(tmp_path))
    assert type(r[0].result).__name__ == "SpilledValue" and b.materialize(r[0].result) == big and r.last == 300_000
    assert len(list(tmp_path.iterdir())) == 1
    assert b.run(b.step(lambda: [1, 2, 3]), spill_threshold=1, spill_dir=str(tmp_path))[0].result != [1, 2, 3]
    r = b.run(b.step(lambda: [1, 2, 3]) & (lambda: big), spill_threshold=1_000_000, spill_dir=str(tmp_path))
    assert r[0].result == [1, 2, 3]
    fan = b.for_each([1, 2], lambda i: lambda: big)
    assert b.run(b.Reduce(lambda v: sum(map(len, v)), fan), spill_threshold=1_000_000, spill_dir=str(tmp_path)).last == 600_000
    assert b.run(fan.pipe(lambda v: sum(map(len, v))), spill_threshold=1_000_000, spill_dir=str(tmp_path)).last == 600_000
    assert b.run(b.step(lambda: big), auto_spill=False).last == big
    never = b.run(b.step(lambda: [lambda: 1] * 300_000), spill_threshold=1_000_000, spill_dir=str(tmp_path))
    assert len(never.last) == 300_000


def test_progress_of_branches(capsys):
    b.run(b.for_each([1, 2, 3], lambda i: lambda: i), verbose=True, jobs=2)
    out = capsys.readouterr().out
    assert "1/3 branches done, 2 left" in out and "3/3 branches done\n" in out
