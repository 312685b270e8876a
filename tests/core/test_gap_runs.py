import random
from datetime import datetime, timedelta, timezone

import pytest

from attesta.operators import gap_runs as gr
from attesta.streaming import gap_state as gs

NOW = datetime(2026, 8, 26, 4, 0, tzinfo=timezone.utc)
PLAN = "company_id string, gap_id string, disposition string, action_kind string, locator string, input_ids array<string>, max_attempts int, min_interval_seconds int, action_id string, cache_key string, reason string"


def action(i, company="c", cache=None, kind="GO", attempts=3, interval=60, gap=None, disposition="READY"):
    ready = disposition == "READY"
    return (company, gap or f"g{i}", disposition, kind if ready else None, None, [], attempts, interval, f"a{i}", (cache or f"k{i}") if ready else None, "why not")


def loop(plan, state, results, handled, now):
    """One batch, action by action: the plain form. results: (action, try) that succeed; state: key -> [succeeded, last, tries]."""
    out = {}
    for company, gap, disposition, kind, _, _, most, interval, name, key, reason in sorted(plan, key=lambda a: (a[1], a[2], a[3] or "", a[4] or "", a[8])):
        own = state.get(key, [False, None, 0])
        wait = timedelta(seconds=interval)
        if disposition == "BLOCKED":
            out[name] = ("BLOCKED", 0, reason, None)
        elif key is None or most < 1:
            out[name] = ("BLOCKED", 0, gr.REASONS["malformed"], None)
        elif own[0]:
            out[name] = ("CACHE_HIT", 0, gr.REASONS["cached"], None)
        elif own[1] is not None and interval > 0 and now < own[1] + wait:
            out[name] = ("SCHEDULED", 0, gr.REASONS["waits"], own[1] + wait)
        elif kind not in handled:
            out[name] = ("BLOCKED", 0, gr.REASONS["unhandled"], None)
        else:
            before = results["tries"].get(name, 0)
            state[key] = own = [own[0], now, own[2]]
            for n in range(1, most + 1):
                results["tries"][name] = before + n
                own[2] += 1
                if (name, before + n) in results["good"]:
                    own[0] = True
                    out[name] = ("SUCCEEDED", n, gr.REASONS["done"], None)
                    break
            else:
                out[name] = ("FAILED", most, gr.REASONS["failed"] + "no response", now + wait if interval else None)
    return out


def utc(t):
    return None if t is None else t.astimezone(timezone.utc)


def shown(records):
    return {r.action_id: (r.status, r.attempts, r.reason, utc(r.next_eligible_at)) for r in records.collect()}


def test_two_cycles_equal_the_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    plan = []
    for i in range(60):
        plan.append(action(i, f"c{i % 9}", rng.choice([None, f"shared{i % 20}"]), rng.choice(["GO", "GO", "OTHER"]), rng.choice([0, 1, 2, 3]), rng.choice([0, 60]), disposition=rng.choice(["READY", "READY", "READY", "BLOCKED"])))
    # a key is tried by one action at most in each cycle where tries are captured by action
    seen, single = set(), []
    for a in plan:
        if a[9] is None or a[7] > 0 or a[9] not in seen:
            single.append(a)
            seen.add(a[9])
    good = {(f"a{i}", rng.randint(1, 5)) for i in range(60)}
    tries = spark.createDataFrame([(a, t, True, None) for a, t in good], "action_id string, try int, succeeded boolean, error string")
    runs = gr.Runs(spark, str(tmp_path / "runs"), buckets=2)
    state, results = {}, {"tries": {}, "good": good}
    for n, now in ((1, NOW), (2, NOW + timedelta(seconds=90))):
        rows = spark.createDataFrame(single, PLAN)
        want = loop(single, state, results, {"GO"}, now)
        # the plain loop counts tries by action, the state by key: only keys of one action are compared beyond cycle 1
        got = shown(runs.cycle(n, rows, gr.captured(tries), ["GO"], now))
        lone = {a[8] for a in single if a[9] is None or sum(b[9] == a[9] for b in single) == 1}
        pick = want if n == 1 else {k: v for k, v in want.items() if k in lone}
        assert {k: got[k] for k in pick} == pick
    kept = {r.cache_key: (r.succeeded, utc(r.last_attempt_at), r.attempts) for r in runs.state().collect()}
    assert {k: kept[k] for k in kept if k.startswith("k")} == {k: tuple(v) for k, v in state.items() if k.startswith("k")}
    again = runs.records().count()
    runs.cycle(2, spark.createDataFrame(single, PLAN), gr.captured(tries), ["GO"], NOW + timedelta(seconds=90))
    assert runs.records().count() == again


def test_actions_of_one_key_go_in_order(spark, tmp_path):
    plan = [action(1, cache="s", interval=0, attempts=1), action(2, cache="s", interval=0, attempts=1), action(3, cache="s"), action(4, cache="t"), action(5, cache="t"), action(6, cache="u", interval=0, attempts=2), action(7, cache="u")]
    handler = gr.calling({"GO": lambda a: None if a["action_id"] in ("a2", "a7") else 1 / 0})
    runs = gr.Runs(spark, str(tmp_path / "runs"), buckets=2)
    got = {k: v[:2] for k, v in shown(runs.cycle(1, spark.createDataFrame(plan, PLAN), handler, ["GO"], NOW)).items()}
    assert got == {"a1": ("FAILED", 1), "a2": ("SUCCEEDED", 1), "a3": ("CACHE_HIT", 0), "a4": ("FAILED", 3), "a5": ("SCHEDULED", 0), "a6": ("FAILED", 2), "a7": ("SCHEDULED", 0)}
    reasons = {r.action_id: r.reason for r in runs.records().collect()}
    assert reasons["a4"] == "handler failed after bounded retries: division by zero"


def test_a_time_without_offset_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="offset"):
        gr.Runs(spark, str(tmp_path / "runs"), 2).cycle(1, spark.createDataFrame([], PLAN), gr.calling({}), [], datetime(2026, 1, 1))


def test_companies_leave_a_run_each_for_its_own_reason(spark, tmp_path):
    # need: tries until the gap is closed; an action has one try a cycle
    need = {"none": [], "solved": [1], "later": [1, 2], "stuck": [9], "halts": [1, 9], "long": [1, 2, 3, 9]}
    companies = spark.createDataFrame([(c,) for c in need], "company_id string")
    plan = [action(f"{c}{i}", c, interval=0, attempts=1) for c, own in need.items() for i, _ in enumerate(own)]
    tries = spark.createDataFrame([(f"a{c}{i}", n, True, None) for c, own in need.items() for i, n in enumerate(own)], "action_id string, try int, succeeded boolean, error string")
    runs = gr.Runs(spark, str(tmp_path / "runs"), buckets=2)
    told = []

    def planner():
        solved = runs.state().where("succeeded").select("cache_key")
        left = spark.createDataFrame(plan, PLAN).join(solved, "cache_key", "left_anti")
        return left.select("company_id", "gap_id"), left.select(*[f.split()[0] for f in PLAN.split(", ")])

    times = iter(NOW + timedelta(minutes=i) for i in range(9))
    stops = runs.until_stable(companies, planner, gr.captured(tries), ["GO"], lambda: next(times), 3, lambda moved: told.append(sorted(r.company_id for r in moved.collect())))
    assert {r.company_id: (r.stop, r.cycles) for r in stops.collect()} == {
        "none": ("NO_GAPS", 0),
        "solved": ("GAPS_RESOLVED", 1),
        "later": ("GAPS_RESOLVED", 2),
        "stuck": ("NO_PROGRESS_OR_SCHEDULED", 1),
        "halts": ("NO_PROGRESS_OR_SCHEDULED", 2),
        "long": ("MAX_CYCLES_REACHED", 3),
    }
    assert told == [["halts", "later", "long", "solved"], ["later", "long"], ["long"]]
    with pytest.raises(ValueError):
        runs.until_stable(companies, planner, gr.captured(tries), ["GO"], lambda: NOW, 0)


def test_a_stream_keeps_state_and_timers_for_each_key(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gs.PROVIDER)
    t = lambda s: datetime(2026, 1, 1, 0, 0) + timedelta(seconds=s)
    batches = [
        [("k", "a1", t(0), 60, False), ("q", "b1", t(0), 0, True)],
        [("k", "a2", t(10), 60, True), ("q", "b2", t(10), 0, True)],
        [("z", "c1", t(300), 0, False)],
        [("k", "a3", t(400), 60, True), ("z", "c2", t(400), 0, True)],
        [("y", "d1", t(900), 0, True)],
    ]
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, gs.REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = gs.attempted(spark.readStream.schema(gs.REQUEST).parquet(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.cache_key, r.action_id, r.status, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("k", "a1", "FAILED", t(0)) in got and ("k", "a2", "SCHEDULED", t(10)) in got and ("q", "b2", "CACHE_HIT", t(10)) in got
    assert ("k", "a2", "SUCCEEDED", t(60)) in got and ("k", "a3", "CACHE_HIT", t(400)) in got and ("z", "c2", "SUCCEEDED", t(400)) in got
    assert len(got) == 9


def test_a_cycle_goes_over_its_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([action(i) for i in range(20)], PLAN).mapInPandas(counted, PLAN)
    runs = gr.Runs(spark, str(tmp_path / "runs"), buckets=2)
    records = runs.cycle(1, rows, gr.captured(spark.createDataFrame([("a1", 1, True, None)], "action_id string, try int, succeeded boolean, error string")), ["GO"], NOW)
    assert records.count() == 20 and runs.state().count() == 20
    assert seen.value <= 2 * 20  # for the actions, and for the first due one of each key
