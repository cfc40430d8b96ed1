"""The engine's own operators: SQL oracles at the smallest scale, and rules on small tables."""

import dataclasses
import datetime
import itertools
import math
import os
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.functions import codec, domain
from orbweave.functions import geometry as g
from orbweave.operators import detection, encoding, imaging, joint, neighbours, optimum, orbit, prefix, replay, scheduling, statistics
from orbweave.operators.components import connected_components
from orbweave.plans import registry, views
from orbweave.sources import readers


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    rel = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(str([plain(r[i]) for i in order]) for r in rel.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns)
    assert all(any(r[c] is not None for r in rows) for c in got.columns)


def boxes(spark, rows, kind):
    extra = ", conf double" if kind == "det" else ""
    return spark.createDataFrame(rows, f"image long, {kind} long, cx double, cy double, w double, h double{extra}")


def test_matching_rules(spark):
    gts = boxes(spark, [(1, 1, 10.0, 10.0, 10.0, 10.0), (1, 2, 10.0, 10.0, 10.0, 10.0), (2, 1, 50.0, 50.0, 5.0, 5.0)], "gt")
    dets = boxes(spark, [(1, 1, 10.0, 10.0, 10.0, 10.0, 0.9), (1, 2, 10.0, 10.0, 10.0, 10.0, 0.8), (1, 3, 90.0, 90.0, 4.0, 4.0, 0.7)], "det")
    pairs = lambda rule: {(r.det, r.gt) for r in detection.match_greedy(dets, gts, rule).collect()}
    assert pairs("voc") == {(1, 2), (2, 1), (3, None), (None, 1)}
    assert pairs("conf_argmax") == {(1, 1), (2, 2), (3, None), (None, 1)}
    assert pairs("truth_last") == {(2, 1), (1, 2), (3, None), (None, 1)} and pairs("truth_first") == {(1, 1), (2, 2), (3, None), (None, 1)}
    s = detection.scores(detection.match_greedy(dets, gts)).first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 1) and math.isclose(s.f1, 2 / 3)


def test_an_overlap_of_exactly_the_least_is_a_hit(spark):
    gts = boxes(spark, [(1, 1, 5.0, 5.0, 10.0, 10.0)], "gt")
    dets = boxes(spark, [(1, 1, 1.5, 5.0, 3.0, 10.0, 0.9), (1, 2, 1.0, 5.0, 2.0, 10.0, 0.8), (2, 1, 5.0, 5.0, 0.0, 0.0, 0.7)], "det")  # overlaps 0.3, 0.2; no truth
    assert {(r.image, r.det): r.hit for r in detection.match_any(dets, gts).collect()} == {(1, 1): True, (1, 2): False, (2, 1): False}


def test_suppression_thresholds(spark):
    same = boxes(spark, [(1, 1, 10.0, 10.0, 20.0, 10.0, 0.9), (1, 2, 10.0, 10.0, 10.0, 10.0, 0.8)], "det")  # overlap one half
    assert detection.non_maximum(same, 0.5).count() == 1 and detection.non_maximum(same, 0.5, strict=True).count() == 2


def plain_average_precision(dets, truths):
    """``dets``: confidence and whether right, in order; recall and precision curve, envelope, interpolation, trapezoids."""
    if not truths:
        return None
    if not dets:
        return 0.0
    right = np.cumsum([r for _, r in dets])
    recall, precision = [0, *(right / truths), 1], [1, *(right / np.arange(1, len(dets) + 1)), 0]
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return float(np.trapezoid(np.interp(np.linspace(0, 1, 101), recall, envelope), np.linspace(0, 1, 101)))


def test_average_precision(spark):
    schema = "image long, det long, gt long, conf double, iou double"
    ap = lambda rows: detection.average_precision(spark.createDataFrame(rows, schema)).first().ap
    assert math.isclose(ap([(1, 1, 1, 0.9, 1.0), (1, None, 2, None, None)]), 0.75)
    assert math.isclose(ap([(1, 1, 1, 0.9, 1.0)]), plain_average_precision([(0.9, 1)], 1)) and ap([(1, None, 1, None, None)]) == 0.0 and ap([(1, 1, None, 0.5, None)]) is None
    rng = random.Random(7)
    for _ in range(6):
        rows = [(rng.randint(1, 5), i, i if rng.random() < 0.5 else None, rng.choice([0.2, 0.5, rng.random()]), None) for i in range(rng.randint(1, 40))]
        rows += [(9, None, 1000 + i, None, None) for i in range(rng.randint(0, 12))]
        order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[3], r[0], r[1]))
        want = plain_average_precision([(r[3], r[2] is not None) for r in order], sum(r[2] is not None for r in rows))
        assert ap(rows) is want is None or math.isclose(ap(rows), want, abs_tol=1e-9)


def test_suppression_caps(spark):
    many = boxes(spark, [(1, i, 100.0 * i, 5.0, 10.0, 10.0, 1 - i / 100) for i in range(20)], "det")
    assert sorted(r.det for r in detection.non_maximum(many, 0.5, candidates=10, most=4).collect()) == [0, 1, 2, 3]
    assert detection.non_maximum(many, 0.5, candidates=10).count() == 10


def test_running_sums_by_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.uniform(0, 9), i, rng.randint(1, 9)) for i in range(300)]
    got = prefix.prefix_sum(spark.createDataFrame(rows, "g string, t double, id long, v long").withColumn("b", F.floor("t")), ["g"], "b", [F.col("t"), F.col("id")], "v", "run").collect()
    assert all(r.run == sum(x[3] for x in rows if x[0] == r.g and (x[1], x[2]) <= (r.t, r.id)) for r in got) and len(got) == 300


def test_slices(spark):
    count = lambda side, win: spark.range(1).select(F.size(g.slice_origins(F.lit(side).cast("long"), win))).first()[0] ** 2
    assert (count(3072, 768), count(3072, 512), count(500, 768)) == (25, 64, 1)


def test_masks(spark):
    row = spark.createDataFrame([("1 3 11 2", ""), ("9 4", "")], "m string, e string")
    runs = row.select(g.rle_runs(F.col("m")).alias("r"), F.size(g.rle_runs(F.col("e"))).alias("none"))
    got = runs.select("none", *[c.alias(k) for k, c in g.rle_box(F.col("r"), 10).items()]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 2, 3), (0, 0, 0, 2, 10)]


def test_levels_and_boundaries(spark):
    lv = lambda conf, coast, dark: spark.range(1).select(domain.level(F.lit(conf), F.lit(coast), F.lit(dark))).first()[0]
    assert [lv(0.67, False, False), lv(0.66, False, False), lv(0.66, True, False), lv(0.67, False, True), lv(0.2, True, True)] == [1, 2, 3, 2, 0]
    assert spark.range(1).select(domain.escalation(F.lit(2.2)), domain.escalation(F.lit(9.0)), domain.escalation(F.lit(0.1))).first()[:] == (20, 40, 0)


def test_wilson_and_sizes(spark):
    low, high = domain.wilson(F.lit(0.5), F.lit(100))
    a, b = spark.range(1).select(low, high).first()
    assert math.isclose(a, 0.4038, abs_tol=1e-3) and math.isclose(b, 0.5962, abs_tol=1e-3)
    edges = spark.createDataFrame([(31.9,), (32.0,), (96.0,), (96.1,)], "s double")
    assert [r[0] for r in edges.select(statistics.size_bucket(F.col("s"), "closed")).collect()] == ["small", "medium", "medium", "large"]
    assert [r[0] for r in edges.select(statistics.size_bucket(F.col("s"), "half_open")).collect()] == ["small", "medium", "large", "large"]


def some_items(rng, n, cut=0.4, created=0.0):
    kinds = ["L0", "tile", "raw"]
    return [{"scenario": "s", "id": i, "kind": rng.choice(kinds), "created_s": rng.uniform(0, created) if created else 0.0, "size": float(rng.randint(1, 9)), "value": float(rng.randint(1, 9)), "progressive": rng.random() < cut} for i in range(n)]


def queue_of(items):
    return replay.Queue.of(pd.DataFrame(items))


def plain_plan(items, capacity, now, policy):
    """One item after the other."""
    age = lambda x: x["value"] / x["size"] * (1 + 0.5 * max(0.0, now - x["created_s"]) / 3600)
    own = sorted(items, key=(lambda x: -age(x)) if policy == "value" else (lambda x: x["created_s"]))
    left, out = capacity, []
    for it in own:
        if it["size"] <= left:
            out.append((it["id"], 1.0))
            left -= it["size"]
        elif policy == "value" and it["progressive"] and left >= 0.1 * it["size"] and left > 0:
            return [*out, (it["id"], left / it["size"])]
        elif policy != "value":
            break
        if left <= 0:
            break
    return out


def plain_replay(items, windows, policy, storage):
    queue, pending, out = [], sorted(items, key=lambda x: (x["created_s"], x["id"])), []
    for rise, end, capacity in windows:
        queue = [] if policy == "nobuffer" else queue
        while pending and pending[0]["created_s"] <= rise:
            queue.append(pending.pop(0))
        over = sum(x["size"] for x in queue) - storage
        for victim in sorted(queue, key=(lambda x: x["value"] / x["size"]) if policy == "value" else (lambda x: -x["created_s"])):
            if over <= 0:
                break
            queue.remove(victim)
            over -= victim["size"]
        used = 0.0
        for i, f in plain_plan(queue, capacity, rise, policy):
            it = next(x for x in queue if x["id"] == i)
            queue.remove(it)
            used += it["size"] * f
            out.append((i, round(f, 9), round(rise + (end - rise) * min(1.0, used / capacity), 9)))
    return out


@pytest.mark.parametrize("policy", replay.POLICIES)
def test_replay_is_the_plain_loop(policy):
    rng = random.Random(11)
    for _ in range(40):
        items = some_items(rng, 30, created=9000.0)
        windows = [(1000.0 * (k + 1), 1000.0 * (k + 1) + 300, float(rng.randint(1, 40))) for k in range(8)]
        storage = rng.choice([8e9, 25.0])
        q = queue_of(items)
        got = [(int(q.ids[k]), round(f, 9), round(t, 9)) for k, f, t in replay.replay(q, windows, policy, storage).sent]
        assert got == plain_replay(items, windows, policy, storage)


@pytest.mark.parametrize("policy", replay.POLICIES)
def test_relay_off_is_the_scheduler_and_links_are_never_overfilled(policy):
    rng = random.Random(13)
    for _ in range(20):
        items = some_items(rng, 40, created=9000.0)
        ground, relay = ([(1500.0 * (k + 1) + by, 1500.0 * (k + 1) + by + 300, float(rng.randint(5, 40))) for k in range(5)] for by in (0, 600))
        isl = [(700.0 + 1400 * k, 1000.0 + 1400 * k, 0.0) for k in range(6)]
        off = replay.two_paths(queue_of(items), ground, isl, relay, policy, replay.Comms(relay=False))
        q = queue_of(items)
        want = replay.replay(q, ground, policy)
        assert [(k, round(f, 9), round(t, 6)) for k, _, f, t, *_ in off] == [(k, round(f, 9), round(t, 6)) for k, f, t in want.sent]
        c = replay.Comms(isl_bps=0.5, deadline_s=rng.choice([None, 2000.0]))
        q = queue_of(items)
        on = replay.two_paths(q, ground, isl, relay, policy, c)
        assert len({k for k, *_ in on}) == len(on) and all(q.kind[k] != "raw" for k, path, *_ in on if path == "relay")
        for plan, path in ((ground, "direct"), (relay, "relay")):
            for rise, end, capacity in plan:
                assert sum(size for _, p, _, t, size, *_ in on if p == path and rise < t <= end + 1e-6) <= capacity + 1e-6
        assert all(t >= q.created[k] for k, _, _, t, *_ in on)


def test_relay_takes_what_it_brings_down_sooner():
    items = [{"scenario": "s", "id": i, "kind": "L0", "created_s": 0.0, "size": 10.0, "value": 1.0, "progressive": False} for i in range(3)]
    ground, isl, relay = [(9000.0, 9100.0, 100.0)], [(100.0, 200.0, 0.0)], [(300.0, 400.0, 20.0)]
    got = replay.two_paths(queue_of(items), ground, isl, relay, "fifo", replay.Comms())
    assert [(int(k), path) for k, path, *_ in got] == [(0, "relay"), (1, "relay"), (2, "direct")]
    dear = replay.two_paths(queue_of(items), ground, isl, relay, "fifo", replay.Comms(per_s=0.0, per_J=1.0))
    assert {path for _, path, *_ in dear} == {"direct"}
    late = replay.two_paths(queue_of(items), ground, isl, relay, "fifo", replay.Comms(per_s=0.0, per_J=1.0, deadline_s=1000.0))
    assert [path for _, path, *_ in late] == ["relay", "relay", "direct"]


def test_items_that_no_window_takes_are_not_looked_for(monkeypatch):
    calls, known = [], replay.Ledger.first_with_room
    monkeypatch.setattr(replay.Ledger, "first_with_room", lambda self, *a, **k: calls.append(a) or known(self, *a, **k))
    items = [{"scenario": "s", "id": i, "kind": "tile", "created_s": float(i), "size": 500.0 if i else 10.0, "value": 1.0, "progressive": False} for i in range(400)]
    plan = lambda by: [(1000.0 * k + by, 1000.0 * k + by + 100, 40.0) for k in range(1, 20)]
    got = replay.two_paths(queue_of(items), plan(0), plan(200), plan(600), "value", replay.Comms())
    assert [k for k, *_ in got] == [0] and len(calls) <= 2


def test_routes_in_one_pass_are_the_routes_one_by_one(spark, monkeypatch):
    rng = random.Random(17)
    items = [dict(it, scenario=s) for s in ("s", "t", None) for it in some_items(rng, 50, created=9000.0)]
    made = spark.createDataFrame(pd.DataFrame(items)).repartition(3)
    plan = [{"path": p, "rise_s": 1500.0 * (k + 1) + by, "set_s": 1500.0 * (k + 1) + by + 300, "capacity": 15.0 + k if p != "isl" else None} for p, by in (("ground", 0.0), ("isl", 400.0), ("relay", 900.0)) for k in range(6)]
    windows = spark.createDataFrame(plan, "path string, rise_s double, set_s double, capacity double")
    every, c = ("ground", "isl", "relay"), replay.Comms(isl_bps=0.5, deadline_s=2000.0)
    routes = {"direct": (every, replay.Comms(relay=False)), "policy": (every, c), "relay": (every[1:], c)}
    monkeypatch.setattr(replay, "RETURNED", 20)
    got = [tuple(r) for r in replay.simulate_routes(made, windows, routes).collect()]
    each = spark.createDataFrame([dict(w, scenario=x) for w in plan for x in ("s", "t", None)], windows.schema.add("scenario", "string"))
    want = []
    for name, (paths, comms) in routes.items():
        of = {p: each.where((F.col("path") == p) & F.lit(p in paths)).drop("path") for p in every}
        want += [(name, *r) for r in replay.simulate_comms(made, of["ground"], of["isl"].drop("capacity"), of["relay"], comms=comms).collect()]
    assert len(want) > 60 and {r[4] for r in want} == {"direct", "relay"} and sorted(map(repr, got)) == sorted(map(repr, want))


def test_online_encoding(spark):
    rng = random.Random(3)
    always = [dict(it, tile=it["id"], unconfirmed=0, variant="always") for it in some_items(rng, 60, created=9000.0)]
    windows = [{"scenario": "s", "rise_s": 1000.0 * (k + 1), "set_s": 1000.0 * (k + 1) + 300, "capacity": 30.0} for k in range(9)]
    w = spark.createDataFrame(windows)
    for policy in replay.POLICIES:  # without a choice the loop is the scheduler, but for items that come with a pass
        online = replay.simulate_online(spark.createDataFrame(always), w, policy).collect()
        batch = replay.simulate(spark.createDataFrame(always).drop("tile", "unconfirmed", "variant"), w, policy).collect()
        key = lambda r: (r.id, round(r.fraction, 9), round(r.delivered_s, 6))
        assert sorted(map(key, online)) == sorted(map(key, batch)) and online
    coast = [{"scenario": "s", "id": 2 * i + k, "tile": i, "kind": kind, "variant": kind, "created_s": 10.0 * i, "size": size, "value": 1.0, "progressive": False, "unconfirmed": 20} for i in range(30) for k, kind, size in ((0, "tile", 9.0), (1, "mosaic", 1.0))]
    got = replay.simulate_online(spark.createDataFrame(coast), spark.createDataFrame([{"scenario": "s", "rise_s": rise, "set_s": rise + 300, "capacity": room} for rise, room in ((1000.0, 70.0), (90_000.0, 1e6))]), "fifo").collect()
    assert {r.kind for r in got if r.escalate <= 20} == {"tile"} and {r.kind for r in got if r.escalate > 20} == {"mosaic"}
    assert all(r.escalate == replay.escalation_of(r.pressure) for r in got)
    ahead = replay.ahead([(100.0, 1.0, 5.0), (900.0, 1.0, 7.0)], 200.0)
    assert [ahead(t) for t in (0.0, 101.0, 750.0, 901.0)] == [5.0, 7.0, 7.0, 0.0]


def every_choice(items, capacity, steps):
    best = 0.0
    for pick in itertools.product(*[[0.0, *optimum.shares(it["progressive"], steps, 0.1)] for it in items]):
        if sum(math.ceil(it["size"] * f) for it, f in zip(items, pick, strict=True)) <= capacity:
            best = max(best, sum(it["value"] * (math.sqrt(f) if it["progressive"] else f) for it, f in zip(items, pick, strict=True)))
    return best


def test_optimum_is_that_of_exhaustive_search_and_lies_between_policy_and_bound():
    rng = random.Random(4)
    for _ in range(25):
        items, capacity = some_items(rng, 6), float(rng.randint(5, 25))
        q = queue_of(items)
        best = optimum.best_value(q.size, q.value, q.progressive, capacity, steps=3, bucket=1.0)
        assert math.isclose(best, every_choice(items, capacity, 3), rel_tol=1e-9)
        q.waiting = np.arange(len(items))
        n, got, top, bound, gap, valid = optimum.gap_of(q, capacity, 0.0, "value", 1.0, 3)
        assert valid and n == 6 and 0 <= gap < 1 and got <= top <= bound + 1e-6
        assert math.isclose(optimum.window_bound(q, capacity), optimum.day_bound(q, [(0.0, 1.0, capacity)]), rel_tol=1e-9)


def test_bound_of_a_day_is_the_plain_loop():
    rng = random.Random(14)
    for _ in range(40):
        items = some_items(rng, 25, created=9000.0)
        windows = [(1000.0 * (k + 1), 1100.0 * (k + 1), float(rng.randint(1, 20))) for k in range(7)]
        room, total = [w[2] for w in windows], 0.0
        rate = lambda x: x["value"] / x["size"] / (math.sqrt(0.1) if x["progressive"] else 1)
        for it in sorted(sorted(items, key=lambda x: (x["created_s"], x["id"])), key=lambda x: -rate(x)):
            need = it["value"] / rate(it)
            for j in range(7):
                if windows[j][0] >= it["created_s"] and need > 0:
                    take = min(room[j], need)
                    room[j], need, total = room[j] - take, need - take, total + take * rate(it)
        q = queue_of(items)
        assert math.isclose(optimum.day_bound(q, windows), total, rel_tol=1e-9)
        got = sum(q.value[k] * (math.sqrt(f) if q.progressive[k] else 1) for k, f, _ in replay.replay(queue_of(items), windows, "value").sent)
        assert got <= total + 1e-6 and optimum.clairvoyant(q, windows) <= total + 1e-6


def test_small_instances_keep_the_load():
    q = queue_of(some_items(random.Random(1), 200))
    own, room, bucket = optimum.small_instance(q, 300.0, 40)
    assert len(own) == 40 and math.isclose(room / q.size[own].sum(), 300.0 / q.size.sum()) and q.size[own].min() >= 2 * bucket or bucket == 1.0
    assert len(optimum.small_instance(q, 1e6, 160, max_buckets=50)[0]) < 160


def test_joint_program_meets_its_floors_at_the_least_cost():
    rng, worse = np.random.default_rng(3), 0
    for _ in range(60):
        n = int(rng.integers(2, 6))
        j, weight = np.cumsum(rng.random((n, 4)), axis=1), rng.integers(1, 6, n).astype(float)
        j[:, 0] = 0.0
        acc, info = weight[:, None] * (np.arange(4) > 0), weight[:, None] * np.array(joint.CREDIT)
        a, i = float(rng.choice([0, 0.5, 0.9])), float(rng.choice([0, 0.4, 0.8]))
        level = joint.solve(j, acc, info, weight, a, i)
        at = lambda x, lv: x[np.arange(n), list(lv)].sum()  # noqa: B023, E731
        fit = [lv for lv in itertools.product(range(4), repeat=n) if at(acc, lv) / weight.sum() >= a - 1e-9 and at(info, lv) / weight.sum() >= i - 1e-9]
        assert tuple(level) in fit
        best = min(at(j, lv) for lv in fit)
        assert at(j, level) >= best - 1e-9
        worse += at(j, level) > best * 1.5 + 1e-9
    assert worse <= 12  # the repair is greedy
    free = joint.solve(np.array([[1.0, 1.0, 0.5, 2.0]]), np.array([[0, 1.0, 1, 1]]), np.array([[0, 0.5, 0.8, 1]]), np.ones(1))
    assert free.tolist() == [2] and joint.solve(np.array([[1.0, 1.0, 1.0, 1.0]]), np.array([[0, 1.0, 1, 1]]), np.array([[0, 0.5, 0.8, 1]]), np.ones(1)).tolist() == [3]


def test_next_window_on_days_without_windows(spark):
    items = spark.createDataFrame([(1, 90_000.0), (2, 200_000.0), (3, 300_001.0), (4, -50.0), (5, None), (6, 5_000.0)], "id long, t double")
    plan = spark.createDataFrame([(1, 5_000.0), (2, 300_000.0)], "w long, start double")
    assert {r.id: r.w for r in scheduling.next_window(items, plan, "t", "start", ["w"]).collect()} == {1: 2, 2: 2, 3: None, 4: 1, 5: None, 6: 1}
    assert {r.w for r in scheduling.next_window(items, plan.where("false"), "t", "start", ["w"]).collect()} == {None}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9), (None, 4), (8, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.where("false")).count() == 0


def test_split_keeps_groups_whole_and_near_the_quota(spark):
    groups = spark.range(100).select(F.col("id").alias("group"), F.lit(3).cast("long").alias("n"))
    got = {r.split: r.s for r in neighbours.group_split(groups).groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert sum(got.values()) == 300 and abs(got["train"] - 240) <= 6 and abs(got["val"] - 30) <= 6


def test_signatures(spark):
    rng = np.random.default_rng(0)
    img = rng.random((128, 128)) * 255
    assert bin((imaging.phash(img) ^ imaging.phash(img + 3)) & (1 << 64) - 1).count("1") <= 4
    keys = spark.range(1).select(neighbours.band_keys(F.array(F.lit(-1).cast("long"), F.lit(1).cast("long")))).first()[0]
    assert sorted(keys) == sorted(["0:65535", "1:65535", "2:65535", "3:65535", "0:1", "1:0", "2:0", "3:0"])
    got = spark.range(1).select(neighbours.hamming(F.array(F.lit(7).cast("long")), F.array(F.lit(1).cast("long"), F.lit(5).cast("long")))).first()[0]
    assert got == 1
    unit = spark.range(1).select(neighbours.thumb_vector(F.array(F.lit(1.0), F.lit(3.0)))).first()[0]
    assert np.allclose(unit, [-math.sqrt(0.5), math.sqrt(0.5)])


def test_thumb_vectors_take_one_pass_an_image(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(1024).tolist()) for i in range(20)] + [(20, [2.0] * 9), (21, []), (22, None)]
    made = spark.createDataFrame(rows, "id long, grey array<double>").repartition(1)
    began = time.monotonic()
    got = {r.id: r.x for r in made.select("id", neighbours.thumb_vector(F.col("grey")).alias("x")).collect()}
    assert time.monotonic() - began < 20  # 20 times 1024 cubed steps, were mean and norm found again for every grey
    for i, grey in rows[:20]:
        less = np.array(grey) - np.mean(grey)
        assert np.allclose(got[i], less / np.linalg.norm(less))
    assert got[20] == [0.0] * 9 and got[21] == [] and got[22] is None


def test_hash_is_the_plain_cosine_transform():
    rng = np.random.default_rng(3)
    img = rng.random((32, 32)) * 255
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    low = [
        scale(k) * scale(m) * sum(img[i, j] * math.cos(math.pi * (2 * i + 1) * k / 64) * math.cos(math.pi * (2 * j + 1) * m / 64) for i in range(32) for j in range(32))
        for k in range(8) for m in range(8)
    ]
    bits = "".join("1" if x > sorted(low[1:])[31] else "0" for x in low)
    assert imaging.phash(img) & (1 << 64) - 1 == int(bits, 2)
    assert len(imaging.window_hashes(img)) == 6 and len(imaging.window_hashes(img[:1, :1])) < 6
    assert np.allclose(imaging.shrink(np.arange(9.0).reshape(3, 3), 2), [[(0 + 1 / 2 + 3 / 2 + 4 / 4) / 2.25, (1 / 2 + 2 + 4 / 4 + 5 / 2) / 2.25], [(3 / 2 + 4 / 4 + 6 + 7 / 2) / 2.25, (4 / 4 + 5 / 2 + 7 / 2 + 8) / 2.25]])


def test_overlap_leaves_out_fill_and_asks_for_detail():
    rng = np.random.default_rng(4)
    wide = rng.random((160, 160)) * 200
    a, b = wide[:128, :128], wide[12:140, 20:148]  # one scene, moved by 12 rows and 20 columns
    coarse, detail, share = imaging.overlap_evidence(a, b)
    assert coarse > 0.999 and detail > 0.95 and share == pytest.approx(116 * 108 / 128**2)
    assert imaging.overlap_evidence(a, rng.random((128, 128)) * 200)[0] < 0.3
    barred = lambda x: np.where(np.arange(128)[None, :] < 40, 0.0, x)
    mask = imaging.real_pixels(barred(a))
    assert not mask[:, :40].any() and mask[:, 45:].all()
    assert abs(imaging.overlap_evidence(barred(a), barred(rng.random((128, 128)) * 200))[0]) < 0.3  # the bar alone is no evidence
    nothing = imaging.overlap_evidence(np.zeros((128, 128)), a)
    assert nothing[0] == 0 and math.isnan(nothing[1]) and nothing[2] == 0
    haze = np.add.outer(np.arange(128.0), np.arange(128.0)) + rng.random((128, 128)) * 0.1
    assert math.isnan(imaging.overlap_evidence(haze, haze + rng.random((128, 128)) * 0.1)[1])  # alike, but without texture


def test_images_without_pixels(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 2, 2), (2, [], 0, 0), (3, None, 4, 4), (None, [5.0] * 4, 2, 2)]
    made = spark.createDataFrame(rows, "id long, grey array<double>, height int, width int")
    got = {r.id: r for r in imaging.signatures(made, "id").collect()}
    assert [len(got[k].proof) for k in (1, 2, 3, None)] == [128 * 128, 0, 0, 128 * 128] and list(got[2].hashes) == [] and not any(got[None].thumb)
    assert imaging.signatures(made.limit(0), "id", proof=False).columns == ["id", "hashes", "thumb"]
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")
    assert [(r.a, r.b) for r in imaging.evidence(pairs, imaging.signatures(made, "id"), "id").collect()] == [(1, 1)]


def test_evidence_takes_images_as_they_are_stored(spark, monkeypatch):
    """Neither greys nor proofs go through an exchange, and what Python is sent at a time is bounded."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.random(64).tolist()) for k in range(70)] + [(70, None), (71, [])]
    stored = spark.createDataFrame(rows, "id long, v array<double>")
    across = lambda v: F.flatten(F.transform(v, lambda y: F.transform(v, lambda x: 100 + x * y * 99)))
    pairs = stored.select(F.col("id").alias("a"), F.when(F.col("id") < 69, F.col("id") + 1).otherwise(F.col("id")).alias("b"))
    made = stored.select("id", across(F.col("v")).alias("grey"), F.lit(64).alias("height"), F.lit(64).alias("width"))
    by_proof = {(r.a, r.b): r for r in imaging.evidence(pairs, imaging.signatures(made, "id"), "id").collect()}
    sent, known = [], imaging.storage.materialize
    monkeypatch.setattr(imaging.storage, "materialize", lambda df, *a, **k: sent.append((df, k)) or known(df, *a, **k))
    got = {(r.a, r.b): r for r in imaging.image_evidence(pairs, stored, "id", lambda of: across(of["v"]), 64, 64).collect()}
    assert len(got) == 70 and got[69, 69].coarse > 0.999 and sorted(map(str, got.values())) == sorted(map(str, by_proof.values()))
    plan = sent[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert sent[0][1]["batch"] == "4m" and "flatten" not in plan[plan.index("Join") :]


def test_large_buckets_and_every_band_keep_their_pairs(spark):
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same").alias("sig"))
    assert {(r.a, r.b) for r in neighbours.bucket_members(many, "doc_id", "sig").collect()} == {(0, i) for i in range(1, 300)}
    sigs = [5] * 300 + [5 + (9 << 16), 7 + (9 << 16), 1 << 30]  # 300 copies, one that shares the low band, one the high band of the last
    got = {(r.a, r.b): r.distance for r in neighbours.banded_pairs(spark.createDataFrame(list(enumerate(sigs)), "id long, sig long"), "id", "sig", 32).collect()}
    assert got == {(0, i): 0 for i in range(1, 300)} | {(0, 300): 2, (300, 301): 1}


def test_evidence_with_nan(spark):
    rows = [(1, 2, 0.95, 0.5, None), (1, 3, 0.95, float("nan"), 50), (1, 4, float("nan"), 0.9, 99), (1, 5, 0.8, 0.1, 10)]
    got = neighbours.accept(spark.createDataFrame(rows, "a long, b long, coarse double, detail double, inliers int")).collect()
    assert {(r.b, r.method) for r in got} == {(2, "ncc"), (3, "orb")}


def test_records_and_packets(spark):
    make = lambda **k: codec.Record(**{"image": 31, "t": 5000.125, "conf": 0.4567, "cx": 40_123.4, "cy": 77.7, "w": 31.5, "h": 9.9, "level": 3} | k)
    full = make(geo=(-12.5, 101.25), roi=71, ctx=72, dark=True, coast=True)
    sizes = [len(codec.pack_record(make(**k), whole)) for k in ({}, {"roi": 5}, {"geo": (1.0, 2.0)}, {"roi": 1, "ctx": 2}) for whole in (True, False)]
    assert sizes == [26, 16, 30, 20, 34, 24, 34, 24] and len(codec.pack_record(full)) == 42
    back, at = codec.unpack_record(codec.pack_record(full))
    assert at == 42 and back == dataclasses.replace(full, conf=back.conf) and abs(back.conf - 0.4567) < 1e-4
    tile = codec.unpack_tile(codec.pack_tile(31, 5000.125, [full, make(level=1)]))
    assert [(r.image, r.t, r.level, r.cx) for r in tile] == [(31, 5000.125, 3, 40_123.4), (31, 5000.125, 1, 40_123.4)]
    wide, _ = codec.unpack_record(codec.pack_record(make(w=9999.0, conf=2.0, cx=-3.0)))
    assert (wide.w, wide.conf, wide.cx) == (6553.5, 1.0, 0.0)
    data = bytes(range(256)) * 50
    stream = b"".join(codec.packetize(data, 3, 16383) + codec.packetize(b"x", 4))
    assert list(codec.depacketize(stream)) == [(3, data), (4, b"x")]
    for spoil in (lambda s: s[:20] + bytes([s[20] ^ 1]) + s[21:], lambda s: s[:-1], lambda s: s[4102:], lambda s: s[:4102] + s[-9:]):
        with pytest.raises(codec.BadPacket):
            list(codec.depacketize(spoil(stream)))
    image = codec.image_payload(9, 1, 2, 30, 40, 70, codec.PROGRESSIVE_JPEG, b"jpeg")
    whole = b"".join(codec.packetize(codec.pack_tile(31, 1.0, [full]), codec.APIDS["P1T"]) + codec.packetize(image, codec.APIDS["P2"]))
    got = codec.decode_downlink(spark.createDataFrame([(bytearray(whole),)], "packet binary")).collect()
    assert [(r.kind, r.image, r.level, r.roi, r.x0, r.quality, r.n_bytes) for r in got] == [("P1", 31, 3, 71, None, None, None), ("P2", 9, None, None, 1, 70, 4)]
    assert spark.range(1).select(codec.raw_packet_bytes(F.lit(768), F.lit(768))).first()[0] == 18 + 768 * 768 * 3 + 8 * math.ceil((18 + 768 * 768 * 3) / 4094)


def test_jpeg_scans():
    scan = lambda body: b"\xff\xda\x00\x03x" + body
    data = b"\xff\xd8\xff\xe0\x00\x04ab" + scan(b"one\xff\x00\xff\xd1more") + scan(b"two") + b"\xff\xd9"
    assert codec.jpeg_scan_ends(data) == [data.index(b"\xff\xda", 12), len(data) - 2] and codec.jpeg_header_bytes(data) == 13
    assert codec.least_fraction(data, True) == codec.jpeg_scan_ends(data)[0] / len(data) and codec.least_fraction(data, False) == 1.0
    assert codec.jpeg_prefix(data[:20]).endswith(b"\xff\xd9") and codec.jpeg_prefix(data) == data
    assert codec.product_fraction(18, data, False) == 1.0


def test_orbit(spark):
    p = orbit.find_passes(spark, 36.0, [("sfax", 34.74, 10.76)]).collect()
    assert 3 <= len(p) <= 12 and all(5 <= r.max_elevation <= 90 and 0 < r.set_s - r.rise_s < 900 and r.capacity > 0 for r in p)
    seen = spark.createDataFrame([(float(t), t not in (30, 40, 70)) for t in range(0, 100, 10)], "t double, v boolean")
    assert sorted((r.start_s, r.end_s) for r in orbit.islands(seen, "t", "v", 10).collect()) == [(0, 20), (50, 60), (80, 90)]


def test_calibration(spark):
    rng = np.random.default_rng(0)
    s = rng.uniform(0.05, 0.95, 4000)
    df = spark.createDataFrame([(i, float(x), int(rng.random() < x)) for i, x in enumerate(s)], "doc_id long, score double, correct long")
    a, b = statistics.platt(df)
    assert abs(a - 1) < 0.15 and abs(b) < 0.15
    fitted = statistics.isotonic(df, 200).orderBy("score").collect()
    assert all(x.calibrated <= y.calibrated for x, y in zip(fitted, fitted[1:], strict=False))
    assert statistics.ece(statistics.ece_table(df)).first().ece < 0.05


def test_platt_scores_equal_a_plain_fit(spark, sf):
    rows = views.calibration(spark, sf)
    got = statistics.apply_platt(rows, *statistics.platt(rows)).collect()
    p = np.clip([r.score for r in got], 1e-6, 1 - 1e-6)
    x, y, w = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1), np.array([r.correct for r in got]), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (y - q))
    assert len(got) > 10 and np.allclose([r.calibrated for r in got], 1 / (1 + np.exp(-x @ w)), atol=1e-6)


def test_encoders(spark):
    ship = "struct<id:bigint,conf:double,px:double,dark:boolean>"
    rows = [(1, 0.0, "cloud", False, 0, 1, None, [(1, 0.9, 10.0, False)]), (2, 0.0, "ships", False, 0, 1, None, [(2, 0.9, 10.0, True), (3, 0.67, 10.0, False), (4, 0.1, 9.0, False)]), (3, 0.0, "coast", False, 12, 0, None, [(5, 0.1, 9.0, False)])]
    t = spark.createDataFrame(rows, f"tile long, t double, ctx string, gate_empty boolean, unconfirmed long, n_fp long, coast_bytes double, ships array<{ship}>")
    kinds = sorted((r.tile, r.kind) for r in encoding.encode_lod(t).collect())
    assert kinds == [(2, "L0"), (2, "L1"), (2, "L2"), (2, "fp"), (2, "thumb"), (3, "thumb"), (3, "tile")]
    assert encoding.encode_raw(t).count() == 2 and encoding.encode_fixed(t).count() == 4
    offered = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 1.0), (2, "c", 1, 5.0)], "ship long, product string, level int, weight double")
    got = spark.createDataFrame([("a",), ("c",)], "product string")
    assert math.isclose(encoding.information_kept(offered, got).first().kept, (0.5 + 2.5) / 6)


def test_readers(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "img1.txt").write_text("0 0.5 0.5 0.1 0.2\nbad line\n1 0.1 0.1 0.1 x\n")
    (tmp_path / "img2.txt").write_text("imagesource:x\ngsd:1\n0 0 10 0 10 20 0 20 Ship 0\n0 0 1 0 1 1 0 1 plane 0\n")
    assert [tuple(r) for r in readers.read_yolo(spark, str(tmp_path / "y"), 100, 200).collect()] == [("img1", 0, 50.0, 100.0, 10.0, 40.0)]
    assert [tuple(r) for r in readers.read_dota(spark, str(tmp_path / "img2.txt")).collect()] == [("img2", "ship", 5.0, 10.0, 10.0, 20.0)]
    (tmp_path / "c.json").write_text('{"images":[{"id":1,"file_name":"a","width":9,"height":9},{"id":2,"file_name":"b","width":9,"height":9}],"annotations":[{"image_id":1,"category_id":3,"bbox":[0,0,4,2]}],"categories":[{"id":3,"name":"Ship"}]}')
    got = {r.id: len(r.boxes) for r in readers.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert got == {1: 1, 2: 0}
    (tmp_path / "m.csv").write_text("ImageId,EncodedPixels\na,1 3\na,9 2\nb,\n")
    assert {r.ImageId: len(r.masks) for r in readers.read_masks(spark, str(tmp_path / "m.csv")).collect()} == {"a": 2, "b": 0}
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "z.jpg").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    assert readers.read_images(spark, str(tmp_path / "i")).first().format == "png"
    with pytest.raises(ValueError):
        readers.write_tagged(spark.range(1), str(tmp_path / "o"), None, default=False)
    (tmp_path / "p.csv").write_text("image,conf\na,0.5\n")
    r = readers.read_csv(spark, str(tmp_path / "p.csv"), "predictions").first()
    assert r.image == "a" and r.conf == 0.5 and r.cx is None


def test_archives_and_label_errors(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.jpg", b"\xff\xd8\xff")
        z.writestr("x/two.JPG", b"abc")
        z.writestr("t.csv", "image,cx\n007,1.5\n")
    got = readers.read_zip_images(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.image, bytes(r.content)) for r in got] == [("one", b"\xff\xd8\xff"), ("two", b"abc")]
    assert [tuple(r) for r in readers.read_zip_csv(spark, str(tmp_path / "a.zip"), "t.csv", "image string, cx double").collect()] == [("007", 1.5)]
    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.1"), ("b", "0 1 2"), ("c", "0 x 0.5 0.1 0.1"), ("d", "")], "image string, value string")
    assert {r.image: r.error for r in readers.checked_labels(lines).collect()} == {"a": None, "b": "fields", "c": "number", "d": "fields"}


def test_head_decoding():
    from orbweave.operators import perception

    out = np.array([[100.0, 101, 300, 500], [100, 100, 300, 500], [20, 20, 40, 2000], [20, 20, 40, 20], [0.9, 0.8, 0.7, 0.04]])
    got = perception.decode_head(out, 400, 400, gain=2.0, pad=(10.0, 0.0))
    assert [tuple(x) for x in got] == [(45.0, 50.0, 10.0, 10.0, 0.9), (145.0, 150.0, 20.0, 20.0, 0.7)]
    assert len(perception.decode_head(out, 400, 400, most=1)) == 1 and len(perception.decode_head(out, 400, 400, conf=0.95)) == 0


def test_detectors_must_answer_for_their_windows(spark):
    from orbweave.operators import perception

    images = spark.createDataFrame([(1, 100, 100)], "image long, width int, height int")
    wrong = lambda b: pd.DataFrame([(1, 7, 1.0, 1.0, 1.0, 1.0, 0.9)], columns=["image", "slice", "cx", "cy", "w", "h", "conf"])
    with pytest.raises(Exception, match="not given"):
        perception.detect_images(images, wrong, "whole").collect()
    with pytest.raises(ValueError):
        perception.plan_windows(images, "other")


def test_samples_leave_out_contexts_without_tiles(spark):
    from orbweave.operators import sampling

    pool = spark.createDataFrame([(1, "ships"), (2, "empty"), (3, "empty")], "tile long, ctx string")
    day = sampling.sample_day(pool, 400)
    assert day.count() == 400 and {r.ctx for r in day.select("ctx").distinct().collect()} == {"ships", "empty"} and 0.15 < day.where("ctx = 'ships'").count() / 400 < 0.35
    with pytest.raises(ValueError):
        sampling.sample_day(pool.where("false"), 5)
    got = sampling.sequential_split(spark.range(1000), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 100, "test": 100, "train": 800}


def test_intermediates_are_deleted_at_the_end(spark):
    from orbweave import storage

    with storage.intermediates(spark):
        kept = storage.materialize(spark.range(5), "t")
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_streaming(spark, tmp_path):
    from orbweave.streaming import online

    rows = [(f"s{i % 2}", i, float(i * 100), 10.0) for i in range(40)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "satellite string, id long, t double, size double").repartition(1).write.parquet(src)
    stream = spark.readStream.schema("satellite string, id long, t double, size double").parquet(src)
    plan = [(950.0, 30.0), (2000.0, 1000.0)]
    q = online.online_fifo(stream, plan).writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.satellite, r.id, r.pass_no) for r in spark.table("sent").collect())
    want = []
    for s in (0, 1):
        own = [r for r in rows if r[0] == f"s{s}"]
        first = [r for r in own if r[2] < 950][:3]
        rest = [r for r in own if r[2] < 2000 and r not in first]
        want += [(f"s{s}", r[1], 0) for r in first] + [(f"s{s}", r[1], 1) for r in rest]
    assert got == sorted(want)
    ev = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5), "a", 3, 1), (datetime.datetime(2024, 1, 2, 5), "a", 4, 1)], "ts timestamp, kind string, size long, user_id long")
    assert sorted(r.bytes for r in online.daily_totals(ev).collect()) == [3, 4] and online.sessions(ev).count() == 2
