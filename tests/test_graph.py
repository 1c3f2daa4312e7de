from __future__ import annotations

import itertools
import json
import random

from pyspark.sql import functions as F

from runtally.operators import checks, graph as g, joins as j, windows as w
from runtally.schemas import TASK_DEFS, TASKS, UPLOAD_COLUMNS, conform
from tests.conftest import rows

K = ["run_id"]


def graph(spark, **runs):
    """runs: name -> {node: [preds]}"""
    defs = spark.createDataFrame([(r, n, p) for r, d in runs.items() for n, p in d.items()], "run_id string, id string, predecessors array<string>")
    return g.nodes_of(defs, K), g.edges(defs, K)


def test_levels_and_cycles(spark):
    n, e = graph(spark, chain={"1": [], "2": ["1"], "3": ["2", "1"]}, loop={"1": ["2"], "2": ["1"]}, ring={"1": ["3"], "2": ["1"], "3": ["2"], "4": ["3"], "5": []},
                 dangling={"1": ["9"], "2": ["1"]}, wide={"1": [], "2": [], "3": ["1", "2"]})
    got = {(r["run_id"], r["node"]): r["level"] for r in g.levels(n, e, K).collect()}
    assert got == {("chain", "1"): 0, ("chain", "2"): 1, ("chain", "3"): 2, ("ring", "5"): 0, ("dangling", "1"): 0, ("dangling", "2"): 1,
                   ("wide", "1"): 0, ("wide", "2"): 0, ("wide", "3"): 1}
    assert rows(g.acyclic(n, e, K), "run_id", "held", "is_acyclic") == [
        ("chain", 0, True), ("dangling", 0, True), ("loop", 2, False), ("ring", 4, False), ("wide", 0, True)]


def test_levels_of_random_graphs(spark):
    random.seed(3)
    runs = {f"r{i}": {str(n): sorted({str(random.randrange(n)) for _ in range(random.randint(0, 3))}) if n else [] for n in range(12)} for i in range(8)}
    n, e = graph(spark, **runs)
    got = {(r["run_id"], r["node"]): r["level"] for r in g.levels(n, e, K).collect()}
    for r, d in runs.items():
        level = {}
        for node in map(str, range(12)):
            level[node] = max([level[p] + 1 for p in d[node]], default=0)
            assert got[(r, node)] == level[node]


def test_chain_of_thousands_in_few_rounds(spark, monkeypatch):
    """A chain of 5,000 tasks, beside a ladder whose steps have two predecessors each, a star and a tree."""
    calls = []
    real = g._counted
    monkeypatch.setattr(g, "_counted", lambda *a: calls.append(1) or real(*a))
    chain = {str(i): [str(i - 1)] if i else [] for i in range(5000)}
    ladder = {f"{s}{i}": [f"a{i - 1}", f"b{i - 1}"] if i else [] for i in range(7) for s in "ab"}
    diamonds = {f"{s}{i}": {"m": [f"x{i - 1}", f"y{i - 1}"] if i else [], "x": [f"m{i}"], "y": [f"m{i}"]}[s] for i in range(300) for s in "mxy"}
    n, e = graph(spark, chain=chain, diamonds=diamonds)
    got = {(r["run_id"], r["node"]): r["level"] for r in g.levels(n, e, K).collect()}
    assert len(calls) <= 20
    assert all(got["chain", str(i)] == i for i in range(5000))
    assert all(got["diamonds", f"{s}{i}"] == 2 * i + (s != "m") for i in range(300) for s in "mxy")
    n, e = graph(spark, ladder=ladder)
    assert {r["node"]: r["level"] for r in g.levels(n, e, K).collect()} == {f"{s}{i}": i for i in range(7) for s in "ab"}


def test_skip_chain_in_few_rounds(spark, monkeypatch):
    calls = []
    real = g._counted
    monkeypatch.setattr(g, "_counted", lambda *a: calls.append(1) or real(*a))
    n, e = graph(spark, r={str(i): [str(i - 1)] if i else [] for i in range(500)})
    got = {r["node"]: r["round"] for r in g.skip_closure(spark.createDataFrame([("r", "10")], "run_id string, node string"), e, n, K).collect()}
    assert got == {str(i): i - 10 for i in range(11, 500)} and len(calls) <= 13


def plain_skip(preds, failed, strict):
    dist = {f: 0 for f in failed}
    front, n = set(failed), 0
    while front:
        n += 1
        front = {v for v, ps in preds.items() if v in strict and v not in dist and front & set(ps)}
        dist.update(dict.fromkeys(front, n))
    return {v: d for v, d in dist.items() if d}


def test_random_graphs_with_cycles(spark):
    """Levels, held nodes, cycles and closures of random graphs, also with cycles, against plain searches."""
    random.seed(11)
    runs = {f"r{i}": {str(v): sorted({str(random.randrange(14 if i % 2 else max(v, 1))) for _ in range(random.randint(0, 2))} - ({str(v)} if i % 4 else set())) for v in range(14)} for i in range(12)}
    n, e = graph(spark, **runs)
    level = {(r["run_id"], r["node"]): r["level"] for r in g.levels(n, e, K).collect()}
    held = {(r["run_id"], r["node"]): r["ahead"] for r in g.held(n, e, K).collect()}
    rings = {}
    for r in g.cycles(n, e, K).collect():
        rings.setdefault(r["run_id"], {})[r["step"]] = r["node"]
    failed = {(r, "3") for r in runs}
    skipped = {(r["run_id"], r["node"]): r["round"] for r in g.skip_closure(spark.createDataFrame(sorted(failed), "run_id string, node string"), e, n.where("node <> '5'"), K).collect()}
    want_skip = {}
    for r, d in runs.items():
        free = {}
        while True:
            new = [v for v in d if v not in free and all(p in free for p in d[v])]
            if not new:
                break
            free.update((v, max([free[p] + 1 for p in d[v]], default=0)) for v in new)
        assert {v: level[r, v] for v in d if (r, v) in level} == free
        stuck = set(d) - set(free)
        assert {v for x, v in held if x == r} == stuck
        succ = {v: {s for s in stuck if v in d[s]} for v in stuck}

        def after(v):
            seen, todo = set(), [v]
            while todo:
                for s in succ[todo.pop()] - seen:
                    seen.add(s)
                    todo.append(s)
            return seen

        ring = {v for v in stuck if v in after(v)}
        assert {v for v in stuck if held[r, v]} == {v for v in stuck if v in ring or after(v) & ring}
        assert (r in rings) == bool(stuck)
        if stuck:
            path = [rings[r][i] for i in range(len(rings[r]))]
            assert len(set(path)) == len(path) and path[0] == min(path) and all(a in d[b] for a, b in zip(path, path[1:] + path[:1]))
        want_skip |= {(r, v): k for v, k in plain_skip(d, {"3"}, set(d) - {"5"}).items()}
    assert skipped == want_skip


def test_null_keys_are_a_graph(spark):
    n, e = graph(spark, r={"1": [], "2": ["1"]})
    blank = lambda df: df.withColumn("run_id", F.lit(None).cast("string"))
    got = {(r["run_id"], r["node"]): r["level"] for r in g.levels(n.union(blank(n)), e.union(blank(e)), K).collect()}
    assert got == {("r", "1"): 0, ("r", "2"): 1, (None, "1"): 0, (None, "2"): 1}
    none = n.limit(0)
    assert g.levels(none, e.limit(0), K).count() == 0 and g.held(none, e.limit(0), K).count() == 0 and g.cycles(none, e.limit(0), K).count() == 0


def test_stages_and_waits_act(spark):
    """Stage 2 lies behind stage 1 and becomes ready when all of it has finished; a wait file behaves alike; gates hand failure on."""
    defs = spark.createDataFrame([("r", "1", "a", []), ("r", "2", "a", ["1"]), ("r", "3", "b", []), ("r", "4", "b", ["3"]), ("r", "5", "c", []), ("r", "6", None, [])],
                                 "run_id string, id string, stage string, predecessors array<string>")
    nodes, e = g.stage_graph(defs, K, ("a", "b", "c"))
    assert {r["node"]: r["level"] for r in g.levels(nodes, e, K).collect()} == {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "6": 0}
    gates = nodes.where("weight = 0")
    pending = [("3", 1, "pending"), ("4", 1, "pending"), ("5", 1, "pending"), ("6", 1, "completed")]
    assert rows(g.ready_tasks(instances(spark, [("1", 1, "completed"), ("2", 1, "running")] + pending), e, K, gates), "task_id") == []
    assert rows(g.ready_tasks(instances(spark, [("1", 1, "completed"), ("2", 1, "failed")] + pending), e, K, gates), "task_id") == [("3",)]
    failed = spark.createDataFrame([("r", "2")], "run_id string, node string")
    assert rows(g.skip_closure(failed, e, nodes, K), "node", "round") == [("3", 1), ("4", 1), ("5", 2)]
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(["a", "b", "wait", "c", "d", "wait", "wait", "e"])], "run_id string, pos int, id string")
    seq = w.wait_sequences(lines, K, "pos", F.col("id") == "wait", block=3)
    nodes, e = g.wait_graph(seq, K)
    assert {r["node"]: r["level"] for r in g.levels(nodes, e, K).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    assert g.held(nodes, e, K).count() == 0
    inst = instances(spark, [("a", 1, "completed"), ("b", 1, "completed"), ("c", 1, "pending"), ("d", 1, "completed"), ("e", 1, "pending")])
    assert rows(g.ready_tasks(inst, e, K, nodes.where("weight = 0")), "task_id") == [("c",)]


def test_gates_before_gates(spark):
    """A gate behind a gate is shut while anything before either is open."""
    nodes = spark.createDataFrame([("r", "1", 1), ("r", "g", 0), ("r", "h", 0), ("r", "2", 1)], "run_id string, node string, weight int")
    e = spark.createDataFrame([("r", "1", "g"), ("r", "g", "h"), ("r", "h", "2")], "run_id string, pred string, succ string")
    gates = nodes.where("weight = 0")
    assert rows(g.ready_tasks(instances(spark, [("1", 1, "running"), ("2", 1, "pending")]), e, K, gates)) == []
    assert rows(g.ready_tasks(instances(spark, [("1", 1, "completed"), ("2", 1, "pending")]), e, K, gates)) == [("r", "2", 1)]
    assert {r["node"]: r["level"] for r in g.levels(nodes, e, K).collect()} == {"1": 0, "2": 1}


def test_fan_out_graph(spark):
    data = [("r", i, t, p) for i, (t, p) in enumerate([("1", None), ("1", None), ("2", ["1"]), ("2", ["1"]), ("3", ["2", "4"]), ("4", None)])]
    df = spark.createDataFrame(data, "run_id string, id long, task_id string, predecessors array<string>")
    nodes, e = g.fan_out_graph(df)
    assert {r["node"]: r["level"] for r in g.levels(nodes, e, K).collect()} == {"1.1": 0, "1.2": 0, "2.1": 1, "2.2": 1, "3": 2, "4": 0}


def instances(spark, data):
    return spark.createDataFrame([("r", t, i, s, {"completed": True, "failed": False}.get(s)) for t, i, s in data],
                                 "run_id string, task_id string, instance_no int, state string, success boolean")


def test_ready_waits_for_all_instances(spark):
    _, e = graph(spark, r={"1": [], "2": ["1"]})
    two = [("2", 1, "pending")]
    part = instances(spark, [("1", 1, "completed"), ("1", 2, "completed"), ("1", 3, "running")] + two)
    assert g.ready_tasks(part, e, K).count() == 0
    full = instances(spark, [("1", i, "completed") for i in (1, 2, 3)] + two)
    assert rows(g.ready_tasks(full, e, K)) == [("r", "2", 1)]
    some = instances(spark, [("1", 1, "running"), ("1", 2, "pending")] + two)
    assert rows(g.ready_tasks(some, e, K)) == [("r", "1", 2)]
    failed = instances(spark, [("1", 1, "completed"), ("1", 2, "failed")] + two)
    assert rows(g.ready_tasks(failed, e, K)) == [("r", "2", 1)]
    assert rows(g.task_status(failed, K), "task_id", "status") == [("1", "failed"), ("2", "pending")]
    _, lost = graph(spark, r={"2": ["9"]})
    assert g.ready_tasks(instances(spark, two), lost, K).count() == 0


def test_predecessor_check(spark):
    defs = spark.createDataFrame([("r", "4", ["1", "2", "3"], True), ("r", "5", ["3", "9"], True), ("r", "6", ["2"], False), ("r", "7", ["1"], True)],
                                 "run_id string, id string, predecessors array<string>, require_predecessor_success boolean")
    done = spark.createDataFrame([("r", "1", True), ("r", "2", False), ("r", "3", True)], "run_id string, task_id string, success boolean")
    assert rows(g.predecessor_check(defs, done, K)) == [("r", "4", "2", "failed"), ("r", "5", "9", "uncompleted")]


def test_skip_closure(spark):
    n, e = graph(spark, r={"1": [], "2": ["1"], "3": ["2"], "4": ["3"], "5": ["1"], "6": ["5"]})
    failed = spark.createDataFrame([("r", "1")], "run_id string, node string")
    strict = n.filter("node in ('2', '3', '6')")
    assert rows(g.skip_closure(failed, e, strict, K)) == [("r", "2", 1), ("r", "3", 2)]


def reach(pairs):
    """All (task, task) pairs linked directly or through a gate."""
    out, into = {}, {}
    for p, s in pairs:
        (out if s.startswith("gate") else into).setdefault(s if s.startswith("gate") else p, []).append(p if s.startswith("gate") else s)
    return {(a, b) for gate, before in out.items() for a in before for b in into.get(gate, [])}


def test_stage_gates_reach_all_pairs(spark):
    defs = spark.createDataFrame([("w", "1", "Extract"), ("w", "2", "Extract"), ("w", "3", "Transform"), ("w", "4", "Load"), ("w", "5", None), ("w", "6", "Other")],
                                 "workflow string, id string, stage string")
    e = [(r["pred"], r["succ"]) for r in j.stage_edges(defs, ["workflow"], ("Extract", "Transform", "Load")).collect()]
    assert reach(e) == {("1", "3"), ("2", "3"), ("3", "4")}
    # A stage without tasks breaks the order, as its neighbours are compared with it only.
    assert j.stage_edges(defs, ["workflow"], ("Extract", "Missing", "Load")).count() == 0


def test_wait_sequences(spark):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["a", "b", "wait", "c", "d", "wait", "wait", "e"])], "file string, pos int, value string")
    got = {r["value"]: (r["sequence"], r["previous"], r["previous_size"]) for r in w.wait_sequences(lines, ["file"], "pos", F.col("value") == "wait", block=3).collect()}
    assert got == {"a": (0, None, None), "b": (0, None, None), "c": (1, 0, 2), "d": (1, 0, 2), "e": (3, 1, 2)}
    loose = {r["value"]: r["previous"] for r in w.wait_sequences(lines, ["file"], "pos", F.col("value") == "wait", compact=False).collect()}
    assert loose["e"] is None and loose["c"] == 0


def definitions(spark, data):
    """(id, parameters, predecessors)"""
    df = spark.createDataFrame([("w", i, str(t), "srv", "p", json.dumps(p), q) for i, (t, p, q) in enumerate(data)],
                               "workflow string, pos long, id string, instance string, process string, parameters string, predecessors array<string>")
    return conform(df.withColumn("parameters", F.from_json("parameters", "map<string,string>")), TASK_DEFS)


def test_expand_and_remap(spark):
    elements = spark.createDataFrame([("{A}", 1, "x"), ("{A}", 2, "y"), ("{A}", 3, "z"), ("{B}", 1, "1"), ("{B}", 2, "2"), ("{C}", 1, "only")], "set_name string, element_no int, element string")
    d = definitions(spark, [(1, {"k": "v", "p*": "*{A}"}, []), (2, {"p*": "*{A}", "q*": "*{B}"}, ["1"]), (3, {"k": "v"}, ["2", "8"]), (4, {"o*": "*{C}"}, [])])
    ex = j.expand_wildcards(d, elements, ["workflow"])
    got = {r["expanded_id"]: r["parameters"] for r in ex.collect()}
    assert got == {"1_1": {"k": "v", "p": "x"}, "1_2": {"k": "v", "p": "y"}, "1_3": {"k": "v", "p": "z"}, "3": {"k": "v"}, "4": {"o": "only"},
                   **{f"2_{i}": {"p": p, "q": q} for i, (p, q) in enumerate([(p, q) for p in "xyz" for q in "12"], 1)}}
    preds = {}
    for r in j.remap_predecessors(d, ex, ["workflow"]).collect():
        preds.setdefault(r["id"], set()).add(r["predecessor"])
    assert preds == {"2": {"1_1", "1_2", "1_3"}, "3": {f"2_{i}" for i in range(1, 7)} | {"8"}}


def test_apply_order(spark):
    d = definitions(spark, [(i, {}, []) for i in (1, 2, 3, 4)])
    order = spark.createDataFrame([("w", "3", 1), ("w", "9", 2), ("w", "1", 3), ("w", "3", 4)], "workflow string, id string, rank int")
    new, dropped = j.apply_order(d, order, ["workflow"])
    assert [r["id"] for r in new.orderBy("new_pos").collect()] == ["3", "1", "2", "4"]
    assert rows(dropped) == [("w", "9")]


def test_fan_out_predecessors(spark):
    data = [(1, "r", "1", None), (2, "r", "2", ["1"]), (3, "r", "2", ["1"]), (4, "r", "3", ["2", "7"])]
    df = conform(spark.createDataFrame(data, "id long, run_id string, task_id string, predecessors array<string>"), TASKS)
    got = rows(j.fan_out_predecessors(df), "node_id", "first_node", "last_node", "predecessor_instances")
    assert got == [("2.1", "1", "1", 1), ("2.2", "1", "1", 1), ("3", "2.1", "2.2", 2)]


def test_dangling(spark):
    d = definitions(spark, [(1, {}, []), (2, {}, ["1", "5"])])
    assert rows(j.dangling_predecessors(d, ["workflow"])) == [("w", "2", "5")]


def test_validation(spark):
    cols = "file string, pos int, id string, instance string, process string, chore string, parameters map<string,string>, predecessors array<string>, timeout int, succeed_on_minor_errors boolean, cancel_at_timeout boolean"
    df = spark.createDataFrame([
        ("f", 0, "1", "s", "p", None, {}, [], None, None, None), ("f", 1, "05", "s", "p", None, {}, ["x", "1"], -1, None, None),
        ("f", 2, "", None, None, None, {}, [], None, None, None), ("f", 3, "3", "s", "p", "c", {}, [], None, None, None),
        ("f", 4, "4", "s", None, "c", {"a": "1"}, [], 0, True, False), ("f", 5, "5", "s", None, "c", {}, [], None, False, False)], cols)
    got = {}
    for r in checks.validate_tasks(df, ["file"]).collect():
        got.setdefault(r["pos"], []).append(r["rule"])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["id", "predecessor", "timeout"], 2: ["id", "one_target", "required", "required"], 3: ["one_target"],
                                                      4: ["chore_field"] * 3}
    files = spark.createDataFrame([("f", "2.0", 4, 0), ("g", None, 0, -1)], "file string, version string, max_workers int, retries int")
    dup = spark.createDataFrame([("f", 0, "1"), ("f", 1, "2"), ("f", 2, "1")], "file string, pos int, id string")
    msgs = rows(checks.validate_taskfiles(files, dup))
    assert ("f", "Task 2: Duplicate task ID '1'") in msgs and len(msgs) == 5


def test_header_contract(spark):
    good = list(UPLOAD_COLUMNS)
    swapped = good.copy()
    swapped[2], swapped[3] = swapped[3], swapped[2]
    df = spark.createDataFrame([("a", good), ("b", swapped), ("c", good[:-1]), ("d", [x.upper() for x in good])], "file string, columns array<string>")
    assert rows(checks.header_contract(df)) == [("a", True, ""), ("b", False, "task_id original_task_id"), ("c", False, "succeed_on_minor_errors"), ("d", True, "")]


def test_resume(spark):
    def plan(states, start, ids=range(1, 6)):
        st = spark.createDataFrame([("c", str(t), s, False) for t, s in states] or [("none", "0", "pending", False)], "checkpoint string, task_id string, state string, safe_retry boolean")
        defs = spark.createDataFrame([("c", str(t), i) for i, t in enumerate(ids)], "checkpoint string, task_id string, pos int")
        s = spark.createDataFrame([("c", start)], "checkpoint string, resume_from string")
        return {(r["task_id"], r["action"]) for r in j.resume_from(defs, st, s).collect()}
    assert plan([(1, "completed"), (2, "completed"), (3, "in_progress"), (4, "pending")], "3", range(1, 5)) == {("1", "completed"), ("2", "completed"), ("3", "run"), ("4", "run")}
    assert {a for _, a in plan([(i, "pending") for i in (1, 2, 3)], "1", (1, 2, 3))} == {"run"}
    assert plan([(1, "completed")], "3", (1, 2, 3)) == {("1", "completed"), ("2", "skipped"), ("3", "run")}
    assert plan([], "nope", (1,)) == {("nope", "error")}
    st = spark.createDataFrame([("c", "1", "pending", False), ("c", "2", "in_progress", True), ("c", "3", "in_progress", False), ("c", "4", "completed", True)],
                               "checkpoint string, task_id string, state string, safe_retry boolean")
    assert rows(j.resume_set(st)) == [("c", "1", "run"), ("c", "2", "run"), ("c", "3", "decide")]


def test_checkpoint_match(spark):
    a = spark.createDataFrame([("c1", "t1", "h1"), ("c2", "t2", "old"), ("c3", "gone", "x")], "checkpoint string, taskfile_path string, taskfile_hash string")
    b = spark.createDataFrame([("t1", "h1"), ("t2", "new")], "taskfile_path string, current_hash string")
    strict = {r["checkpoint"]: r for r in j.checkpoint_match(a, b).collect()}
    assert (strict["c1"]["valid"], strict["c2"]["valid"], set(strict)) == (True, False, {"c1", "c2"}) and strict["c2"]["message"].startswith("ERROR")
    loose = {r["checkpoint"]: r for r in j.checkpoint_match(a, b, strict=False).collect()}
    assert loose["c2"]["valid"] and loose["c2"]["message"].startswith("WARNING")


def test_task_with_an_unknown_set_stays(spark):
    d = spark.createDataFrame([("w", "1", {"p*": "*known", "q": "x"}), ("w", "2", {"p*": "*unknown", "r*": "*known"}), ("w", "3", {"q": "y"})],
                              "workflow string, id string, parameters map<string,string>").withColumn("chore", F.lit(None).cast("string"))
    elements = spark.createDataFrame([("known", 1, "a"), ("known", 2, "b")], "set_name string, element_no long, element string")
    got = sorted((r["id"], r["expanded_id"], tuple(sorted(r["parameters"].items()))) for r in j.expand_wildcards(d, elements, ["workflow"]).collect())
    assert got == [("1", "1_1", (("p", "a"), ("q", "x"))), ("1", "1_2", (("p", "b"), ("q", "x"))), ("2", "2", (("p*", "*unknown"), ("r*", "*known"))), ("3", "3", (("q", "y"),))]
    assert [tuple(r) for r in j.unknown_sets(d, elements, ["workflow"]).collect()] == [("w", "2", "p*", "unknown", "unknown set: unknown")]


def test_wildcards_are_numbered_as_a_product(spark, monkeypatch):
    """Any number of parameters, in chunks; stars that differ name one parameter; a null set name gives null."""
    monkeypatch.setattr(j, "COMBINATIONS", 4)
    sets = {"x": ["a", "b", "c"], "y": ["u"], "z": ["p", "q"]}
    elements = spark.createDataFrame([(s, i + 1, e) for s, es in sets.items() for i, e in enumerate(es)][::-1], "set_name string, element_no int, element string")
    tasks = [("1", {"k": "v", "m*": "*x", "n*": "*z", "o*": "x"}), ("2", {"m*": "*y"}), ("2", {"m*": "*z", "m": "old"}), ("3", {"m*": "*x", "n*": "*none"}),
             ("4", {}), ("5", None), ("6", {"m*": None, "n*": "*z"}), ("7", {"m*": "*x", "m**": "*z"})]
    pairs = [("f", i, None if p is None else list(p), None if p is None else list(p.values()), "ch") for i, p in tasks]
    defs = spark.createDataFrame(pairs, "workflow string, id string, k array<string>, v array<string>, chore string").select(
        "workflow", "id", F.when(F.col("k").isNotNull(), F.map_from_arrays("k", "v")).alias("parameters"), "chore")
    want = []
    for i, p in tasks:
        wild = [k for k in p or {} if k.endswith("*")]
        lists = [[None] if p[k] is None else sets.get(p[k].removeprefix("*")) for k in wild]
        if not wild or None in lists:
            want.append((i, i, "ch", p))
            continue
        combos = list(itertools.product(*lists))
        for no, combo in enumerate(combos, 1):
            names = [k.rstrip("*") for k in wild]
            rest = {k: v for k, v in p.items() if not k.endswith("*") and k not in names}
            want.append((i, f"{i}_{no}" if len(combos) > 1 else i, None, rest | dict(zip(names, combo))))
    got = [(r["id"], r["expanded_id"], r["chore"], r["parameters"]) for r in j.expand_wildcards(defs, elements, ["workflow"]).collect()]
    show = lambda rows: sorted(str((i, e, c, p if p is None else sorted(p.items()))) for i, e, c, p in rows)
    assert show(got) == show(want)
    assert j.expand_wildcards(defs.limit(0), elements, ["workflow"]).count() == 0
    assert j.expand_wildcards(defs, elements.limit(0), ["workflow"]).where("id = '1'").count() == 1


# ---- graphs of all sizes --------------------------------------------------------

def test_large_graphs_by_joins(spark, monkeypatch):
    """What rounds over arrays give, rounds of joins give as well."""
    monkeypatch.setattr(g, "SMALL", 0)
    test_levels_and_cycles(spark)
    test_random_graphs_with_cycles(spark)
    test_null_keys_are_a_graph(spark)


def test_small_graphs_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(g, "_counted", None)
    n, e = graph(spark, a={"1": [], "2": ["1"], "3": ["2"]}, b={"1": ["3"], "2": ["1"], "3": ["2"], "4": ["3"]})
    assert rows(g.levels(n, e, K)) == [("a", "1", 0), ("a", "2", 1), ("a", "3", 2)]
    assert rows(g.held(n, e, K)) == [("b", "1", True), ("b", "2", True), ("b", "3", True), ("b", "4", False)]
    assert rows(g.cycles(n, e, K)) == [("b", 0, "1"), ("b", 1, "2"), ("b", 2, "3")]
    assert rows(g.acyclic(n, e, K)) == [("a", 3, 0, True), ("b", 4, 4, False)]
    failed = spark.createDataFrame([("b", "3")], "run_id string, node string")
    assert rows(g.skip_closure(failed, e, n, K)) == [("b", "1", 1), ("b", "2", 2), ("b", "4", 1)]


def test_tasks_nobody_waits_for_leave_the_rounds(spark, monkeypatch):
    seen = []
    real = g._counted
    monkeypatch.setattr(g, "_counted", lambda *a: seen.append(real(*a)) or seen[-1])
    seq = spark.createDataFrame([("r", f"{s}.{i}", s, s - 1 if s else None) for s in range(60) for i in range(20)], "run_id string, id string, sequence long, previous long")
    nodes, e = g.wait_graph(seq, K)
    assert {r["node"]: r["level"] for r in g.levels(nodes, e, K).collect()} == {f"{s}.{i}": s for s in range(60) for i in range(20)}
    assert max(x[0] for x in seen[2:]) < 200
    del seen[:]
    failed = spark.createDataFrame([("r", "3.1")], "run_id string, node string")
    got = {r["node"]: r["round"] for r in g.skip_closure(failed, e, nodes, K).collect()}
    assert got == {f"{s}.{i}": s - 3 for s in range(4, 60) for i in range(20)}
    assert max(x[0] for x in seen[2:]) < 200


def test_fan_outs_of_usual_size_take_one_window(spark, monkeypatch):
    from runtally.operators import ordered
    monkeypatch.setattr(ordered, "cut", None)
    df = conform(spark.createDataFrame([(1, "r", "1", None), (2, "r", "1", None), (3, "r", "2", ["1"])], "id long, run_id string, task_id string, predecessors array<string>"), TASKS)
    assert rows(j.fan_out_predecessors(df), "node_id", "first_node", "last_node", "predecessor_instances") == [("2", "1.1", "1.2", 2)]


def test_definitions_are_dealt_before_they_expand(spark):
    """One split of definitions expands in several tasks."""
    defs = spark.range(200).selectExpr("'w' workflow", "cast(id AS string) id", "map('a*', '*s') parameters", "cast(null AS string) chore").coalesce(1)
    elements = spark.range(50).selectExpr("'s' set_name", "id element_no", "cast(id AS string) element")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r["p"] for r in j.expand_wildcards(defs, elements, ["workflow"]).select(F.spark_partition_id().alias("p")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 10_000 and len(set(got)) > 1


def test_graphs_of_hundreds_need_no_round(spark, monkeypatch):
    """F3, F8, F9, F10: a run of some hundred rows, cycles among them, lies in one task and takes no join."""
    monkeypatch.setattr(g, "_counted", None)
    n, e = graph(spark, chain={str(i): [str(i - 1)] if i else [] for i in range(120)}, ring={f"{i:03}": [f"{(i - 1) % 100:03}"] for i in range(100)})
    got = rows(g.levels(n, e, K), "run_id", "node", "level")
    assert len(got) == 120 and all(level == int(node) for _, node, level in got)
    assert rows(g.acyclic(n, e, K)) == [("chain", 120, 0, True), ("ring", 100, 100, False)]
    assert sorted((r["step"], r["node"]) for r in g.cycles(n, e, K).collect()) == [(i, f"{i:03}") for i in range(100)]
    assert g.held(n, e, K).where("run_id = 'ring' AND ahead").count() == 100
    fans = conform(spark.createDataFrame([(100 * t + i, "r", str(t), [str(t - 1), str(t - 1)] if t else None) for t in range(4) for i in range(30)], "id long, run_id string, task_id string, predecessors array<string>"), TASKS)
    nodes, edge = g.fan_out_graph(fans)
    assert edge.count() == edge.distinct().count() == 210
    assert {r["node"]: r["level"] for r in g.levels(nodes, edge, K).collect()} == {f"{t}.{i}": t for t in range(4) for i in range(1, 31)}


def test_small_graphs_with_nulls_and_repeated_rows(spark):
    n = spark.createDataFrame([("r", "1"), ("r", None), ("r", "1"), ("s", "2"), ("t", None)], "run_id string, node string")
    e = spark.createDataFrame([("r", None, "1"), ("r", None, "1"), ("r", "9", "1"), ("t", None, None), (None, "1", "2")], "run_id string, pred string, succ string")
    assert rows(g.levels(n, e, K)) == [("r", "1", 1), ("r", None, 0), ("s", "2", 0)]
    assert rows(g.acyclic(n, e, K)) == [("r", 2, 0, True), ("s", 1, 0, True), ("t", 1, 1, False)]
    assert rows(g.held(n, e, K)) == [("t", None, True)] and rows(g.cycles(n, e, K)) == [("t", 0, None)]
    failed = spark.createDataFrame([("r", None), ("s", "9")], "run_id string, node string")
    assert rows(g.skip_closure(failed, e, n, K)) == [("r", "1", 1)]


def test_batches_are_cut_between_graphs(monkeypatch):
    import pyarrow as pa

    from runtally.operators import small_graphs as few
    monkeypatch.setattr(few, "ROWS", 5)
    runs = [r for r, size in ((None, 2), ("a", 3), ("b", 7), ("c", 1)) for _ in range(size)]
    table = pa.table({"g": pa.StructArray.from_arrays([pa.array(runs)], ["run_id"]), "at": list(range(13))})
    got = [(t.column("at").to_pylist(), number.tolist()) for t, number in few._whole(table.to_batches(max_chunksize=4))]
    assert [x for at, _ in got for x in at] == list(range(13)) and len(got) > 1
    of = {x: (i, k) for i, (at, number) in enumerate(got) for x, k in zip(at, number)}
    assert len({of[i] for i in range(13)}) == 4 and all((of[i] == of[j]) == (runs[i] == runs[j]) for i in range(13) for j in range(13))


def test_skip_waits_finds_its_sequences_once(spark, tmp_path, monkeypatch):
    """the sequences feed the graph and the failed tasks; nodes are numbers in the rounds."""
    from catalog import q_graph, registry
    real, calls = q_graph.w.wait_sequences, []
    monkeypatch.setattr(q_graph.w, "wait_sequences", lambda *a, **k: calls.append(1) or real(*a, **k))
    spark.range(1100).selectExpr("id AS o_orderkey", "5L AS o_custkey", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["node"]: r["round"] for r in registry.QUERIES["skip_waits"](spark, str(tmp_path)).collect()}
    # Task 502 fails in the 14th sequence; those of 37 lines without the mark follow.
    assert got == {str(k + 1): k // 37 - 501 // 37 for k in range(1100) if k % 37 and k // 37 > 501 // 37} and len(calls) == 1
    n, e = graph(spark, r={str(i): [str(i - 1)] if i else [] for i in range(600)})
    assert dict(g._numbered(g._parts(n, e, K)[1])[1].dtypes) == {"k": "bigint", "v": "bigint", "p": "bigint"}
