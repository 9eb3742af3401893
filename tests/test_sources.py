"""Codecs, options, text tables, tags, components, samples and reports on small cases."""

import json
import random

import pytest

from forgeplan.operators import components, dominance, reports, samples, tags
from forgeplan.operators.normalize import stored
from forgeplan.sources import codec, options, tables
from forgeplan.sources.codec import Malformed, Recipe
from forgeplan.sources.derived import Graph

RECIPES = [Recipe(1, 4, 1, [1, 2], [(3, 7)], [(2, 2), (300, 1)]), Recipe(1, 2**40, 5, [], [], []), Recipe(301, 1, 0, [], [], [(1, 1)])]


def test_graph_round_trip():
    data = codec.encode_graph(300, RECIPES)
    assert codec.decode_graph(data) == (300, RECIPES)
    # costs: one at least for real items, none for tags
    assert [r.cost for r in codec.decode_graph(codec.encode_graph(1, [Recipe(1, 1, 0), Recipe(2, 1, 9, [], [], [(1, 1)])]))[1]] == [1, 0]
    first = codec.GRAPH + b"\x01" + b"\x01\x01\x01\x01\x04\x01\x01\x00"  # version 1: no costs and nothing but the anchor
    assert codec.decode_graph(first) == (1, [Recipe(1, 4, 1, [1], [], [])])


@pytest.mark.parametrize("data", [b"", b"AWX\x03", b"AWR\x04\x01\x00", codec.encode_graph(300, RECIPES)[:-1], codec.encode_graph(300, RECIPES) + b"\0", b"AWR\x03\x01\x01\x00\x00", codec.encode_graph(1, [Recipe(1, 1, 1, [2])]), codec.encode_graph(1, [Recipe(1, 1, 2**31)]), codec.encode_graph(1, [Recipe(1, 1, -1)])])
def test_malformed_graphs(data):
    with pytest.raises(Malformed):
        codec.decode_graph(data)


def test_random_bytes_never_crash():
    draw = random.Random(5)
    for _ in range(500):
        data = b"AWR\x03" + draw.randbytes(draw.randint(0, 20))
        try:
            codec.decode_graph(data)
        except Malformed:
            pass


def test_graph_files(spark, tmp_path):
    (tmp_path / "a.awr").write_bytes(codec.encode_graph(300, RECIPES))
    g = codec.read_graph(spark, str(tmp_path / "a.awr"))
    assert g.n_real == 300 and g.recipes.count() == 3 and {(r.item_id, r.amount) for r in g.outputs.where("recipe_id = 0").collect()} == {(1, 4), (3, 7)}
    assert codec.write_graph(g) == codec.encode_graph(300, RECIPES)
    assert len(reports.fingerprint(spark, str(tmp_path / "a.awr")).first().sha256) == 64


def test_requests_and_responses(spark):
    good = codec.encode_request(2, 7, [1, 3], [(2, 5), (4, 1)])
    assert codec.decode_request(good) == {"target": 2, "amount": 7, "stations": [1, 3], "stock": [(2, 5), (4, 1)]}
    bad = [b"", b"AWX\x01", codec.encode_request(2, 0), codec.encode_request(2, 1) + b"\0", codec.encode_request(2, 1, [1, 1]), codec.encode_request(0, 1)]
    rows = [(0, good), (1, None), *((k + 2, b) for k, b in enumerate(bad))]
    read = codec.checked(codec.decode_requests(spark.createDataFrame(rows, "query_id long, payload binary")), 4).collect()
    assert [r.error is None for r in sorted(read)] == [True] + [False] * 7
    for k, (case, error) in enumerate([((9, 1), "unknown target"), ((1, 1, [9]), "unknown station"), ((1, 1, [], [(9, 1)]), "unknown stock")]):
        assert codec.checked(codec.decode_requests(spark.createDataFrame([(k, codec.encode_request(*case))], "query_id long, payload binary")), 4).first().error == error
    found = codec.decode_response(codec.encode_response(0, True, 0.25, 3.5, [(2, RECIPES[0]), (0, RECIPES[1])]))
    assert found["uses"] == [(2, RECIPES[0])] and (found["proven"], found["gap"], found["bound"]) == (True, 0.25, 3.5)


def test_options():
    new = options.patched(options.PLANNER, '{"flash": true, "tagInlining": 0, "pack": {"maxPackValue": 3}, "maxCostMemo": 1}')
    assert new["flash"] and new["tagInlining"] == "off" and new["pack"]["maxPackValue"] == 3 and not options.PLANNER["flash"]
    assert options.patched(options.PLANNER, options.dumped(new)) == new and options.patched(options.SOLVER, '{"flash": true, "relativeGap": 0}')["relativeGap"] == 0
    for bad in ('{"flahs": 1}', '{"flash": 1}', '{"tagInlining": 4}', '{"tagInlining": "x"}', '{"maxNeed": -1}', '{"maxNeed": true}', '{"pack": 1}', '{"pack": {"x": 1}}', "[]", "{"):
        with pytest.raises(options.BadOption):
            options.patched(options.PLANNER, bad)


def test_text_tables(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("# handle\tid\n1\tm:a\tApple\t\n2\tm:b\tApple\nx\tm:c\n0\tm:d\n")
    names = tables.names(spark, str(tmp_path / "n.tsv"))
    assert {r.alias: (r.handle, r.ambiguous) for r in tables.aliases(names).collect()} == {"m:a": (1, False), "m:b": (2, False), "Apple": (1, True)}
    (tmp_path / "s.tsv").write_text("1\t5\n1\t6\nbad\n2\t\n3\t1\n")
    assert {r.item_id: r.amount for r in tables.stock(spark, str(tmp_path / "s.tsv")).collect()} == {1: 11, 3: 1}
    (tmp_path / "t.tsv").write_text("4\tx\t1,100000\t2\t1\n")
    assert tables.targets(spark, str(tmp_path / "t.tsv")).first().amounts == [1, 100000]
    given = spark.createDataFrame([("1=5,2=6",), ("0=1",), ("9=1",), ("1",), ("",), (None,)], "t string")
    assert [(r.error is None, len(r.stock or [])) for r in tables.inventory(given, "t", 3).collect()] == [(True, 2), (False, 0), (False, 0), (False, 0), (True, 0), (True, 0)]
    row = {"stage": "a", "target": 1, "amount": 1, "stock": "n", "repeat": 0, "cost": 5}
    (tmp_path / "r.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"repeat": 1}) + "\n" + json.dumps(row)[:20])
    done = tables.results(spark, str(tmp_path / "r.jsonl"), "stage string, target long, amount long, stock string, repeat int, cost long")
    assert done.count() == 2
    points = tables.points(["a", "b"], spark.createDataFrame([(1,)], "handle long"), [1], ["n"], 2)
    assert points.count() == 4 and {r.stage for r in tables.missing_points(points, done).collect()} == {"b"}
    from pyspark.sql import functions as F

    later = done.withColumn("cost", F.lit(9).cast("long"))
    assert {r.cost for r in tables.combined([done, later]).collect()} == {5} and {r.cost for r in tables.replace_stage(done, later).collect()} == {9}


@pytest.fixture(scope="module")
def make(spark):
    def graph(n_real, recipes):
        """recipes: ({output: amount}, {input: amount}, stations); the first output is the anchor"""
        rows = [(k, *r) for k, r in enumerate(recipes)]
        pair, frame = "recipe_id long, item_id int, amount long", spark.createDataFrame
        heads = [(k, next(iter(o)), next(iter(o.values())), int(next(iter(o)) <= n_real)) for k, o, _, _ in rows]
        return Graph(n_real, frame(heads, "recipe_id long, anchor int, anchor_amt long, cost long"), frame([(k, i, a) for k, o, _, _ in rows for i, a in o.items()], pair), frame([(k, i, a) for k, _, u, _ in rows for i, a in u.items()], pair), frame([(k, s) for k, _, _, ss in rows for s in ss], "recipe_id long, item_id int"))

    return graph


def inputs(g, recipe):
    return {r.item_id: r.amount for r in g.inputs.where(f"recipe_id = {recipe}").collect()}


def test_inlining(make):
    one = tags.inline_single_members(make(3, [({1: 1}, {4: 2, 2: 3}, [1]), ({4: 1}, {2: 1}, [])]))
    assert one.recipes.count() == 1 and inputs(one, 0) == {2: 5}
    # recipe 0 opens tag 5 only, recipe 1 takes two of its tag, recipe 2 shares tag 7 with recipe 3
    g = make(4, [({1: 1}, {5: 1, 3: 1}, [1]), ({2: 1}, {6: 2}, [1]), ({3: 1}, {7: 1}, [1]), ({4: 1}, {7: 1}, [1]), *(({t: 1}, {m: 1}, []) for t in (5, 6, 7) for m in (3, 4))])
    many = tags.inline_single_uses(g)
    copies = [r.recipe_id for r in many.recipes.where("anchor = 1").orderBy("recipe_id").collect()]
    assert sorted(sorted(inputs(many, k).items()) for k in copies) == [[(3, 1), (4, 1)], [(3, 2)]] and many.stations.where(f"recipe_id = {copies[0]}").count() == 1
    assert many.outputs.where("item_id = 5").count() == 0 and many.outputs.where("item_id IN (6, 7)").count() == 4
    assert {r.tag: r.admitted for r in tags.within_budget(g, 1024, 8).collect()} == {5: True, 6: True, 7: False}


def test_tag_exclusive(spark, make):
    # 2 and 3 only feed tag 6, which recipe 3 consumes; item 4 is also eaten by recipe 4
    g = make(5, [({2: 1}, {3: 1}, [1]), ({3: 2}, {2: 1}, [1]), ({4: 1}, {2: 1}, [1]), ({1: 1}, {6: 1}, [1]), ({5: 1}, {4: 1}, [1]), ({6: 1}, {4: 1}, [])])
    assert tags.tag_exclusive(g).count() == 0
    g = make(5, [({2: 1}, {4: 1}, [1]), ({2: 2}, {4: 1}, [1]), ({1: 1}, {6: 1}, [1]), ({5: 1}, {4: 1}, [1]), ({6: 1}, {2: 1}, []), ({6: 1}, {4: 1}, [])])
    assert [r.recipe_id for r in tags.tag_exclusive(g).collect()] == [0]
    assert tags.tag_exclusive(g, spark.createDataFrame([(2,)], "item_id int")).count() == 0
    assert sorted(r.item_id for r in tags.drop_unused_items(g, spark.createDataFrame([(9,)], "item_id int")).collect()) == [1, 2, 4, 5, 6, 9]


def test_per_unit_and_repair(spark, make):
    g = stored(make(3, [({1: 1}, {2: 2}, [1]), ({1: 4}, {2: 4}, [2]), ({1: 8}, {2: 8}, [3])]))
    # equal columns of different batches beat each other nowhere, whatever they cost a unit
    assert {tuple(r) for r in dominance.per_unit_pairs(g).collect()} == {(1, 0, 1), (1, 0, 2)}
    marked = spark.createDataFrame([(0,), (1,), (2,)], "recipe_id long")
    assert sorted(r.recipe_id for r in dominance.repaired(g, marked).collect()) == [1, 2]
    use = dominance.usable(dominance.direct_marks(g, dominance.per_unit_pairs(g)), spark.createDataFrame([(5, 3), (6, 1)], "query_id int, item_id int"))
    assert [tuple(r) for r in use.collect()] == [(5, 0)]


def test_components(spark):
    draw = random.Random(1)
    edges = {(draw.randint(1, 14), draw.randint(1, 14)) for _ in range(20)}
    reach = {v: {v} for v in range(1, 15)}
    for _ in range(15):
        for a, b in edges:
            reach[a] |= reach[b]
    nodes = {v for e in edges if e[0] != e[1] for v in e}
    want = {v: max(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes}
    got = components.strong_components(spark.createDataFrame(sorted(edges), "a int, b int"))
    assert {r.node: r.component for r in got.collect()} == want


def test_component_statistics(make):
    g = stored(make(5, [({1: 1}, {2: 1}, [1]), ({2: 1}, {3: 1}, [1]), ({3: 1}, {2: 1, 4: 1}, [1])]))
    assert tuple(components.statistics(g).first()) == (3, 2, 2, 1, 1)


def test_samples(spark, make):
    g = make(20, [({k: 1}, {k + 1: 1}, [k]) for k in range(1, 11)])
    ids = lambda df: [r.item_id for r in df.orderBy("item_id").collect()]
    assert ids(samples.targets(g, 4, 1)) == ids(samples.targets(g, 4, 1)) and len(ids(samples.targets(g, 99, 1))) == 10
    assert samples.random_stock(g, 1).count() == 4 and ids(samples.leaf_stock(g)) == [11]
    names = spark.createDataFrame([(1, "minecraft:a"), (2, "x:b")], "handle int, resource_id string")
    some = ids(samples.stations(g, names, 0.5, 7))
    assert len(some) == 6 and 1 in some and len(ids(samples.stations(g, names, 1.0, 7))) == 20
    assert samples._stream(1234567, 2).tolist() == [6457827717110365317, 3203168211198807973]


def test_reports(spark):
    rows = spark.createDataFrame([("a", "ok", True, 10, 4.0, None, None, None), ("a", "ok", False, 30, None, 6.0, None, None), ("a", "timeout", None, None, None, None, 1.0, None), ("a", "infeasible", None, None, None, None, 1.0, 2.0)], "k string, status string, proven_optimal boolean, cost long, plan_ms double, query_ms double, reach_ms double, solve_ms double")
    truth = spark.createDataFrame([("a", True, 10)], "k string, true_feasible boolean, best_cost long")
    r = reports.summary(reports.with_truth(reports.derived(rows), truth, ["k"]), ["k"]).first()
    assert (r.n, r.feasible, r.proven, r.unproven, r.no_answer, r.compared, r.agree, r.false_positive, r.plan_ms, r.cost_ratio) == (4, 2, 1, 1, 1, 3, 2, 0, 3.5, 2.0)


def test_readings(spark, tmp_path):
    from forgeplan.sources.readings import readings

    (tmp_path / "p.txt").write_text("# head\nU+77F3: shí,dàn  # 石\nU+5973: nǚ,rǔ,nǜ  # 女\nU+0041: a\nU+884C: háng, xíng\nbad\n", encoding="utf-8")
    assert {r.character: r.readings for r in readings(spark, str(tmp_path / "p.txt")).collect()} == {"石": ["shi", "dan"], "女": ["nv", "nu", "ru"], "行": ["hang", "xing"]}
