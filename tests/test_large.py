"""What keeps queries within bounds on large tables: few exchanges, no caps, no row that grows with the catalogue."""

import random
import re
from dataclasses import replace

import pytest

from forgeplan.operators import composite, dominance, normalize, search
from forgeplan.sources import derived, sinks

SMALL = "/root/testdata/sf0.001"


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("byproducts", [False, True])
def test_packed_recipes_are_the_tables(spark, byproducts):
    """Every line is dealt out twice, to its part and to its order, and equal recipes once more."""
    g = derived.graph(spark, SMALL, byproducts)
    rows = normalize.unpacked(g.n_real, g.packed)
    for name in ("recipes", "outputs", "inputs", "stations"):
        want, got = getattr(g, name), getattr(rows, name)
        assert want.exceptAll(got.select(*want.columns)).isEmpty() and got.count() == want.count(), name
    flat = normalize.packed(replace(g, packed=None))
    key = lambda df: sorted((r.recipe_id, r.anchor, r.anchor_amt, r.cost, sorted(r.outs), sorted(r.ins), sorted(r.stations)) for r in df.collect())
    assert key(flat) == key(g.packed)
    assert exchanges(normalize.canonicalize(normalize.drop_useless(g)).packed) <= 4


def test_rows_are_numbered_without_one_task_for_all(spark):
    g = normalize.stored(derived.graph(spark, SMALL))
    numbered = sinks.renumbered(g)
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in numbered.orderBy("recipe_id").collect()] == [(r.recipe_id, k) for k, r in enumerate(g.recipes.orderBy("recipe_id").collect())]


@pytest.fixture(scope="module")
def make(spark):
    def graph(n_real, recipes):
        """recipes: (output, amount, {input: amount})"""
        rows, pair = list(enumerate(recipes)), "recipe_id long, item_id int, amount long"
        frame = lambda data, kind: spark.createDataFrame(data, kind).coalesce(2)
        return derived.Graph(n_real, frame([(k, o, a, 1) for k, (o, a, _) in rows], "recipe_id long, anchor int, anchor_amt long, cost long"), frame([(k, o, a) for k, (o, a, _) in rows], pair), frame([(k, i, n) for k, (_, _, u) in rows for i, n in u.items()], pair), frame([(k, n_real) for k, _ in rows], "recipe_id long, item_id int"))

    return graph


def test_items_of_many_makers_are_compared(make):
    g = make(2, [(1, k, {2: k}) for k in range(1, 2060)] + [(1, 5000, {2: 1})])
    assert {tuple(r) for r in dominance.direct_pairs(g).collect()} == {(1, k, 2059) for k in range(2059)}
    assert dominance.per_unit_pairs(g).where("dominator = 2059").count() == 2059


def test_inputs_of_many_makers_prove(make):
    g = make(4, [(1, 1, {2: 1}), (1, 1, {3: 1}), (3, 7000, {4: 1})] + [(2, 1, {3: k}) for k in range(1, 2060)])
    assert (1, 0, 2, 1) in {tuple(r) for r in composite.composite_pairs(g).where("item_id = 1").collect()}


def test_few_and_many_makers_agree(make):
    draw = random.Random(5)
    g = make(6, [(draw.randint(1, 3), draw.randint(1, 3), {draw.randint(1, 6): draw.randint(1, 3) for _ in range(draw.randint(0, 3))}) for _ in range(60)])
    for pairs in (dominance.direct_pairs, dominance.per_unit_pairs):
        want = sorted(map(tuple, pairs(g).collect()))
        assert want and sorted(map(tuple, pairs(g, few=2).collect())) == want


def test_names_are_dealt_out(spark):
    names = spark.createDataFrame([(1, "a:stone", "Stone", None)], "handle long, resource_id string, name_en string, name_zh string").coalesce(1)
    found = search.search(search.indexed(names), spark.createDataFrame([(0, "stone")], "query_id int, query string"), 5)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 0)]
