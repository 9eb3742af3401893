"""Composite dominance on hand-made graphs and against a direct check."""

import random

import pytest

from forgeplan.operators import composite
from forgeplan.sources.derived import Graph


@pytest.fixture(scope="module")
def make(spark):
    def graph(n_real, recipes):
        """recipes: (output, amount, {input: amount}, stations)"""
        rows = [(k, *r) for k, r in enumerate(recipes)]
        pair, frame = "recipe_id long, item_id int, amount long", spark.createDataFrame
        return Graph(n_real, frame([(k, o, a, int(o <= n_real)) for k, o, a, _, _ in rows], "recipe_id long, anchor int, anchor_amt long, cost long"), frame([(k, o, a) for k, o, a, _, _ in rows], pair), frame([(k, i, a) for k, _, _, u, _ in rows for i, a in u.items()], pair), frame([(k, s) for k, _, _, _, ss in rows for s in ss], "recipe_id long, item_id int"))

    return graph


def test_candle(make):
    candle = make(6, [(1, 1, {2: 1, 3: 1}, [1]), (1, 1, {3: 1, 4: 256}, [1]), (2, 1, {5: 1}, [1]), (3, 1, {6: 1}, [1]), (4, 256, {2: 1}, [1]), (4, 224, {1: 1}, [1])])
    marks = {r.recipe_id: r.guard for r in composite.composite_marks(candle).collect()}
    assert marks.get(5) == 1 and 4 not in marks


def test_stations_of_all_dominators(make):
    g = make(9, [(1, 1, {2: 1, 3: 1}, [7]), (1, 1, {4: 1}, [8]), (1, 1, {3: 1}, [9]), (2, 1, {4: 1}, [9]), (3, 1, {6: 1}, [9]), (4, 1, {5: 1}, [9])])
    found = {r.recipe_id: r.stations for r in composite.composite_marks(g).collect()}
    assert found[0] == [8, 9]


def test_whole_batches(make):
    g = make(3, [(1, 1, {2: 3}, [1]), (1, 1, {3: 1}, [1]), (2, 2, {3: 1}, [1])])  # whole batches leave one of item 2 over
    losers = lambda whole: {r.recipe_id for r in composite.composite_pairs(g, whole).collect()}
    assert 0 not in losers(True) and 0 in losers(False)
    unmade = make(3, [(1, 1, {2: 3}, [1]), (1, 1, {3: 1}, [1]), (3, 1, {2: 1}, [1])])
    assert (1, 0, 2, 1) in {tuple(r) for r in composite.composite_pairs(unmade).collect()}


def test_against_the_definition(make):
    draw = random.Random(2)
    recipes = [(draw.randint(1, 4), draw.randint(1, 3), {draw.randint(1, 6): draw.randint(1, 3) for _ in range(draw.randint(0, 2))}, [1]) for _ in range(16)]
    net = [{i: (a if i == o else 0) - u.get(i, 0) for i in {o, *u}} for o, a, u, _ in recipes]
    want = set()
    for r, (x, _, used, _) in enumerate(recipes):
        for s, other in enumerate(recipes):
            if s == r or other[0] != x or x in other[2]:
                continue
            for y, q in used.items():
                good = True
                for w, (o, p, _, _) in enumerate(recipes):
                    if o == y:
                        t = -(-q // p)
                        u = {i: t * net[w].get(i, 0) + net[r].get(i, 0) for i in {*net[w], *net[r]}}
                        beaten = all(u.get(i, 0) <= net[s].get(i, 0) for i in {*u, *net[s]})
                        good &= all(v <= 0 for v in u.values()) or beaten
                if good:
                    want.add((x, r, y, s))
    assert {tuple(r) for r in composite.composite_pairs(make(6, recipes)).collect()} == want


def test_representatives_of_cycles(spark):
    pairs = spark.createDataFrame([(1, 10, 11), (1, 11, 10), (1, 12, 10), (1, 12, 13), (2, 5, 6)], "item_id int, recipe_id long, dominator long")
    assert {tuple(r) for r in composite.representatives(pairs).collect()} == {(1, 11, 10), (1, 12, 10), (1, 12, 13), (2, 5, 6)}


def test_marks_of_requests(spark):
    marks = spark.createDataFrame([(0, 2, [8, 9])], "recipe_id long, guard int, stations array<int>")
    stations = spark.createDataFrame([(1, 8), (2, 8), (3, 7)], "query_id int, item_id int")
    stock = spark.createDataFrame([(2, 2, 1), (1, 2, 0)], "query_id int, item_id int, amount long")
    assert [tuple(r) for r in composite.droppable(marks, stations, stock).collect()] == [(1, 0)]
