"""Planning operators on hand-made graphs, and the name search on its reference corpus."""

from dataclasses import replace

import pytest

from forgeplan.operators import balance, dominance, normalize, reach, search
from forgeplan.plans import registry
from forgeplan.sources.derived import Graph

#: Names (handle, id, English, Chinese), readings, and the handles that each query must give, in order.
NAMES = [
    (1, "minecraft:stone", "Stone", "石头"), (2, "minecraft:redstone", "Redstone", "红石"), (3, "minecraft:stonecutter", "Stonecutter", "切石机"), (4, "minecraft:iron_ingot", "Iron Ingot", "铁锭"),
    (5, "mekanism:shadow_iron_ingot", "Shadow Iron Ingot", "暗影铁锭"), (6, "minecraft:gold_ingot", "Gold Ingot", "金锭"), (7, "minecraft:iron_ore", "Iron Ore", "铁矿石"), (8, "minecraft:mace", "Mace", "重锤"),
    (9, "test:girl", "Girl", "女孩"), (10, "test:girls_room", "Girl's Room", "女孩的房间"), (11, "extradisks:1024k_item_storage_block", "1024K Item Storage Block", "1024K物品存储方块"), (12, "test:mana_powder", "Mana Powder", "魔力粉"), (13, "test:bank", "Bank", "银行"),
]
READINGS = {"石": ["shi"], "头": ["tou"], "红": ["hong"], "切": ["qie"], "机": ["ji"], "铁": ["tie"], "锭": ["ding"], "暗": ["an"], "影": ["ying"], "金": ["jin"], "矿": ["kuang"], "重": ["zhong", "chong"], "锤": ["chui"], "女": ["nv", "nu"], "孩": ["hai"], "的": ["de"], "房": ["fang"], "间": ["jian"], "物": ["wu"], "品": ["pin"], "存": ["cun"], "储": ["chu"], "方": ["fang"], "块": ["kuai"], "魔": ["mo"], "力": ["li"], "粉": ["fen"], "银": ["yin"], "行": ["hang", "xing"]}
WANTED = {
    "tied": [4, 5], "td": [4, 5], "TD": [4, 5], "ied": [], "shadow iron": [5], "iron ingot": [4, 5], "shadow ingot": [5], "shadowironingot": [], "minecraft stone": [1, 3], "stone": [1, 3, 2],
    "铁锭": [4, 5], "暗铁": [], "影铁": [5], "chongchui": [8], "zhongchui": [8], "chui": [8], "nvhai": [9, 10], "nuhai": [9, 10], "aytd": [5], "ytd": [5], "1024k": [11], "wupincun": [11], "物品存储": [11],
    "mana": [12], "mlf": [12], "bank": [13], "yinhang": [13], "yin xing": [13], "girl": [9, 10], "room": [10], "": [], "--": [],
}


def test_search(spark):
    names = spark.createDataFrame(NAMES, "handle long, resource_id string, name_en string, name_zh string")
    asked = list(WANTED)
    rows = search.search(search.indexed(names, READINGS), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 50).collect()
    got = {q: [r.handle for r in sorted(rows, key=lambda r: r.rank) if r.query_id == i] for i, q in enumerate(asked)}
    assert got == WANTED


@pytest.fixture(scope="module")
def make(spark):
    def graph(n_real, recipes):
        """recipes: (output, amount, {input: amount}, stations, cost)"""
        rows = [(i, *r) for i, r in enumerate(recipes)]
        frame = spark.createDataFrame
        return Graph(
            n_real, frame([(i, o, a, c) for i, o, a, _, _, c in rows], "recipe_id long, anchor int, anchor_amt long, cost long"), frame([(i, o, a) for i, o, a, *_ in rows], "recipe_id long, item_id int, amount long"),
            frame([(i, k, v) for i, _, _, ins, _, _ in rows for k, v in ins.items()], "recipe_id long, item_id int, amount long"), frame([(i, s) for i, _, _, _, ss, _ in rows for s in ss], "recipe_id long, item_id int"),
        )

    return graph


def ids(df):
    return sorted(r.recipe_id for r in df.collect())


def test_duplicates_share_stations(make):
    g = normalize.normalized(make(3, [(1, 1, {2: 1}, [1], 1), (1, 1, {2: 1}, [2, 3], 1), (1, 2, {2: 1}, [1], 1), (1, 1, {2: 2}, [1], 1)]))
    assert ids(g.recipes) == [0, 2, 3]
    assert sorted(r.item_id for r in g.stations.where("recipe_id = 0").collect()) == [1, 2, 3]


def test_lossy_and_stationless_recipes_go(make):
    assert ids(normalize.normalized(make(1, [(1, 1, {1: 1}, [1], 1), (1, 1, {1: 2}, [1], 1), (1, 3, {1: 1}, [1], 1)])).recipes) == [2]
    assert ids(normalize.normalized(make(2, [(1, 4, {2: 2}, [], 1), (1, 1, {2: 5}, [1, 2], 1)])).recipes) == [1]
    zero = normalize.normalized(make(2, [(1, 4, {2: 2}, [1], 1), (1, 1, {1: 0, 2: 1}, [1], 1), (1, 1, {1: 0, 2: 1}, [2], 1), (1, 5, {1: 0}, [1], 1)]))
    assert zero.recipes.count() == 3 and zero.inputs.count() == 2


def test_direct_dominance(make):
    g = make(5, [(1, 2, {2: 2}, [4], 1), (1, 2, {2: 1}, [5], 1), (2, 1, {3: 1}, [4], 1)])
    assert [tuple(r) for r in dominance.direct_dominance(g).collect()] == [(0, 1, 1)]
    assert [tuple(r) for r in dominance.usable(dominance.direct_marks(g), g.recipes.sparkSession.createDataFrame([(0, 4), (1, 5)], 'query_id int, item_id int')).collect()] == [(1, 0)]
    # a sibling that eats the item itself beats nobody; scaled recipes are not comparable
    assert dominance.direct_pairs(make(3, [(1, 1, {2: 3}, [1], 1), (1, 1, {1: 1}, [1], 1)])).count() == 0
    assert dominance.direct_pairs(make(3, [(1, 1, {2: 3}, [1], 1), (1, 1, {3: 1}, [1], 1)])).count() == 0


def test_walk_and_closure(spark, make):
    g = make(4, [(1, 1, {5: 1}, [3], 1), (1, 1, {3: 1}, [4], 1), (5, 1, {1: 1}, [], 0), (5, 1, {2: 1}, [], 0)])
    targets = spark.createDataFrame([(0, 1), (1, 1), (2, 99)], "query_id int, item_id int")
    items, recipes = reach.walk(g, targets, spark.createDataFrame([(0, 3), (2, 3)], "query_id int, item_id int"))
    of = lambda df, q, c: sorted(r[c] for r in df.collect() if r.query_id == q)
    assert of(items, 0, "item_id") == [1, 2, 5] and of(recipes, 0, "recipe_id") == [0, 2, 3]
    assert of(items, 1, "item_id") == [1] and of(recipes, 2, "recipe_id") == []
    have, runs = reach.fireable(g, recipes, spark.createDataFrame([(0, 2)], "query_id int, item_id int"))
    assert of(have, 0, "item_id") == [1, 2, 5] and of(runs, 0, "recipe_id") == [0, 2, 3]
    assert reach.fireable(g, recipes, targets.limit(0))[0].count() == 0


def test_balance(spark, make):
    g = make(2, [(1, 1, {2: 1}, [1], 1), (2, 2, {1: 1}, [2], 1)])
    runs = spark.createDataFrame([(0, 0, 8), (0, 1, 4)], "query_id int, recipe_id long, cnt long")
    demand = spark.createDataFrame([(0, 1, 4)], "query_id int, item_id int, amount long")
    assert {r.item_id: (int(r.balance), int(r.missing)) for r in balance.balances(g, runs, demand).collect()} == {1: (0, 0), 2: (0, 0)}
    assert balance.costs(g, runs).first().objective == 12


def test_registry_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_byproducts_count_in_dominance(spark, make):
    """1x1 + 2x5 <- 3x1 is not beaten by 1x1 <- 3x1, which it beats; pairs against columns compared one by one."""
    import random

    rng = random.Random(4)
    recipes = [({1: 1, 2: 5}, {3: 1}), ({1: 1}, {3: 1})] + [({k: rng.randint(1, 3) for k in rng.sample(range(1, 4), rng.randint(1, 2))}, {k: rng.randint(0, 3) for k in rng.sample(range(1, 6), rng.randint(0, 2))}) for _ in range(40)]
    cost = [1, 1, *(rng.randint(1, 2) for _ in range(40))]
    g = make(5, [(min(o), o[min(o)], i, [1], c) for (o, i), c in zip(recipes, cost)])
    g = replace(g, outputs=spark.createDataFrame([(k, i, a) for k, (o, _) in enumerate(recipes) for i, a in o.items()], "recipe_id long, item_id int, amount long"))
    net = lambda k: {i: recipes[k][0].get(i, 0) - recipes[k][1].get(i, 0) for i in range(1, 6)}
    raw, unit = set(), set()
    for x in range(1, 6):
        makers = [k for k, (o, _) in enumerate(recipes) if x in o]
        for r in makers:
            for s in makers:
                if r != s and cost[s] <= cost[r] and not recipes[s][1].get(x, 0):
                    a, b, p, q = net(r), net(s), recipes[r][0][x], recipes[s][0][x]
                    if p <= q and all(a[i] <= b[i] for i in a):
                        raw.add((x, r, s))
                    if all(a[i] * q <= b[i] * p for i in a) and any(a[i] * q < b[i] * p for i in a):
                        unit.add((x, r, s))
    assert {tuple(r) for r in dominance.direct_pairs(g).collect()} == raw and (1, 1, 0) in raw and (1, 0, 1) not in raw
    assert {tuple(r) for r in dominance.per_unit_pairs(g).collect()} == unit


def test_pinyin_variants_of_long_names():
    import itertools

    from forgeplan.functions.text import pinyin_variants

    readings = {"a": ["x", "y", "z"], "b": ["u", "v"], "c": ["w"]}
    for name in ("ab", "abc", "cacb", "aab", "bbbb"):
        each = [readings[c] for c in name]
        want = sorted(itertools.product(*(range(len(r)) for r in each)), key=lambda p: (sum(map(bool, p)), p))[:8]
        assert [v for v, _ in pinyin_variants(name, readings)] == [[r[k] for r, k in zip(each, p)] for p in want]
    assert len(pinyin_variants("ab" * 200, readings)) == 8


def test_tag_edges_are_open_to_requests_without_stations(spark, make):
    g = make(3, [(4, 1, {1: 1}, [], 0), (4, 1, {2: 1}, [], 0)])
    none = spark.createDataFrame([], "query_id int, item_id int")
    items, recipes = reach.walk(g, spark.createDataFrame([(7, 4)], "query_id int, item_id int"), none)
    assert sorted(r.item_id for r in items.collect()) == [1, 2, 4] and recipes.count() == 2
