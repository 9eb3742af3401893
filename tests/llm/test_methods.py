"""The operators' methods against definitions and brute force, and every case of nulls, repeats, long texts and clashing names."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forgeplan.llm import decontamination, language_id, licenses, packing, preferences, quality_model, quality_rules, secrets, simhash, substrings
from forgeplan.llm.common import is_held_out, looked_up, unused

SF = "/root/testdata/sf0.01"
NAMES = "kept_id kept_hash text_hash secret_spans leak_hash spans score lang_pred doc_hash n".split()


def some(rng, n):
    return ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n)]


@pytest.fixture(scope="module")
def clash(spark):
    """Rows with nulls, blanks, repeats, a very long text, and columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One token=abcdefghijklmnop."), (4, "One token=abcdefghijklmnop."), (None, "no id"), (None, "no id"), (5, "word " * 40000)]
    return spark.createDataFrame([(*r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))


def values(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_rows_keep_their_other_columns(spark, clash):
    bench = spark.createDataFrame([(1, "no id")], "item_id long, text string")
    whole = values(clash, ["doc_id", *NAMES])
    assert values(secrets.redacted(clash), ["doc_id", *NAMES]) == whole
    masked = {r.text for r in secrets.redacted(clash).where("doc_id = 4").collect()}
    assert masked == {"One [SECRET]"}
    assert values(decontamination.decontaminated(clash, bench), ["doc_id", *NAMES]) == [v for v in whole if v[0] is not None]
    kept = values(simhash.deduplicated(clash), ["doc_id", *NAMES])
    assert set(kept) <= set(whole) and sorted((k[0] for k in kept), key=str) == [1, 4, 5, None]
    assert unused("n", ["N", "_n"]) == "__n"


def test_ids_of_any_type(spark):
    rng = np.random.default_rng(0)
    shared = " ".join(some(rng, 60))
    docs = spark.createDataFrame([("b", shared), ("a", f"{shared} {' '.join(some(rng, 9))}"), (None, "x y")], "doc_id string, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} >= {"a"}
    assert {(r.doc_id, r.class_id) for r in substrings.passages(docs).collect()} == {("a", "a"), ("b", "a")}
    assert {r.doc_id for r in packing.packed(docs).collect()} == {"a", "b", None}
    assert secrets.report(docs).count() == quality_rules.report(docs, lang_col=None).count() == licenses.report(docs).count() == 3


def test_clashing_results(spark, clash):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    model = quality_model.fit(clash, labels)
    assert sorted(quality_model.scored(clash, model).columns) == sorted(clash.columns)
    assert quality_rules.report(clash, lang_col=None).count() == 8
    f = language_id.fit(clash.withColumn("lang", F.lit("x")))
    assert language_id.predicted(clash, f).count() == 8
    assert licenses.report(clash).count() == 8
    assert substrings.passages(clash).select("doc_id").distinct().count() == 0
    with pytest.raises(ValueError):
        packing.packed(clash.withColumn("length", F.lit(1)), keep=["length"])


def test_hot_keys_meet_a_broadcast_row(spark):
    rows = spark.range(1 << 21).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = looked_up(rows, lookup, "k", "n", 1 << 21)
    assert got.count() == 1 << 21 and got.where("k = 0").select("top").distinct().count() == 1


# packing


@given(st.lists(st.integers(1, 4096), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_bins_at_the_shipped_sizes(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, final = packing.pack(lengths)
    used = Counter()
    for n, b in zip(lengths, bins):
        used[b] += n
    assert all(final[b] == min(c for c in packing.SIZES if c >= used[b]) for b in used)
    total = sum(map(packing.cost, final))
    for openable in ((1024,), (2048,), (4096,), (1024, 2048, 4096)):  # no single choice of sizes is cheaper
        alone, opened = packing.best_fit(lengths, packing.SIZES, openable)
        assert total <= sum(packing.cost(c) for c in packing.downsized(lengths, alone, packing.SIZES)) <= sum(map(packing.cost, opened))


def test_joint_sizes_are_cheaper_than_one_size():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 1500, 4096).tolist(), reverse=True)
    bins, final = packing.pack(lengths)
    alone, _ = packing.best_fit(lengths, (4096,), (4096,))
    assert sum(map(packing.cost, final)) < 0.99 * packing.cost(4096) * (max(alone) + 1)
    # each bin in turn is opened at the least cost a place that holds its piece, and ends at the least size for its contents
    bins, opened = packing.best_fit([3000, 1500, 900], packing.SIZES, (2048,))
    assert (bins, opened) == ([0, 1, 0], [4096, 2048])
    bins, opened = packing.best_fit([1500, 900], packing.SIZES, (2048,))
    assert opened == [2048, 2048] and packing.downsized([1500, 900], bins, packing.SIZES) == [2048, 1024]


def test_bins_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(i, "w " * n) for i, n in [(5, 64), (5, 64), (None, 64), (None, 64), (5, 70), (None, 70), (6, 0), (7, 3)] * 5], "doc_id long, text string")
    for sizes in ((16, 32), packing.SIZES):
        rows = packing.packed(docs, sizes=sizes, group_size=7).collect()
        used = Counter()
        for r in rows:
            used[r.bin_id, r.bin_size] += r.length
        assert all(n <= size for (_, size), n in used.items()) and len({b for b, _ in used}) == len(used)
        assert sum(r.length for r in rows) == 5 * (4 * 64 + 2 * 70 + 3)


# secrets


def test_battery_against_its_definitions(spark):
    rng = np.random.default_rng(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    runs = ["".join(rng.choice(list(a), n)) for a in (alphabet, alphabet[26:52], "0123456789ABCDEF", "0123456789") for n in (24, 40, 90, 200)] + ["internationalizationofficecommitteemeeting", "ab" * 20]

    def tail(z):
        return 0.5 * math.erfc(abs(z) / math.sqrt(2))

    def lower(z):
        return tail(z) if z < 0 else 1 - tail(z)

    def expected(s):
        n, digits = len(s), s.isdigit()
        hexed = not digits and (set(s) <= set("0123456789abcdef") or set(s) <= set("0123456789ABCDEF"))
        letters = s.isalpha() and (s.islower() or s.isupper())
        k = 16 if hexed else 10 if digits else 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 10 * any(c.isdigit() for c in s)
        over = k * (0.14 if hexed or digits else 0.066) - 1
        d = k / n * sum(v * v for v in Counter(s).values()) - n - (k - 1)
        even, natural = d / math.sqrt(2 * (k - 1)), (d - n * over) / math.sqrt(2 * (k - 1) + 4 * n * over)
        members = "56789" if digits else "0123456789" if hexed else "aeiouAEIOU" if letters else alphabet[26:52]
        kind = [c in members for c in s]
        m, turns = sum(kind), 1 + sum(a != b for a, b in zip(kind, kind[1:]))
        mean = 1 + 2 * m * (n - m) / n
        runs_z = 0 if m in (0, n) else (turns - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        at = np.array([secrets.ALPHABET.index(c) + 1.0 for c in s])
        at -= at.mean()
        serial = 99.0 if not (at @ at) else at[1:] @ at[:-1] / (at @ at) * math.sqrt(n)
        structure = min(1, 3 * min(lower(-even), 2 * tail(runs_z), 2 * tail(serial)))
        ordinary = lower(natural)
        if letters:
            p = ordinary * lower((m / n - 0.38) * math.sqrt(n / (0.38 * 0.62)))
            ordinary = p * (1 - math.log(max(p, 1e-300)))
        return max(structure, 1e-19), max(ordinary, 1e-19)

    df = spark.createDataFrame(list(enumerate(runs)), "i int, v string").select("i", secrets.randomness(F.col("v")).alias("t"))
    for r in df.collect():
        assert (r.t.structure, r.t.ordinary) == pytest.approx(expected(runs[r.i]), rel=0.02)


def test_false_discovery_control_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = np.concatenate([rng.random(int(rng.integers(1, 60))), 10.0 ** -rng.uniform(2, 15, int(rng.integers(0, 9)))])
        at = np.minimum(secrets.BINS - 1, np.floor(-10 * np.log10(p))).astype(int)
        rounded = np.sort(10.0 ** (-at / 10))  # every p-value of a bin counts as its largest
        passed = np.flatnonzero(rounded <= 0.01 * (np.arange(len(p)) + 1) / len(p))
        cut = secrets.least_bin(Counter(at.tolist()), 0.01)
        assert sum(at >= cut) == (passed.max() + 1 if len(passed) else 0)


def test_random_runs_are_found_and_prose_is_not(spark):
    rng = np.random.default_rng(4)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    words = "system internal process control network service transport account manager station".split()
    docs = [(k, "see " + "".join(rng.choice(alphabet, 48)) + " now") for k in range(100)] + [(100 + k, "".join(rng.choice(words, 5)) + " and more") for k in range(300)] + [(400, "key " + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 160)))]
    rows = {r.doc_id: r.n_random for r in secrets.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(rows[k] for k in range(100)) >= 95 and sum(rows[k] for k in range(100, 400)) <= 2 and rows[400] == 1


# decontamination


def test_scattered_parts_are_no_item(spark):
    rng = np.random.default_rng(5)
    item = some(rng, 20)
    far = [*item[:7], *some(rng, 60), *item[7:14], *some(rng, 60), *item[14:]]
    put_in = [*item[:10], *some(rng, 3), *item[10:]]
    left_out = [*item[:9], *item[11:]]
    numbers = "12 7 Paris 19 44 London 3 8 15 Rome 21".split()
    docs = [(1, far), (2, put_in), (3, left_out), (4, [*some(rng, 5), *numbers, *some(rng, 5)]), (5, "9 1 Oslo 2 3 Bern 4 5 6 Bonn 7".split()), (6, ["so", "yes", "it", "is"])]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(numbers)), (3, "yes it")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(spark.createDataFrame([(k, "a start " + " ".join(t)) for k, t in docs], "doc_id long, text string"), bench).collect()}
    assert got == {(2, 1), (3, 1), (4, 2), (6, 3)}


# licences


def test_wrapped_notices_and_the_prefilter(spark):
    header = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    texts = ["/*\n" + header, "Licensed under the Apache License,\nVersion 2.0", header.replace("\n", "\n\n"), "Released under\nthe MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in licenses.report(docs).orderBy("doc_id").collect()] == ["BSD", "Apache", "", "MIT"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert licenses.report(whole).exceptAll(licenses.report(whole, prefilter=False)).count() == 0


# classifier, languages, quality rules


def test_ftrl_against_its_definition():
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(2)), np.sort(rng.choice(16, 5, replace=False)), rng.random(5)) for _ in range(40)]
    z, n = [0.0] * 17, [0.0] * 17
    alpha, beta, l1, l2 = 0.3, 0.1, 0.02, 0.01

    def weight(i):
        rate = 0.0 if i == 16 else l1
        return 0.0 if abs(z[i]) <= rate else -(z[i] - math.copysign(rate, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for y, j, x in rows:
            pairs = [*zip(j.tolist(), x.tolist()), (16, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    model = quality_model.ftrl(rows, 4)
    assert model.dense() == pytest.approx([weight(i) for i in range(16)]) and model.intercept == pytest.approx(weight(16))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs, labels)
    seen = quality_model.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(is_held_out()).collect()
    assert sum((r.score >= 0.5) == r.quality for r in seen) >= 0.95 * len(seen) > 0
    found = language_id.predicted(docs, language_id.fit(docs)).where(is_held_out() & F.col("lang").isNotNull()).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0
    kept = quality_rules.report(docs).join(labels, "doc_id").where("NOT base_failed AND quality = 1").collect()
    assert sum(r.kept for r in kept) >= 0.98 * len(kept) > 0


def test_bit_slices_are_sets(spark):
    """Counts by language against sets of n-grams, and the correction by the filters' own false positives."""
    rng = np.random.default_rng(7)
    docs = [(k, " ".join("".join(rng.choice(list("abcdefgh" if k % 70 < 35 else "qrstuvwx"), 6)) for _ in range(30)), f"l{k % 70:02d}") for k in range(420)]
    f = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(f.languages) == 70 and f.rows.shape[1] == 2  # beyond one word of bits
    table = language_id.letters()
    held = [docs[k][1] for k in range(0, 40)]
    total, own, lettered = language_id.counts(pa.array(held), f, table)
    for i, t in enumerate(held):
        h = np.concatenate([x for _, x, _ in language_id.grams([t], table)])
        member = np.ones((len(h), len(f.languages)), bool)
        for at in language_id.places(h, 18, f.hashes):
            for j in range(len(f.languages)):
                member[:, j] &= (f.rows[at, j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(bool)
        assert total[i] == len(h) and own[i].tolist() == member.sum(axis=0).tolist() and lettered[i]
    outside = np.random.default_rng(8).integers(0, 2**63, 200_000).astype(np.uint64)
    mask = np.full(len(outside), 2**64 - 1, np.uint64)
    for at in language_id.places(outside, 18, f.hashes):
        mask &= f.rows[at, 0]
    assert (mask & np.uint64(1)).mean() == pytest.approx(f.rates[0], abs=3e-3)


def test_medians_of_bands():
    rng = np.random.default_rng(9)
    seen = rng.integers(0, 50, 301).tolist()
    rows = [{"name": "m", "band": "b", "bin": k, "m": n} for k, n in Counter(seen).items()]
    assert quality_rules.medians(rows, ["m"]) == {"m": {"b": (301, sorted(seen)[150])}}


def test_bytes_of_a_foreign_script_are_rejected(spark):
    """A language whose texts the vocabulary fits, and one text of bytes in it."""
    docs = [(k, " ".join(np.random.default_rng(k).choice("the cat sat on a mat while rain fell over old town".split(), 60)), "en") for k in range(80)] + [(80, " ".join(["ꦲꦏ꧀ꦱꦫ", "ꦗꦮ", "ꦱꦶꦗꦶ"] * 20 + [str(k) for k in range(9)]), "en")]
    rows = {r.doc_id: r for r in quality_rules.report(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not rows[80].kept and rows[80].byte_share > 0.5


# preferences


def test_preferences_of_empty_long_and_repeated_turns(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id string, chosen string"
    pairs = lambda rows: preferences.pairs(spark.createDataFrame(rows, schema), F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 1)
    assert pairs([]).count() == 0
    turn = (0, "user", "x" * 100_000, "p", "c")
    rows = [(0, *turn), (0, *turn), (0, 1, "assistant", "a", "p", "c"), (1, *turn), (1, *turn), (1, 1, "assistant", "b", "p", "c")]
    got = pairs(rows).collect()
    assert len(got) == 1 and got[0].n_prompt_turns == 2 and len(got[0].prompt) > 200_000
    a, b = map(int, got[0].rejected_mask.split(":"))
    assert got[0].rejected[a:b] == "b<|end|>\n"
