"""The pipeline on a small corpus with planted cases, each stage against its definition."""

import numpy as np

import corpus_pipeline

ITEM = "yesterday some people bought apples and sold rice to their neighbours for little money in the old market square"
KEY = "token = '0123456789abcdef0123456789abcdef'"


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 5))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = {i: prose(120) for i in range(100)} | {i: prose(60).replace(" ", " ### ") for i in range(100, 140)}
    texts |= {140: texts[3], 141: texts[3], 142: f"{prose(50)} {ITEM} {prose(50)}", 143: f"{prose(60)} {KEY} {prose(60)}"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    good = {*range(100), 140, 141, 142, 143}
    assert set(seen["quality classifier"]) == good
    assert set(seen["SimHash near-dedup"]) == good - {140, 141}
    assert set(seen["benchmark decontamination"]) == good - {140, 141, 142}
    last = seen["secret scans"]
    assert set(last) == good - {140, 141, 142} and last[143] == texts[143].replace("0123456789abcdef0123456789abcdef", "").replace("token = '", "[SECRET]")
    assert all(last[i] == texts[i] for i in last if i != 143)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in packed} == {i: len(t.split()) for i, t in last.items()}


def test_stages_take_every_case(spark, tmp_path):
    """Null, blank, very long and repeated rows, rows without an id, and an empty table, through every stage."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (4, "one two three"), (None, "no id at all"), (None, "no id at all"), (5, "word " * 40000), (6, "password = abcdefghijklmnop")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "three blind mice ran away"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema), spark.createDataFrame([], schema)):
        full = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert out.columns == corpus_pipeline.COLUMNS
                assert out.count() <= full
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sum(r.length for r in packed) == sum(len((r.text or "").split()) for r in docs.collect())
        masked = {r.text for r in corpus_pipeline.mask_secrets(spark, docs, str(tmp_path)).where("doc_id = 6").collect()}
        assert masked == ({"[SECRET]"} if full else set())
        ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
        assert sorted(ids, key=str) == ([1, 4, 5, 6, None] if full else [])
