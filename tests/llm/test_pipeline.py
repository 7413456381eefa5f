"""The pipeline, stage by stage, against plain versions, each on the input that the stage had."""

import corpus_pipeline
from tests.conftest import SF as SMALL
from tests.llm.test_brute import grams, plain_lines, words
from tidegauge.llm import decontaminate, entries

SF = SMALL.replace("0.001", "0.01")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{len(held)}"
        out.write.parquet(path)
        was, docs = docs, spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.columns == columns
        held[name] = ({r.doc_id: r for r in was.collect()}, docs.collect())
    before, after = held["quality classifier"]
    assert all(before[r.doc_id] == r for r in after) and 0.6 * len(before) < len(after) < len(before)
    before, after = held["line dedup"]
    want = {d: t for d, _, _, t in plain_lines([(d, r.text) for d, r in before.items()], 10)}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = held["MinHash near-dedup"]
    sets = {d: grams(words(r.text), 5) for d, r in before.items()}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and low[a] != low[b] and x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    assert {r.doc_id for r in after} == {d for d in low if low[d] == d} and len(after) < len(before)
    before, after = held["benchmark decontamination"]
    hit = {r.doc_id for r in decontaminate.contained(spark.createDataFrame(list(before.values())), entries.table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in after} == set(before) - hit
    before, after = held["best-fit packing"]
    assert {r.doc_id for r in after} == set(before)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and empty tables, each stage alone."""
    long = " ".join(f"word{i}" for i in range(400_000))
    rows = [(1, None, None, None, None), (None, "some words in a text without an id", "en", "s", 3), (2, "", "en", None, 0), (3, long, None, "s", 9), (4, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13), (5, "x" * 1_000_000, "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = ("log_weight", "n_lines", "component", "kept", "b", "id", "key", "side", "n", "w", "shard", "item_id", "words", "length")
    for table, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(None, None, None)] if table == "labels" else [(None, None), (7, "")], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.createDataFrame([(*r, *("z",) * len(names)) for r in rows], schema + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in out} == {r[0] for r in rows}
        else:
            assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows), name
            assert all(r[n] == "z" for r in out for n in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
