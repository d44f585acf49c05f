"""The pipeline's stages on a fixture: each decision takes effect and clean documents stay."""

from __future__ import annotations

import corpus_pipeline as C
import pytest


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, d), "stage")
        out.append(docs)
    return d, out, C.STAGES[-1][1](spark, docs, d)


def test_stages(spark, stages):
    d, kept, packed = stages
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    for df in kept:
        assert df.columns == C.COLUMNS
    counts = [spark.read.parquet(f"{d}/documents.parquet").count(), *[k.count() for k in kept]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert packed.select("doc_id").distinct().count() == counts[-1]
    from test_llm_operators import leaks

    bench = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    bad = {x for x, _ in leaks(list(before.items()), bench)}
    assert {r["doc_id"] for r in kept[3].collect()} == set(before) - bad
    from test_dedup import components

    rows = [(r["doc_id"], r["text"]) for r in kept[0].collect()]
    assert {r["doc_id"] for r in kept[1].collect()} == {x for x, _, _, keep in components(rows, C.SIMILAR_PERCENT) if keep}


def test_stages_on_empty_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words of a text that has no id at all", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        for df in (docs, docs.limit(0)):
            if name == "quality":
                df = df.unionByName(spark.read.parquet(f"{d}/documents.parquet").select(C.COLUMNS)) if df is docs else df
            stage(spark, df, d).count()
