"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import pandas as pd

import corpus_pipeline as cp
from lattica.llm.toxicity import fit_toxicity
from tests.llm.test_operators import brute_components, naive_score

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        pdf = docs.toPandas()
        assert set(pdf.doc_id) <= set(kept.doc_id) and pdf.doc_id.is_unique
        if name == "toxicity":
            lexicon = fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(pdf.doc_id) == {i for i, t in zip(kept.doc_id, kept.text) if naive_score(lexicon, t) < 0.3}
            clean = set(labels[labels.toxic == 0].doc_id) & set(kept.doc_id)
            assert len(clean - set(pdf.doc_id)) <= 0.02 * len(clean)
        if name == "jaccard_join":
            groups = brute_components(list(zip(kept.doc_id.tolist(), kept.text)), 5, 80)
            assert set(pdf.doc_id) == {c for _, _, c in groups} and len(pdf) < len(kept)
        if name == "decontamination":
            items = pd.read_parquet(f"{SF}/benchmark.parquet").text.dropna()
            assert not [i for i, t in zip(pdf.doc_id, pdf.text) if any(x in t for x in items)]
        kept = pdf
    packed = cp.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(kept.doc_id)


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", None, None, 5)], docs.schema)
    both = docs.unionByName(odd)
    for _, stage in cp.STAGES:
        assert stage(spark, both, SF).count() >= 0
        assert stage(spark, both.where("false"), SF).count() == 0


def test_rows_that_share_an_id_are_judged_each(spark):
    text = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, text), (1, text + " " + item), (None, text), (None, "quite another text of its own here"), (2, ""), (2, None), (1, text)]
    docs = spark.createDataFrame([(i, t, "row_key", 5) for i, t in rows], "doc_id long, text string, row_key string, score int")
    left = sorted(map(str, ((r.doc_id, r.text) for r in cp.drop_benchmark_leaks(spark, docs, SF).collect())))
    assert left == sorted(str(r) for r in rows if item not in (r[1] or ""))
    near = cp.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    got = sorted(map(str, ((r.doc_id, r.text) for r in near.collect())))
    linked = {str((1, text)), str((1, text + " " + item)), str((None, text))}
    assert [g for g in got if g not in linked] == sorted(str(r) for r in (rows[3], rows[4], rows[5]))
    assert len([g for g in got if g in linked]) in (1, 2)
    assert str((1, text)) in got and str((None, text)) not in got
