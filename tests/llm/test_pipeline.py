"""Each stage of the pipeline on its predecessor's rows, against brute force."""

import re

import pandas as pd
from conftest_edges import EDGES, make_docs
from test_operators import brute_kept, contaminated
from test_packing import check

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.toPandas()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.toPandas())
    whole, calm, unlike, apart, clean, pieces = kept

    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(whole, on="doc_id")
    assert labels[labels.toxic == 0].doc_id.isin(calm.doc_id).mean() > 0.95

    groups = calm.assign(key=calm.text.map(bare), size=-calm.text.str.len()).sort_values(["key", "size", "doc_id"])
    assert sorted(unlike.doc_id) == sorted(groups.drop_duplicates("key").doc_id)

    # of every chain of links within 4 bits, or of five-word similarity 0.8 at any distance, the smallest doc_id stays
    want, _ = brute_kept(list(zip(unlike.doc_id, unlike.text, strict=True)))
    assert sorted(apart.doc_id) == want

    items = [tuple(r) for r in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    found = contaminated(list(zip(apart.doc_id, apart.text, strict=True)), items)
    assert sorted(clean.doc_id) == sorted(d for d, _, n, _ in found if not n)

    assert check(list(pieces.itertuples(index=False)), dict(zip(clean.doc_id.tolist(), clean.text, strict=True))) == 0
    assert 0 < len(clean) < len(apart) < len(unlike) < len(calm) < len(whole) + 1


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns) and out.count() > 0


def test_run_on_edge_rows_and_on_nothing(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages; and empty tables."""
    docs = make_docs(spark, EDGES + [(30, "one two three four five six seven eight nine ten eleven")])
    labels = spark.createDataFrame([(1, 0, 1), (8, 1, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, None), (None, "q")], "item_id long, text string")
    for name, keep in (("some", "true"), ("none", "false")):
        folder = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.where(keep).write.parquet(f"{folder}/{table}.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        if name == "none":
            assert rows == []
            continue
        ids = {r.doc_id for r in rows}
        # the longest of the empty texts and of those alike but for white space, the first x, one of the two long ones, the text without an id
        assert ids == {2, 5, 6, 8, 10, 11, None}
