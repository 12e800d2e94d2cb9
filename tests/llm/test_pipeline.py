"""The pipeline's stages, each against brute force on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import decontamination, quality
from lakewright.llm.common import table, written
from lakewright.llm.training import remainder

from .test_duplicates import classes, expected, jaccard_components, left_of, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = written(stage(spark, docs, SF))
    seen.append(docs)
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert all(d.columns == seen[0].columns for d in seen[:5])

    model = quality.fit(seen[0], table(spark, SF, "labels"), remainder("doc_id", 5) != 0)
    assert set(rows[1]) == {r.doc_id for r in quality.score(seen[0], model).where("score >= 0.3").collect()}

    fp = {i: slow_fingerprint(r.text, 5) for i, r in rows[1].items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert set(rows[2]) == set(classes(near, fp).values())

    texts = sorted((i, r.text) for i, r in rows[2].items())
    found = expected(texts, *jaccard_components(texts, 20, 0.8))
    for i, t in texts:
        _, lines, spans = found[i]
        left = left_of(t, lines, spans)
        assert (i in rows[3] and rows[3][i].text == left) or ((lines or spans) and not left.strip() and i not in rows[3])

    items = {str(r.item_id): r.text for r in table(spark, SF, "benchmark").collect()}
    assert set(rows[4]) == {i for i, r in rows[3].items() if not decontamination.brute(r.text, items)[1]}
    assert set(rows[5]) == set(rows[4])

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=corpus_pipeline.model_path())
    assert all(rows[5][i].ids == sp.encode(rows[4][i].text, add_eos=True) for i in list(rows[4])[:60])
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256")
    assert whole.exceptAll(docs.select("doc_id", "ids_sha256")).count() == 0 and whole.count() == docs.count()
    empty = seen[0].where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_odd_rows(spark):
    """Null ids, texts and other columns, repeated ids and rows go through every stage."""
    docs = table(spark, SF, "documents")
    good = docs.orderBy("doc_id").limit(30)
    null = spark.createDataFrame([(None, None, None, None, None), (5, None, None, None, None), (None, "", None, None, 0)], docs.schema)
    odd = good.unionByName(good.limit(3)).unionByName(good.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(null)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = written(stage(spark, odd, SF))
        if k == 4:
            assert made.count() == odd.count()
            break
        assert made.columns == docs.columns and made.count() <= odd.count()
        if k == 1:  # a document with an id stays, its copy without one goes
            assert made.where("text <> '' and doc_id is null").count() == 0
        odd = made.unionByName(null) if k else odd
