"""The pipeline's stages on hard cases, each against its brute-force rule."""

import corpus_pipeline
from arterial.llm import packing

from .conftest import rows_of
from .test_dedup_contamination import benchmark_rows, brute
from .test_jaccard import brute as components
from .test_tokens_files import check_packing


def test_stages(spark, hard, tmp_path):
    docs = hard.filter("text is null or length(text) < 20000").dropDuplicates(["doc_id", "text"])
    bench = spark.createDataFrame(benchmark_rows(rows_of(docs)), "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(0, 101)], "doc_id long, quality int, toxic int")
    for name, frame in (("benchmark", bench), ("labels", labels), ("documents", docs)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    good = stages["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and not good.exceptAll(docs).count()

    kept = stages["exact_dedup"](spark, docs, str(tmp_path))
    kept_rows = rows_of(kept)
    assert len(kept_rows) == len({t or "" for _, t in rows_of(docs)}) == len({t or "" for _, t in kept_rows})

    near = rows_of(stages["near_dedup"](spark, docs, str(tmp_path)))
    want = components(rows_of(docs), corpus_pipeline.NEAR)
    assert {i for i, _ in near} == {c for _, _, c in want}

    clean = stages["decontamination"](spark, docs, str(tmp_path))
    bad = {k[0] for k in brute(rows_of(docs), bench.collect()) if k[5]}
    assert bad and {i for i, _ in rows_of(clean)} == {i for i, _ in rows_of(docs)} - bad

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    check_packing(packed, rows_of(docs), packing.CAPACITY)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
