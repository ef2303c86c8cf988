from __future__ import annotations

import re


def test_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)


def test_stages_chain(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
    assert [re.sub("_.*", "", n) for n, _ in c.STAGES] == ["toxicity", "simhash", "suffix", "benchmark", "best"]
    rows = c.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0
