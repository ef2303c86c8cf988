"""The pipeline's stages, each on its own against a slow version, and all of them over tables with the hard cases."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from textloom.llm import decontaminate, packing, simhash, toxicity

from .helpers import frame, prose, texts
from .test_simhash_packing import brute_fingerprint
from .test_texts import brute_leaks

BAD = ("zzgrunt", "blorfel", "kwexit", "snarvo")


def toxic(k: int) -> str:
    w = prose(5000 + k, 100).split()
    for i in range(8, 100, 9):
        w[i] = BAD[(k + i) % 4]
    return " ".join(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: the hard cases, labelled texts of both kinds, two benchmark items; ids, texts and columns as awkward as they may be."""
    at = str(tmp_path_factory.mktemp("tables"))
    item = prose(900, 30)
    docs = texts() + [(1000 + k, toxic(k) if k % 4 == 0 else prose(6000 + k, 100)) for k in range(300)]
    docs += [(2000, f"{prose(901, 40)} {item} {prose(902, 40)}"), (None, f"{item} {prose(903, 30)}"), (2001, toxic(900)), (2002, prose(904, 150))]
    frame(spark, docs).write.parquet(f"{at}/documents.parquet")
    labels = [(1000 + k, 1, int(k % 4 == 0)) for k in range(300)] + [(None, 1, 1), (1, None, None), (99999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "too short")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxicity_rejects_what_its_model_scores(spark, folder):
    docs = read(spark, folder)
    model = toxicity.learn(spark, docs, folder)
    out = toxicity.stage(spark, docs, folder)
    assert out.columns == docs.columns
    rows = docs.collect()
    assert bag(out) == Counter((r["doc_id"], r["text"]) for r in rows if model.score(r["text"]) < toxicity.THRESHOLD)
    kept = {r["doc_id"] for r in out.collect()}
    assert 2001 not in kept and 2002 in kept
    caught = [r["doc_id"] for r in rows if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1300 and r["doc_id"] not in kept]
    assert sum(i % 4 == 0 for i in caught) >= 60 and sum(i % 4 != 0 for i in caught) <= 15


def test_decontamination_drops_what_brute_force_finds(spark, folder):
    docs = read(spark, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {i for i, _ in enumerate(rows) if brute_leaks([(i, rows[i][1])], [(1, prose(900, 30))])}
    assert len(found) == 2
    assert bag(decontaminate.stage(spark, docs, folder)) == Counter(r for i, r in enumerate(rows) if i not in found)


def test_packing_places_every_id_once(spark, folder):
    tok = pytest.importorskip("tokenizers")
    model = tok.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    docs = read(spark, folder)
    rows = packing.stage(spark, docs, folder).collect()
    want = Counter((r["doc_id"], len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = Counter((r["doc_id"], r["start"] + r["length"]) for r in rows)
    assert all(want[x] <= got[x] for x in want) and sum(r["piece"] == 0 for r in rows) == sum(want.values())
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= packing.CAPACITY


def test_fingerprints_come_as_hexadecimal_digits(spark, folder):
    got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.query(spark, folder).collect())
    assert got == Counter((r["doc_id"], f"{brute_fingerprint(r['text']):016x}") for r in read(spark, folder).collect())


def test_the_pipeline_is_its_stages_one_after_another(spark, folder):
    docs = read(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = Counter(r["doc_id"] for r in docs.collect())
    assert 2000 not in left and 2001 not in left and left[2002] == 1 and left[7] == 1 and 8 not in left
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == left


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
