"""The pipeline's stages, one after the other, each against brute force on its own input."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import awkward_rows
from quarrystone.llm import queries, quality
from test_pairs import brute_classes, brute_contained


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Documents and what each stage made of them, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(None if i is None else 10_000 + i, t, "en", "src0", None if t is None else len(t)) for i, t in awkward_rows()], docs.schema)
    out = [docs.unionByName(more)]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_drops_what_the_labels_call_bad(spark, sf_dir, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = sum((i in kept) == (q == 1) for i, q in labels.items())
    assert right >= 0.95 * len(labels)
    model = quality.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(map(str, kept)) == sorted({str(r["doc_id"]) for r in quality.score(stages[0], model).filter("predicted = 1").collect()})


def test_line_dedup_equals_its_sql(stages):
    before = stages[1].filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).toPandas()
    con = duckdb.connect()
    con.register("documents", before)
    want = {r[0]: (r[2], r[3]) for r in con.sql(queries.OP3_SQL).fetchall()}
    assert stages[2].count() == stages[1].count()
    rows = {r["doc_id"]: r for r in stages[2].collect() if r["doc_id"] is not None}
    had = dict(pairs(stages[1]))
    for i, r in rows.items():
        assert (want[i][0] == 0) == (r["text"] == had[i])
        assert want[i][1] == (None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest())
        assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_one_of_each_class_stays(stages):
    before, after = pairs(stages[2]), pairs(stages[3])
    classes = brute_classes(before, 5, 80)
    assert {i for i, _ in after if i is not None} == set(classes.values())
    assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)


def test_documents_with_benchmark_items_go(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contained(pairs(stages[3]), items)}
    assert bad
    assert sorted(map(str, pairs(stages[4]))) == sorted(str(x) for x in pairs(stages[3]) if x[0] not in bad)


def test_packing_covers_all_that_is_left(stages):
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in pairs(stages[4])}
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in packed)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_queries_are_registered(spark):
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.oracle_sql()) == {"op3_line_dedup", "op4_decontamination", "op5_near_dedup", "op6_chat_format", "op8_substring_dedup", "op11_collocations", "op12_lexical_search", "op13_license_scan"}


@pytest.mark.parametrize("stage", ["quality", "line_dedup", "near_dedup", "decontamination"])
def test_stages_of_no_documents_and_of_further_columns(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).withColumns({name: F.lit(7) for name in ("n_lines", "whole", "kept", "key", "sig", "id", "held", "label", "text_key")})
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, docs.limit(0), sf_dir).count() == 0
    out = run(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r["n_lines"] for r in out.collect()} <= {7}
