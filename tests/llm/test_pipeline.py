"""The corpus pipeline, the registered queries of the operators, and that the rest doesn't need them."""

import ast
from pathlib import Path

import corpus_pipeline
from tessera.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_the_columns_and_call_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixture", "shard"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        if name != "mixture":
            assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() <= before.count()
        before = corpus_pipeline.materialize(after, name)
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).count() == before.count()


def test_run_is_the_stages_in_order(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and {"doc_id", "shard", "slot"} <= set(got.columns)


def test_one_query_for_each_operator(spark, sf):
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_mixing", "op3_sharding", "op4_line_dedup", "op5_license_scan", "op7_secret_scan", "op10_quality_rules"):
        assert queries.QUERIES[name](spark, sf).count() == docs, name


def test_nothing_else_imports_the_operators():
    for path in [*ROOT.glob("tessera/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tessera.llm", "corpus_pipeline")) for n in names), path
