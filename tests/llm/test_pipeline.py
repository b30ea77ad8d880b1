"""The pipeline's stages, one after the other, and the package's borders."""

import ast
from pathlib import Path

import corpus_pipeline
from timedframe.llm import jaccard, pii, rules


def test_stages(shared, sf, documents, tmp_path):
    docs, seen = documents, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(shared, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs, before = shared.read.parquet(str(tmp_path / name)), docs
        seen[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
            assert docs.count() <= before.count()
    ids = {n: {r.doc_id for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    judged = rules.judge(documents).collect()
    assert ids["quality_rules"] == {r.doc_id for r in judged if r.kept}
    groups = jaccard.classes(seen["quality_classifier"]).collect()
    assert ids["near_duplicates"] == {r.component_id for r in groups}
    assert ids["personal_data"] == ids["packing"] == ids["near_duplicates"]
    for r in seen["personal_data"].collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    labels = {r.doc_id: r.quality for r in shared.read.parquet(f"{sf}/labels.parquet").collect()}
    after = [labels[k] for k in ids["quality_classifier"] if k in labels]
    assert sum(after) >= 0.95 * len(after)


def test_awkward_rows(shared, awkward, nothing, sf):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(shared, docs, sf)
            assert rows.count() <= 11 * 40, name


def test_nothing_else_imports_this_package():
    root = Path(__file__).resolve().parents[2]
    for file in root.rglob("*.py"):
        inside = file.is_relative_to(root / "timedframe" / "llm") or file.is_relative_to(root / "tests" / "llm")
        if inside or file.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), file
