"""The pipeline's stages, each against what a plain version makes of its input; and the entry without the folder."""

from __future__ import annotations

import random
import subprocess
import sys

import corpus_pipeline

from .helpers import DOCS, Groups, corpus, edited, jaccard_links, prose, shingle_set
from .test_joins import expected_removed

ITEMS = "item_id bigint, text string"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 25)) for i in range(10)]
    rows = corpus(2, 50)
    rows += [(800 + i, f"{prose(rng, 60)}\n{edited(rng, items[i][1], 1)}\n{prose(rng, 60)}", "en", "s", 1, "", 1, 1) for i in range(6)]
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ins, outs = ([tuple(r) for r in x.collect()] for x in (before, after))
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        if name == "line_dedup":
            gone = expected_removed(ins)
            want = set()
            for r in ins:
                left = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone.get(2**62 if r[0] is None else r[0], ()))
                if left is None or left == r[1] or left.strip():
                    want.add((r[0], left))
            assert len(want ^ {(r[0], r[1]) for r in outs}) <= 2
        if name == "ngram_jaccard_join":
            sets = [shingle_set(r[1]) for r in ins]
            groups = Groups()
            for i, j in jaccard_links(sets):
                groups.link(i, j)
            assert len(outs) == len({groups.find(i) for i in range(len(ins)) if sets[i]}) + sum(not s for s in sets)
        if name == "benchmark_decontamination":
            held = [any(s and len(s & shingle_set(r[1])) >= 0.8 * len(s) for s in (shingle_set(t) for _, t in items)) for r in ins]
            assert sorted(str(r) for r, h in zip(ins, held) if not h) == sorted(map(str, outs)) and any(held)
        if name == "best_fit_packing":
            assert sum(r[3] for r in outs) == sum(len((r[1] or "").split()) + 1 for r in ins)
        before = after


def test_run_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    names = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).stdout.split()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_entry_without_the_folder(tmp_path):
    """Without the training-data parts the entry imports and keeps all other queries."""
    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    code = f"""
import shutil, sys
shutil.copytree({root!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__'))
sys.path.insert(0, {str(tmp_path / 'r')!r})
import __spark_entry__ as e
assert e.__file__.startswith({str(tmp_path)!r}) and len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
