"""The pipeline on a fixture, stage by stage against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import LINE, brute_classes, brute_lines, docs, labels, near, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, f"{words(i, 80)}\n{LINE}" if i % 4 == 0 else words(i, 80), "s", "en" if i % 3 else "de") for i in range(90)]
    rows += [(100 + i, "idiot moron scum " + words(200 + i, 50), "s", "en") for i in range(30)]
    rows += [(200 + i, near(300 + i // 2, i % 2), "s", "en") for i in range(10)] + [(300 + i, words(999, 40), "s", "de") for i in range(20)]
    rows += [(400, None, "s", None), (401, "", "s", "en"), (None, words(5000, 30), "s", "en"), (402, words(402), "s", "en"), (402, words(402), "s", "en")]
    docs(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels(spark, [(i, 1, int(100 <= i < 130)) for i in range(130)]).write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_stages(spark, folder, tmp_path):
    at, rows = folder
    now, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, at)
        out.write.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
    pair = lambda got: sorted(((r.doc_id, r.text) for r in got), key=repr)
    clean = [r[:2] for r in rows if not 100 <= (r[0] or 0) < 130]
    assert pair(seen["toxicity"]) == sorted(clean, key=repr)
    cut = brute_lines(clean)
    assert [(i, t or "") for i, t in pair(seen["line_dedup"])] == [(i, t) for i, _, _, t in cut]
    lines = [(i, t) for i, _, _, t in cut]
    want = {c for _, c in brute_classes(lines)}
    kept = [r.doc_id for r in seen["near_dedup"]]
    assert len(kept) == len(set(kept)) and set(kept) == want
    counts = collections.Counter(r.doc_id for r in seen["mixing"])
    assert set(counts) == want and len(seen["mixing"]) > len(kept)
    assert len(seen["bpe"]) == len(seen["mixing"]) and sum(r.n_tokens == 0 for r in seen["bpe"]) == sum(not r.text for r in seen["mixing"])
    assert np.all([r.n_tokens == len(r.ids) for r in seen["bpe"]])


def test_run(spark, folder):
    at, _ = folder
    assert corpus_pipeline.run(spark, at).count() > 100


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
