"""The pipeline's stages in order, each on its own input."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(200)]
    text = lambda n=40: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(), "en", "s", 0) for i in range(80)]
    bench = text(30)
    rows += [(200, "123 456", None, "s", 0), (201, rows[3][1], "en", "s", 0), (202, text(10) + " " + bench + " " + text(5), "en", "s", 0), (203, None, "en", "s", 0)]
    labels = []
    for i in range(300, 340):
        rows.append((i, text(20) + " vilewort " + text(10) + " vilewort", "en", "s", 0))
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(80)]
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x["doc_id"] for x in out.collect()) == list(range(80))
    assert out.columns[:5] == docs.replace(",", "").split()[::2] and [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "decontamination", "bpe"]
