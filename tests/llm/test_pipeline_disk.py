"""What the pipeline keeps on disk, and that it leaves no row out."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ebbtide.llm import fuzzy_lines, order_minhash
from tests.llm.test_fuzzy_lines_disk import folders

SMALL = "/root/testdata/sf0.001"


def test_only_the_last_step_but_one_stays(spark):
    before = folders(spark)
    tokens = corpus_pipeline.run(spark, SMALL)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["benchmark_decontamination"]
    assert 0 < tokens.count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_only_classes_stay(spark):
    before = folders(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = order_minhash.membership_of(docs)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["classes"]
    assert found.count() == docs.count()


def test_line_dedup_counts_the_words_of_all_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ran = []
    words = fuzzy_lines.levels
    monkeypatch.setattr(fuzzy_lines, "levels", lambda rows: ran.append((rows.count(), words(rows))) or ran[-1][1])
    dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SMALL)
    texts = pa.array([r["text"] for r in docs.select("text").collect()])
    count = np.bincount(fuzzy_lines._slot(fuzzy_lines.Words(texts).hash), minlength=fuzzy_lines.SLOTS)
    assert [n for n, _ in ran] == [docs.count()]
    assert (ran[0][1] == np.minimum(np.log2(count + 1) * 4, 255).astype(np.uint8)).all()
