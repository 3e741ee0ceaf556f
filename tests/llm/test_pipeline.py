import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm import byte_bpe, quality_knn, queries
from ebbtide.llm.sampling import held_out
from tests.llm import test_decontaminate, test_fuzzy_lines
from tests.llm.test_order_minhash import brute_classes

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Row(dict):
    pass


def brute(spark, sf_dir):
    """The pipeline over rows in plain Python; only the fitted quality model is the library's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_knn.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [Row(r.asDict()) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, s in zip(rows, model.score(pa.array([r["text"] for r in rows]))) if s >= 0.5]
    rows = [Row(doc_id=i, text=t) for i, t in test_fuzzy_lines.brute(rows)]
    first = {c for _, c in brute_classes(rows)}
    rows = [r for r in rows if r["doc_id"] in first]
    items = [(b["item_id"], b["text"]) for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {w[0] for w in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in rows], items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    out = []
    for r in rows:
        if r["doc_id"] not in bad:
            ids = library.encode_ordinary(r["text"] or "")
            out.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out)


def test_pipeline_against_brute_force(spark):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute(spark, SMALL)
    assert 0 < len(got) < spark.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_rows_and_keep_columns(spark, documents, nothing, name, step):
    wide = documents.withColumn("score", F.lit("clash")).withColumn("n_lines", F.lit(1)).withColumn("class_id", F.lit(None).cast("string"))
    kept = step(spark, wide, SMALL)
    assert kept.schema.names == wide.schema.names and [f.dataType for f in kept.schema] == [f.dataType for f in wide.schema]
    assert 0 < kept.count() <= wide.count()
    assert step(spark, nothing, SMALL).count() == 0


def test_every_stage_and_operator_is_registered():
    import __spark_entry__ as entry

    registered = entry.queries()
    assert "pipeline" in registered and set(queries.QUERIES) <= set(registered)
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
