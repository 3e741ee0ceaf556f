import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ebbtide.llm import language_kernel, quality_knn, queries
from ebbtide.llm.batches import bucket, ngram_codes, utf8

MIDDLE = "/root/testdata/sf0.01"


def test_ngrams_stay_inside_their_rows():
    data, offsets = utf8(pa.array(["abc", None, "", "ab", "é"]))
    code, row = ngram_codes(data, offsets, 2)
    assert [(bytes([c >> 8, c & 255]), r) for c, r in zip(code.tolist(), row.tolist())] == [(b"ab", 0), (b"bc", 0), (b"ab", 3), ("é".encode(), 4)]
    assert bucket(code, 2, 8).max() < 256


def test_sliced_columns_are_read_from_their_own_start():
    column = pa.array(["xx", "abc", None, "d"]).slice(1)
    data, offsets = utf8(column)
    assert data.tobytes() == b"abcd" and offsets.tolist() == [0, 3, 3, 4]


def test_quality_on_held_out_rows(spark):
    rows = queries.quality_classifier(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(rows.doc_id, rows.held_out))


def test_quality_votes_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    got = model.score(pa.array(texts))
    own = model.project(quality_knn.counts(pa.array(texts), model.settings.bits))
    for v, g in zip(own, got):
        cosine = [float(np.dot(v, w)) for w in model.vectors]
        best = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: model.settings.neighbours]
        pull = [max(cosine[i], 0) ** model.settings.power * (model.settings.good_weight if model.labels[i] > 0.5 else 1) for i in best]
        assert abs(sum(p * model.labels[i] for p, i in zip(pull, best)) / sum(pull) - g) < 1e-3


def test_quality_of_odd_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (9, None), (7, 1)], "doc_id long, quality int")
    for model in (quality_knn.fit(documents, labels), quality_knn.fit(nothing, labels), quality_knn.fit(documents, labels.limit(0))):
        rows = quality_knn.score(documents, model, ["doc_id"]).collect()
        assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert quality_knn.score(nothing, model, ["doc_id"]).count() == 0
    kept = quality_knn.accepted(documents, model)
    assert kept.columns == documents.columns and kept.count() == documents.count()


def test_repeated_words_count_from_the_second_repeat_on():
    plain, repeated, once = quality_knn.counts(pa.array(["a b c d " * 20, "a a a a " * 20, "of the the river"]), 8)
    assert plain[-1] == once[-1] == 0 and repeated[-1] > 0


def test_language_on_held_out_rows(spark):
    rows = queries.language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_of_odd_rows(spark, documents, nothing):
    made = documents.unionByName(spark.createDataFrame([(20, "123 ... 4", "en", "x", 9), (21, "abc", None, "x", 3)], documents.schema))
    model = language_kernel.fit(made)
    rows = {r["doc_id"]: r for r in language_kernel.predict(made, model, ["doc_id"]).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[20]["lang_pred"] == language_kernel.UNKNOWN
    assert rows[3]["score"] == 0 and rows[5]["lang_pred"] == "de" and set(model.languages) == {"de", "en", "fr"}
    empty = language_kernel.fit(nothing)
    assert {r["lang_pred"] for r in language_kernel.predict(made, empty, ["doc_id"]).collect()} == {language_kernel.UNKNOWN}
    assert language_kernel.predict(nothing, model, ["doc_id"]).count() == 0


def test_presence_kernel_of_equal_texts_is_one():
    x = language_kernel.presence(pa.array(["Some text", "some text", "other"]), language_kernel.Settings())
    assert abs(x[0] @ x[1] - 1) < 1e-6 and x[0] @ x[2] < 0.7


def test_a_common_label_does_not_crowd_out_others(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 100 > 0).cast("int").alias("quality"))
    model = quality_knn.fit(docs, labels, quality_knn.Settings(per_label=50))
    assert 20 <= (model.labels == 0).sum() <= 30 and 25 <= (model.labels == 1).sum() <= 80
