import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ebbtide.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.read_vocabulary(PATH)


def texts():
    rng = random.Random(3)
    letters = "abcdefgh thein ▁é東🙂\n\t\r\x00<s>0aaa   ﻿"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(800)]
    out += ["", " ", "  ", "▁", "▁ ", " ▁x", "<s>", "</s>", "<unk>", "<0x41>", "a " * 50, " a", "a  b", "\U0010ffff", "naïve — “quotes”"]
    return out


LONG = ["a" * 5000, "ab" * 3000, " " * 999, "東京" * 700, "x" * 64, "x" * 65, "🙂" * 300, "=" * 4097, "-" * 70 + " " + "-" * 70]


def test_ids_are_the_librarys(vocabulary, library):
    encoder = piece_bpe.Encoder(vocabulary)
    both = texts() + LONG
    want = library.encode(both)
    assert [piece_bpe._ids(p) for p in encoder.encode(both)] == want
    # again, from what is kept; and text by text
    assert [piece_bpe._ids(p) for t in both for p in encoder.encode([t])] == want
    assert all(len(c) <= piece_bpe.LONG_CHUNK for c in encoder)


def test_the_heap_and_the_common_steps_agree(vocabulary):
    encoder = piece_bpe.Encoder(vocabulary)
    chunks = sorted({c for t in texts() + LONG[:6] for c in encoder.chunks(t)})
    assert encoder.together(chunks) == [encoder.alone(c) for c in chunks]


def test_every_text_of_a_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.piece_round_trip(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["agrees"]
        assert own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()


def test_odd_rows_and_the_round_trip(documents, nothing, library):
    clash = documents.withColumn("pieces", F.lit(1)).withColumn("decoded", F.lit(2))
    encoded = piece_bpe.encode(clash, PATH)
    assert [c for c in encoded.columns if c != "pieces"] == [c for c in clash.columns if c != "pieces"]
    for r in piece_bpe.decode(encoded, PATH).collect():
        assert r["pieces"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    assert piece_bpe.digests(documents, PATH).where("agrees").count() == documents.count()
    assert piece_bpe.digests(documents, PATH, checked=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert piece_bpe.digests(nothing, PATH).count() == 0


def test_what_is_kept_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_CHUNKS", 50)
    encoder = piece_bpe.Encoder(vocabulary)
    for t in texts():
        assert piece_bpe._ids(encoder.encode([t])[0]) == library.encode(t)
        assert len(encoder) <= 50 + len(encoder.chunks(t))


def trained(tmp_path, **options):
    """A tiny model of another make; only tests train one."""
    text = tmp_path / "text.txt"
    rng = random.Random(4)
    text.write_text("\n".join(" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(12)) for _ in range(300)))
    options = {"vocab_size": 330, "model_type": "bpe", "byte_fallback": True, **options}
    sentencepiece.SentencePieceTrainer.train(input=str(text), model_prefix=str(tmp_path / "m"), minloglevel=2, **options)
    return str(tmp_path / "m.model")


@pytest.mark.parametrize("options", [{}, {"normalization_rule_name": "identity", "split_by_whitespace": False}, {"remove_extra_whitespaces": False, "add_dummy_prefix": False}])
def test_other_models(tmp_path, options):
    path = trained(tmp_path, **options)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = piece_bpe.Encoder(piece_bpe.read_vocabulary(path))
    both = [t for t in texts() + LONG if "\x00" not in t]
    assert [piece_bpe._ids(p) for p in encoder.encode(both)] == library.encode(both)


@pytest.mark.parametrize("options", [{"byte_fallback": False, "vocab_size": 60}, {"user_defined_symbols": ["abc"]}, {"model_type": "unigram", "vocab_size": 300}])
def test_models_that_are_refused(tmp_path, options):
    with pytest.raises(ValueError):
        piece_bpe.read_vocabulary(trained(tmp_path, **options))
