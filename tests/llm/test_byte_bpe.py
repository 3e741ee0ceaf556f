import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ebbtide.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n\n", "a" * 500, "the the", "  leading", "tab\tand\r\nline", "東京タワー", "été", "🙂🙂", "don't we'll I'M", "x" * 3 + "­" + "é" * 70, "1234567890 12,5", "<|endoftext|>", "\x00\x01\x7f"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.Vocabulary.of(byte_bpe.read_ranks(PATH)), public_tokenizers.PATTERN)


def test_odd_texts_as_the_library_does(encoder, library):
    for text in ODD:
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text
        assert encoder.decode(packed) == text.encode()


def test_random_pieces_as_merging_by_rank(encoder, library):
    rng = np.random.default_rng(0)
    letters = "abeinorst éßñ東\n0"
    for _ in range(400):
        text = "".join(rng.choice(list(letters), rng.integers(1, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_backtracking_from_a_longest_match_that_leads_nowhere():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5}
    small = byte_bpe.Encoder(byte_bpe.Vocabulary.of(ranks), r"[\s\S]+")
    for piece in (b"abc", b"aabc", b"abcbc", b"ababcab", b"bcbcab"):
        assert small.backtrack(piece) == byte_bpe.merge(ranks, piece)[0]


def test_compatibility_is_what_merging_the_pair_gives(encoder):
    """For pairs that texts bring up and for pairs of any two tokens."""
    ranks, tokens = encoder.v.ranks, encoder.token
    rng = np.random.default_rng(6)
    for _ in range(300):
        encoder.encode("".join(rng.choice(list("aeinrst ésch東\n0-=_"), rng.integers(1, 60))))
    given = [r for r, left in encoder.v.left.items() if left != -2]
    pairs = list(encoder.pairs)[:4000] + [tuple(p) for p in rng.choice(given, (4000, 2)).tolist()]
    # runs of one character, where equal ranks meet
    runs = [r for r in given if len(set(tokens[r])) == 1]
    pairs += [(a, b) for a in runs for b in runs if tokens[a][:1] == tokens[b][:1] and len(tokens[a] + tokens[b]) < 80]
    for a, b in pairs:
        assert encoder.compatible(a, b) == (byte_bpe.merge(ranks, tokens[a] + tokens[b])[0] == [a, b]), (tokens[a], tokens[b])


@pytest.mark.parametrize("seed", range(3))
def test_other_vocabularies(seed):
    """Small vocabularies grown by merges, with many equal parts and tokens that can't be reached."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        tokens = [bytes([b]) for b in b"abc"]
        for _ in range(int(rng.integers(2, 14))):
            made = tokens[rng.integers(len(tokens))] + tokens[rng.integers(len(tokens))]
            if made not in tokens:
                tokens.append(made)
        ranks = {t: i for i, t in enumerate(tokens)}
        small = byte_bpe.Encoder(byte_bpe.Vocabulary.of(ranks), r"[\s\S]+")
        for _ in range(40):
            piece = bytes(rng.choice(list(b"abc"), rng.integers(1, 14)).tolist())
            assert small.backtrack(piece) == byte_bpe.merge(ranks, piece)[0], (ranks, piece)


def test_digests_and_round_trip(documents, nothing):
    got = {(r["doc_id"], r["decoded_sha256"]): r["n_tokens"] for r in byte_bpe.digests(documents, PATH, public_tokenizers.PATTERN).collect()}
    texts = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in documents.collect()}
    assert set(got) == texts
    assert got[4, hashlib.sha256(b"").hexdigest()] == 0
    assert byte_bpe.digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_encode_keeps_columns_and_decode_restores(documents):
    encoded = byte_bpe.encode(documents.withColumnRenamed("source", "tokens"), PATH, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "lang", "n_chars", "tokens"]
    back = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert len(back) == documents.count()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
