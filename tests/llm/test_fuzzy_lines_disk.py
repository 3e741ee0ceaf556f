"""What line deduplication keeps on disk, and what it rejects before pairs leave a task."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from ebbtide import session
from ebbtide.llm import fuzzy_lines as fl
from tests.llm.test_fuzzy_lines import brute, made  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def folders(spark):
    place = session.staging_dir(spark).removeprefix("file:") + "/ebbtide"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_only_the_lines_to_drop_stay_on_disk(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = folders(spark)
    kept = fl.deduplicate(docs)
    left = folders(spark) - before
    assert [f.rsplit("-", 1)[0] for f in left] == ["surplus-lines"]
    assert kept.count() == docs.count()


def test_settled_tables_outlive_those_staged_for_them(spark):
    before = folders(spark)
    outer = session.stage(spark.range(5), "outer")

    def build():
        inner = session.stage(spark.range(10), "inner")
        return session.settle(lambda: session.stage(inner.where("id > 3"), "innermost"), "middle").where("id > 5")

    got = session.settle(build, "settled")
    assert sorted(r["id"] for r in got.collect()) == [6, 7, 8, 9] and outer.count() == 5
    assert sorted(f.rsplit("-", 1)[0] for f in folders(spark) - before) == ["outer", "settled"]
    session.discard(outer)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["settled"]


def test_tables_stay_where_a_build_fails(spark):
    before = folders(spark)

    def build():
        session.stage(spark.range(3), "lost")
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        session.settle(build, "never")
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["lost"] and session._made.get() is None


def test_blocks_in_lots_find_what_all_at_once_find(spark, made, monkeypatch):  # noqa: F811
    one = sorted(map(str, fl.deduplicate(made).collect()))
    monkeypatch.setattr(fl, "LOT", 20)
    labels = []
    stage = fl.stage
    monkeypatch.setattr(fl, "stage", lambda df, label: labels.append(label) or stage(df, label))
    assert sorted(map(str, fl.deduplicate(made).collect())) == one
    assert 2 <= labels.count("line-meetings") <= fl.LOTS
    assert sorted(((r["doc_id"], r["text"]) for r in fl.deduplicate(made).collect()), key=str) == brute(made.collect())


def near_pairs(rng, size, most):
    """Pairs of word lists with at most ``most`` random edits between them."""
    for _ in range(150):
        words = ["w%d" % rng.randrange(60) for _ in range(size)]
        other = list(words)
        for _ in range(most):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = ["w%d" % rng.randrange(60)] * rng.randrange(2)
        yield words, other


@pytest.mark.parametrize("size", [11, 17, 40, 95])
def test_places_reject_no_near_line(size):
    from ebbtide.llm.order_minhash import edits_within

    rng = random.Random(size)
    settings = fl.Settings(runs=0, radius=63)
    common = np.array([rng.randrange(256) for _ in range(fl.SLOTS)], np.uint8)
    tried = 0
    for pair in near_pairs(rng, size, size // 5):
        lines = fl.Lines(pa.array([" ".join(p) for p in pair]))
        a, b = (np.frombuffer(lines.packed(i), np.uint32) for i in (0, 1))
        if edits_within(a, b, int(max(len(a), len(b)) * 0.2 + 1e-9)) is None or lines.hash[0] == lines.hash[1]:
            continue
        tried += 1
        key, own, at = fl.placed_blocks(lines, np.arange(2), settings, common)
        first, second = ({k: p for k, p in zip(key[own == i].tolist(), at[own == i].tolist())} for i in (0, 1))
        shared = sorted(set(first) & set(second))
        info = np.concatenate([lines.info()[i] | (np.array([own_at[k] for k in shared]) << 48) for i, own_at in ((0, first), (1, second))])
        sim = np.repeat(lines.simhash(), len(shared))
        x = np.arange(len(shared))
        assert fl._may_be_near(sim, info, x, x + len(x), settings).any()
    assert tried > 100


def test_places_reject_what_shares_a_run_elsewhere():
    words = ["w%d" % i for i in range(100)]
    moved = ["v%d" % i for i in range(60)] + words[:40]
    lines = fl.Lines(pa.array([" ".join(words), " ".join(moved)]))
    info = lines.info() & ~np.int64(0xFFFFFFFF)
    sim = np.zeros(2, np.int64)
    x, y = np.array([0]), np.array([1])
    assert fl._may_be_near(sim, info | (np.array([30, 35]) << 48), x, y, fl.WHOLE).all()
    assert not fl._may_be_near(sim, info | (np.array([10, 70]) << 48), x, y, fl.WHOLE).any()
    assert fl._may_be_near(sim, info | (np.array([10, fl.FREE]) << 48), x, y, fl.WHOLE).all()


def test_words_of_all_texts_are_counted(spark):
    texts = ["once%d only%d" % (i, i) for i in range(200)] + ["often often often", None, ""]
    words = fl.Words(pa.array(texts))
    count = np.bincount(fl._slot(words.hash), minlength=fl.SLOTS)
    got = fl.levels(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    assert (got == np.minimum(np.log2(count + 1) * 4, 255).astype(np.uint8)).all()
