import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import merkle, oracles, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and each first node's steps: the siblings before and after it, level by level."""
    steps = [[] for _ in nodes]
    own = list(range(len(nodes)))  # where each first node's ancestor stands
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            steps[i].append((run[: at % 8], run[at % 8 + 1 :]))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        own = [at // 8 for at in own]
    return nodes[0], steps


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        lower[lang] = tree([leaf(r) for r in groups[lang]])
    root, upper = tree([lower[g][0] for g in langs])
    out = Counter()
    for place, lang in enumerate(langs):
        subroot, steps = lower[lang]
        for row, own in zip(groups[lang], steps):
            path = own + upper[place]
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            node = leaf({**row, "text": row["text"] and "".join(c.lower() if c.isascii() else c for c in row["text"])} if tampered else row)
            for before, after in path:
                node = H(*before, node, *after)
            proof = H(*[x for before, after in path for x in before + after])
            out[row["doc_id"], leaf(row), subroot, root, proof, node, node == root] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def run(docs):
    return merkle.manifest(docs, F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False)), merkle.lowered(docs["text"]))


def rows_of(docs):
    return [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_odd_rows(documents):
    clash = documents.select("*", F.lit("x").alias("path"), F.lit(1).alias("place"), F.lit(2).alias("node"), F.lit("y").alias("order"))
    assert found(run(clash)) == brute(rows_of(documents))


def test_nothing(nothing):
    assert run(nothing).collect() == []
    assert run(nothing).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sizes_around_the_runs(spark, seed):
    rng = random.Random(seed)
    sizes = {"en": 513, "de": 65, "fr": 64, "es": 9, "it": 8, "pt": 1, None: 2, "é": 1, "Z": 7, "": 3}
    if seed == 2:
        sizes = {"only": 73}
    rows = [(rng.randrange(-50, 900) if rng.random() < 0.95 else None, rng.choice(["Same Text", "Ünï Ab", "", None, f"T {n}"]), lang, rng.choice("ab"), rng.choice([None, 5])) for lang, size in sizes.items() for n in range(size)]
    rows += [rows[0]] * 20  # equal rows
    docs = spark.createDataFrame(rows, SCHEMA)
    got = found(run(docs))
    assert got == brute(rows_of(docs))
    assert {r[6] for r in got} == {True, False}


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(4, "Alone", "en", None, None)], SCHEMA)
    (row,) = run(docs).collect()
    own = H("1:4", "-", "2:en", "-", "5:Alone")
    assert (row["leaf"], row["subroot"], row["root"], row["proof_sha256"]) == (own, own, own, H(""))


def test_every_proof_holds_and_no_other_leaf_fits(documents):
    found_, root = merkle.proofs(documents)
    folded = found_.select(merkle.text_of(merkle.fold(F.col("leaf"), F.col("path"))).alias("own"), merkle.text_of(merkle.fold(merkle.digest(F.col("leaf")), F.col("path"))).alias("other")).collect()
    assert len(folded) == documents.count()
    assert all(r["own"] == root != r["other"] for r in folded)


def test_large_ranges_are_split(spark, monkeypatch):
    """One language over many value ranges, numbered as in one."""
    from ebbtide.operators import ordering

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    monkeypatch.setattr(ordering.running_totals, "__defaults__", (*ordering.running_totals.__defaults__[:2], 20, *ordering.running_totals.__defaults__[3:]))
    assert found(run(docs)) == brute(rows_of(docs))


def test_agrees_with_sql(spark):
    from tests.check_oracle import compare, connect

    small = "/root/testdata/sf0.001"
    assert compare(queries.merkle_manifest(spark, small), connect(small), oracles.MERKLE) == []
