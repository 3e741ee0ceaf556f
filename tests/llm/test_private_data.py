import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import private_data as pd
from ebbtide.llm import queries

SMALL = "/root/testdata/sf0.001"
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, form in FORMS.items():
        for m in form.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(docs):
    rows = pd.digest(pd.find(docs, ["doc_id", "text"]), ["doc_id", "text"]).collect()
    for r in rows:
        want = base(r["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r["text"] or "")[:200]
        assert r["spans"].split(",")[: len(want)] == want if want else not re.match("(email|ip|card|phone):", r["spans"])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k) for s in want) for k in FORMS)
    return rows


ODD = [
    "a@b.c.d@e.f g@h", "a@b.c_d@e.f", "x..y%z@mail-1.example.com,x@y", "@a.b a@.b a@b. a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.02.3.004 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111111111111111" * 2, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "0" * 13 + "  " + "0" * 20, "12-", "5 ",
    "+1 (988) 555-2485 +1 +12 +1 2", "+49 30 123456789012345", "++1 234567890", "+1().-", "é🙂 a@b.c é 10.0.0.1", "東京4111111111111111東京", "99999999999999999999.1.1.1", "a@b.c" * 3,
    "4111 1111 1111  1111 4111 1111 1111 1111", "0.0.0.0000000000000000255",
]


def test_odd_texts_against_python(spark):
    check(spark.createDataFrame(list(enumerate([*ODD, None, ""])), "doc_id long, text string"))


def test_random_texts_against_python(spark):
    rng = random.Random(8)
    parts = list("0123456789") * 2 + list(" .-+()@a_%é") + ["4111111111111111", "@x.y", "10.0.0.1", "+1 555 123 4567"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_test_data_against_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(check(docs)) == queries.personal_data(spark, SMALL).count() == docs.count()


def test_very_long_runs(spark):
    texts = ["1" * 60_000, "a" * 60_000, "a." * 30_000, "1 " * 20_000, "a@" + "b." * 20_000, "+" * 20_000, "1." * 20_000, "+1 " * 20_000, "12345 " * 20_000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def seeded(spark):
    rows = [(i, f"Please charge my card number 4111 1111 1111 1111 today {i}") for i in range(2)]
    rows += [(10 + i, f"my card number {n} was lost") for i, n in enumerate(["5500005555555559", "340000000000009", "6011000000000004", "3530111333300000"])]
    rows += [(20, "and my card number 1234-5678-AX was lost"), (21, "an order number 20240501 shipped"), (22, "page 12345 of the book"), (23, None), (23, "and my card number 1234-5678-AX was lost")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = {(r["doc_id"], r["spans"]) for r in pd.digest(pd.find(seeded(spark), ["doc_id"]), ["doc_id"]).collect()}
    text = "and my card number 1234-5678-AX was lost"
    at = text.index("1234")
    assert (20, f"id:{at}:{at + 12}") in rows and (21, "") in rows and (22, "") in rows and (23, "") in rows


def test_patterns_need_support(spark):
    few = pd.digest(pd.find(seeded(spark), ["doc_id"], pd.Settings(support=50)), ["doc_id"])
    assert all("id:" not in r["spans"] for r in few.collect())


def scores_by_hand(edges, rounds, support, least):
    """Pattern scores by dictionaries; edges: (pattern, value, seed)."""
    belief = {(p, v): float(s) for p, v, s in edges}
    for _ in range(rounds):
        patterns = {p for p, _ in belief}
        score = {}
        for p in patterns:
            own = [b for (q, _), b in belief.items() if q == p]
            if sum(b > 0 for b in own) >= support:
                score[p] = sum(own) / len(own)
        for p, v, s in edges:
            miss = 1.0
            for q, w, _ in edges:
                if w == v and q in score:
                    miss *= max(1 - score[q], 1e-6)
            belief[p, v] = 1.0 if s else (1 - miss if 1 - miss >= least else 0.0)
    return {p: sum(b for (q, _), b in belief.items() if q == p) / sum(q == p for q, _ in belief) for p in {p for p, _ in belief}}


def test_scores_against_plain_iteration(spark):
    rng = random.Random(3)
    instances = [(v, rng.random() < 0.6, sorted(rng.sample(["p1", "p2", "p3", "p4"], rng.randrange(1, 4)))) for v in range(40)]
    frame = spark.createDataFrame(instances, "value long, seed boolean, patterns array<string>")
    settings = pd.Settings(confidence=0.0)
    got = {r["pattern"]: r["score"] for r in pd.confident_patterns(frame, settings).collect()}
    want = scores_by_hand([(p, v, s) for v, s, ps in instances for p in ps], settings.rounds, settings.support, settings.belief)
    assert got == pytest.approx(want)


def test_odd_rows(documents, nothing):
    assert len(check(documents)) == documents.count()
    assert pd.find(nothing, ["doc_id"]).count() == 0


def test_no_python_in_the_plan(spark):
    df = pd.digest(pd.find(seeded(spark), ["doc_id"]), ["doc_id"])
    text = df._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
