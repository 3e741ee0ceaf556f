import re

import pytest

from ebbtide.llm import license_templates as lt
from ebbtide.llm import queries
from tests.check_oracle import connect

SMALL = "/root/testdata/sf0.001"


def words(text):
    return lt.WORD.findall(text.lower().encode())


def test_optional_and_replaceable_parts():
    a = lt.compile_template("alpha <<beginOptional>>beta gamma<<endOptional>> delta <<var;match=2>> end")
    match = lambda t: a.match(words(t), 0)
    assert match("Alpha beta-gamma, delta; end") == 5
    assert match("alpha delta end") == 3
    assert match("alpha delta x y end") == 5
    assert match("alpha delta x y z end") is None
    assert match("alpha beta delta end") is None
    assert match("alpha delta") is None
    assert match("alpha gamma delta end") is None


def test_bad_templates_are_refused():
    for bad in ("a <<beginOptional>> b", "<<endOptional>> a", "<<beginOptional>>a<<endOptional>>", "<<var;match=3>> a"):
        with pytest.raises(ValueError):
            lt.compile_template(bad)


def test_every_template_accepts_its_own_mandatory_wording():
    for label, markup in lt.TEMPLATES.items():
        bare = re.sub(r"<<beginOptional>>(?:(?!<<endOptional>>).)*<<endOptional>>", " ", markup)
        bare = re.sub(r"<<var;match=\d+>>", " ", bare)
        full = re.sub(r"<<(?:begin|end)Optional>>", " ", re.sub(r"<<var;match=\d+>>", " word ", markup))
        matcher = lt.Matcher(lt.TEMPLATES, lt.BASE_PHRASES)
        assert label in {s[0] for s in matcher.found(bare.encode())}, label
        assert label in {s[0] for s in matcher.found(full.encode())}, label
        broken = " ".join(w for w in bare.split()[:-1])
        assert label not in {s[0] for s in matcher.found(broken.encode())}, label


def plain(text):
    """Base columns, by going through the words one by one."""
    w = [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    hits = [(i, label) for p, label in lt.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_against_brute_force(spark, documents):
    made = spark.createDataFrame([(100, "CC-BY and cc by; General   Public\nLicense. all rights reserved All rights reserved"), (101, "cc byé cc_by accby ccby")], "doc_id long, text string")
    for docs in (made, documents.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")):
        want = sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=str)
        got = sorted((tuple(r)[:6] for r in lt.scan(docs, ["doc_id"]).collect()), key=str)
        assert got == want


def test_labels_and_scores(spark, nothing):
    rows = {1: "Released under the MIT License.", 2: "All rights reserved.", 3: "nothing", 4: None, 5: "Licensed under the Apache License, Version 2.0."}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"], r["score"], r["matches"]) for r in lt.scan(docs, ["doc_id"]).collect()}
    assert got == {
        1: ("", "mit", 1.0, "mit:0:5,mit:1:5"),
        2: ("reserved", "reserved", 0.5, ""),
        3: ("", "", 0.0, ""),
        4: ("", "", 0.0, ""),
        5: ("", "apache-2.0", 1.0, "apache-2.0:0:8"),
    }
    assert lt.scan(nothing, ["doc_id"]).count() == 0


def test_query_has_a_row_for_each_document(spark):
    assert queries.license_scan(spark, SMALL).count() == connect(SMALL).execute("select count(*) from documents").fetchone()[0]
