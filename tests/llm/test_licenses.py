import re

import pytest

from tallyweave.llm import licenses, queries
from tallyweave.llm.common import table

DOCS = "doc_id long, text string, labels string, row int, w string"
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return _WORD.findall((text or "").translate(_FOLD))


def brute_base(text):
    own, at, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(own)) if own[i : i + len(parts)] == parts]
        at += here
        labels |= {label} if here else set()
    return len(own), len(at), min(at, default=None), max(at, default=None), labels


def brute_labels(text, templates=licenses.TEMPLATES, threshold=0.8):
    """(labels, score): every window against every template, without any filter."""
    own, labels, score = words(text), set(), 0.0
    sets = [set(words(t.text)) for t in templates]
    for t, mine in zip(templates, sets, strict=True):
        reach = 1
        while reach < 1.25 * max(len(words(x.text)) for x in templates if x.family == t.family):
            reach *= 2
        for at in range(0, max(1, len(own)), reach):
            if at and at + reach >= len(own):
                break
            block = set(own[at : at + 2 * reach])

            def held(x, s, block=block):
                return len(s & block) >= threshold * len(s) - 1e-9 and set(words(x.keys)) <= block

            beaten = any(x.family == t.family and x.label != t.label and held(x, s) and mine & block < s & block for x, s in zip(templates, sets, strict=True))
            if held(t, mine) and not beaten:
                labels.add(t.label)
                score = max(score, len(mine & block) / len(mine))
    return labels, score


def expected(doc_id, text):
    n, places, first, last, base = brute_base(text)
    labels, score = brute_labels(text)
    return (doc_id, n, places, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else round(score, 12))


def shown(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 12)) for r in rows), key=str)


def scan(df, **other):
    found = licenses.scan(df, **other).collect()
    return [r.asDict() | {"base_labels": ",".join(r["base_labels"]), "labels": ",".join(r["labels"])} for r in found]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"  # smaller ones have no license lines
    docs = table(spark, sf, "documents").collect()
    got = queries.op11_licenses(spark, sf).collect()
    assert shown(got) == sorted((expected(r["doc_id"], r["text"]) for r in docs), key=str)
    assert any("gpl-3" in r["labels"] for r in got) and any(r["n_base"] for r in got)


FILL = " ".join(f"word{i}" for i in range(40))
ODD = {
    1: None, 2: "", 3: "...!", 4: "UNDER the MIT-license. cc by nc cc by\nnc", 5: "under the mit", 6: "cc by nc" * 1,
    7: f"{FILL}. Released, kindly, under the terms of the MIT License {FILL}", 8: "Licensed under CC BY-SA 4.0", 9: "Licensed under CC BY-NC-SA 4.0",
    10: f"{FILL} This program is licensed under the GNU Lesser General Public License, version 3. {FILL * 3}", 11: "This work is licensed under the GNU General Public License",
    12: f"{FILL} Permission is hereby granted free of any charge to a person obtaining one copy of this software and its associated documentation files {FILL}",
    13: "the the the of under license licensed version 2 0 this work is general public", 14: "Licensed under the Apache License, Version 1.1", 15: "Licensed under CC BY 4.0 and not under CC BY-NC 4.0",
    16: "K under the MİT license ünder the mit license", 17: " ".join([FILL] * 400) + " Released under the MIT License " + " ".join([FILL] * 400), 18: "cc by nc " * 300,
}


def test_odd_rows(spark):
    rows = [(i, t, "x", i, "y") for i, t in ODD.items()] + [(None, ODD[7], None, 1, ""), (7, ODD[7], "", 0, ""), (7, "under the mit license", "", 0, "")]
    got = scan(spark.createDataFrame(rows, DOCS).repartition(3))
    assert shown(got) == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[8] == "cc-by-sa" and labels[10] == "lgpl-3" and labels[11] == "" and labels[12] == "mit" and labels[13] == "" and labels[14] == "" and labels[17] == "mit"
    assert set(labels[9].split(",")) == {"cc-by-nc", "cc-by-nc-sa"}  # the phrase stands there


def test_empty_table_and_other_templates(spark):
    none = spark.createDataFrame([], DOCS)
    assert scan(none) == []
    df = spark.createDataFrame([(1, "alpha beta gamma delta", "", 0, ""), (2, "alpha beta", "", 0, "")], DOCS)
    many = [licenses.Template(f"l{k:03d}", f"f{k}", "", f"alpha beta gamma delta epsilon{k}") for k in range(80)]  # more than a long has bits
    got = {r["doc_id"]: r for r in scan(df, templates=many, phrases={"beta gamma": "l005"})}
    assert got[1]["labels"] == ",".join(f"l{k:03d}" for k in range(80)) and got[1]["base_labels"] == "l005" and got[2]["labels"] == "" and got[2]["score"] == 0
    part = {r["doc_id"]: r["score"] for r in scan(df, templates=many[:1], phrases={"no such": "x"})}
    assert part == {1: pytest.approx(0.8), 2: 0.0}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op11_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan
