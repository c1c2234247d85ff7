import random
import re

from helpers import docs_of, prose

from patronlens.llm import licenses
from patronlens.llm.license_rules import Rule, all_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def spaced(text):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return found, "".join(f" {w} " for w in found)


def brute(text, rules):
    """Detections as (first, last, label, kind, kept) by rule, all pairs compared."""
    found, line = spaced(text)
    hits = []
    for rule in rules:
        if licenses.keyword(rule) in line:
            for m in re.finditer(licenses.signature(rule), line):
                first = line[: m.start()].count(" ") // 2
                hits.append((first, first + m.group().count(" ") // 2 - 1, rule))

    def order(h):
        return h[0], -h[1], -h[2].priority, h[2].label, h[2].kind, h[2].weight

    hits.sort(key=order)
    out = []
    for i, (a, b, rule) in enumerate(hits):
        inside = any(x <= a and y >= b and other.priority >= rule.priority for x, y, other in hits[:i])
        out.append((a, b, rule.label, rule.kind, not inside))
    return len(found), out


def base_places(text):
    found, _ = spaced(text)
    places = []
    for phrase, label in BASE.items():
        w = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(w)] == w]
    return sorted(places)


def assert_same(docs, rows, rules=None):
    scanned = licenses.scan_licenses(docs, rules=rules)
    chosen = rules or all_rules()
    expected = sorted(((i, *brute(t, chosen)) for i, t in rows), key=str)
    found = [(r["doc_id"], r["n_words"], [(d["first"], d["last"], d["label"], d["kind"], d["kept"]) for d in r["detections"]]) for r in scanned.collect()]
    assert sorted(found, key=str) == expected
    if rules is None:
        facts = sorted(((r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.summary(scanned).collect()), key=str)
        places = [(i, base_places(t)) for i, t in rows]
        wanted = [(i, len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x for _, x in p}))) for i, p in places]
        assert facts == sorted(wanted, key=str)


def test_given_documents(documents, document_rows):
    assert_same(documents, document_rows)


def test_odd_rows(odd_docs, odd_rows):
    assert_same(odd_docs, odd_rows)


def test_no_rows(no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0


def test_written_texts(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    texts = [
        "Released under the MIT License.", "MIT license MIT License mit  LICENSE", "SPDX-License-Identifier: GPL-2.0",
        "GNU General Public License, version 3 or any later version", "cc by-nc-sa 4.0 and CC BY", "permit license, limit license",
        notice, "(c) 2001. Copyright (c) 2001 X. All rights reserved.", "Apache License, Version 2.0; apache-2.0 licensed",
        "Creative Commons Attribution-ShareAlike 4.0 International License", "GPLv3 gpl v2 gpl-3.0", "mıt license apache license",
    ]
    rows = list(enumerate(texts))
    assert_same(docs_of(spark, rows), rows)
    summary = {r["doc_id"]: r for r in licenses.summary(licenses.scan_licenses(docs_of(spark, rows))).collect()}
    assert summary[0]["labels"] == "mit" and summary[0]["base_labels"] == "mit" and summary[0]["score"] == 0.95
    assert summary[1]["n_base"] == 3 and summary[1]["last_word"] == 4
    assert summary[2]["labels"] == "gpl-2.0" and summary[2]["score"] == 1.0
    assert summary[3]["labels"] == "gpl,gpl-3.0,gpl-or-later"
    assert summary[4]["labels"] == "cc-by,cc-by-nc-sa-4.0"
    assert summary[5]["labels"] == "" and summary[5]["score"] == 0.0


def test_many_detections(spark):
    rows = [(1, "mit license and " * 4000), (2, prose(3, 3000) + " cc by")]
    found = {r["doc_id"]: r for r in licenses.summary(licenses.scan_licenses(docs_of(spark, rows))).collect()}
    assert found[1]["n_base"] == 4000 and found[1]["last_word"] == 3 * 3999
    assert found[2]["first_word"] == 3000


def test_suppression(spark):
    """Random overlapping rules of every priority."""
    r = random.Random(3)
    kinds = ["base", "name", "grant", "tag", "clause"]
    rules = []
    for n in range(40):
        phrase = " ".join(r.choices("abcd", k=r.randint(1, 4)))
        rules.append(Rule(r.choice(kinds), f"l{n}", phrase.split()[0] * 1, phrase))
    rows = [(i, " ".join(r.choices("abcd", k=30))) for i in range(25)]
    assert_same(docs_of(spark, rows), rows, rules)


def test_rules():
    rules = all_rules()
    assert len(rules) > 400
    for rule in rules:
        re.compile(licenses.signature(rule))
        assert rule.label == rule.label.lower() and "," not in rule.label
