import re
from collections import Counter

import pytest
from helpers import docs_of, prose

from patronlens.llm import decontaminate
from patronlens.llm.decontaminate import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item) if item is not None else "null")
    return len(doc), len(hit), tuple(sorted(found))


def result(docs, benchmark, **options):
    rows = decontaminate.find_contamination(docs, benchmark, **options).collect()
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows)


@pytest.fixture(scope="module")
def item_rows():
    shared = prose(50, 12)
    return [
        (1, prose(40, 30)), (2, shared + " " + prose(41, 8)), (3, prose(42, 9) + " " + shared), (4, "Short item, here!"),
        (5, "short ITEM"), (6, None), (7, ""), (8, "..."), (1, prose(40, 30)), (None, prose(43, 14)), (9, "de de de de de de de de de de de"),
    ]


@pytest.fixture(scope="module")
def planted(item_rows):
    item = {i: t for i, t in item_rows}
    piece = item[1].split()
    rows = [
        (1, prose(60, 40) + " " + item[1].upper() + "; " + prose(61, 5)), (2, " ".join(piece[3:14])), (3, " ".join(piece[3:12])),
        (4, item[2] + " " + item[3]), (5, "a short item here b short item"), (6, item[None]), (7, "de " * 40), (8, None), (9, ""),
        (10, prose(50, 12).replace(" ", ",\n ")), (10, prose(50, 12)), (None, item[1] * 2), (11, " ".join(piece[5:16] + piece[0:12])),
    ]
    return rows


def expected(rows, items):
    return Counter((i, *brute(t, items)) for i, t in rows)


def test_planted(spark, planted, item_rows):
    assert result(docs_of(spark, planted), spark.createDataFrame(item_rows, ITEMS)) == expected(planted, item_rows)


def test_in_blocks(spark, planted, item_rows):
    """Blocks smaller than an item give the same."""
    benchmark = spark.createDataFrame(item_rows, ITEMS)
    assert result(docs_of(spark, planted), benchmark, block_words=7) == expected(planted, item_rows)


def test_odd_rows(spark, odd_docs, odd_rows, item_rows):
    assert result(odd_docs, spark.createDataFrame(item_rows, ITEMS)) == expected(odd_rows, item_rows)


def test_no_rows(spark, no_docs, planted):
    assert result(no_docs, spark.createDataFrame([(1, "a b")], ITEMS)) == Counter()
    assert result(docs_of(spark, planted), spark.createDataFrame([], ITEMS)) == expected(planted, [])


def test_automaton_against_brute_force():
    import random

    r = random.Random(5)
    for _ in range(150):
        items = [(str(i), [bytes([r.choice(b"abc")]) for _ in range(r.randint(0, 9))]) for i in range(r.randint(0, 4))]
        doc = [bytes([r.choice(b"abcd")]) for _ in range(r.randint(0, 60))]
        spans, found = Automaton(items, window=4).scan(doc)
        hit, names = set(), set()
        for item, w in items:
            size = min(4, len(w))
            grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(doc) - size + 1):
                if tuple(doc[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    names.add(item)
        assert {x for a, b in spans for x in range(a, b + 1)} == hit and found == names


def test_removal(spark):
    item = prose(70, 15)
    benchmark = spark.createDataFrame([(1, item)], ITEMS)
    rows = [(1, "Before, this. " + item.upper() + "! And after " + prose(71, 20)), (2, item), (3, "clean text"), (4, None), (5, "")]
    docs = docs_of(spark, rows)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    left = "Before, this. ! And after " + prose(71, 20)
    assert kept == {1: (left, len(left)), 3: ("clean text", 10), 4: (None, 0), 5: ("", 0)}
