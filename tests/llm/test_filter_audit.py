import random
from collections import Counter
from itertools import permutations
from math import factorial

from helpers import docs_of, with_clashes
from pyspark.sql import functions as F

from patronlens.llm import filter_audit as audit
from patronlens.llm.queries import op13_filter_audit

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        letter
        for letter, fails in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
        )
        if fails
    }


def brute(rows, labels):
    """Every order applied to every document, one step after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc, text, part in rows:
        text = text or ""
        copy = doc is not None and any(i is not None and i < doc and (t or "") == text for i, t, _ in rows)
        docs.append((part or "", failed(text) | ({"E"} if copy else set()), doc in good, doc in toxic))
    out = {}
    for order in permutations("ABCDE"):
        counts = Counter()
        for part, fails, is_good, is_toxic in docs:
            here = next((i for i, f in enumerate(order, 1) if f in fails), 9)
            for step, f in enumerate(order, 1):
                counts[part, step, "kept"] += step < here
                counts[part, step, "removed"] += step == here
                counts[part, step, "redundant"] += f in fails and here < step
                counts[part, step, "unique_fails"] += fails == {f}
                counts[part, step, "good_lost"] += step == here and is_good
                counts[part, step, "toxic_lost"] += step == here and is_toxic
        for part in {d[0] for d in docs}:
            for step in range(1, 6):
                out[part, "".join(order), step] = [counts[part, step, c] for c in COLUMNS[3:9]]
    shapley = Counter()
    for (part, order, step), values in out.items():
        shapley[part, order[step - 1]] += values[1]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def found(spark, rows, labels, clash=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("id", "part", "mask", "digest", "n", "good", "step")]) if clash else docs
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(audit.mask_counts(docs, spark.createDataFrame(labels, LABELS))).collect())


def test_intervals_cover_what_a_walk_covers():
    orders = list(permutations(range(5)))
    for mask in range(32):
        expected = {
            (next(s for s, f in enumerate(order, 1) if mask >> f & 1), rank) for rank, order in enumerate(orders) if mask
        }
        covered = [(step, rank) for step, low, high in audit.removal_intervals(mask) for rank in range(low, high)]
        assert len(covered) == len(set(covered)) and set(covered) == expected


def test_ends_sum_to_one_or_nothing():
    sums = Counter()
    for mask, step, rank, change in audit.interval_ends():
        for r in range(rank, factorial(5)):
            sums[mask, step, r] += change
    assert set(sums.values()) <= {0, 1}
    assert all(sum(sums[mask, step, r] for step in range(1, 6)) == 1 for mask in range(1, 32) for r in range(120))


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{i}" for i in range(r.choice([60, 400]))], k=r.choice([5, 199, 200, 300]))) + r.choice(["", " $", " ABCDEFGH" * 9]) for _ in range(25)]
    rows = [(r.randrange(60), r.choice(texts), r.choice(["a", "b", "c", None])) for _ in range(120)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_limits_of_the_filters():
    assert not audit.text_mask(b"") & 2 and audit.text_mask(b"") & 1
    words = [b"w%d" % i for i in range(100)]
    assert audit.text_mask(b" ".join(words * 2)) == 0
    assert audit.text_mask(b" ".join([*words * 2, b"w1"])) == 2
    assert audit.text_mask(b"AB" + b"x" * 98) & 4 == 0 and audit.text_mask(b"AB" + b"x" * 97) & 4
    assert audit.text_mask("AB".encode() + "é".encode() * 98) & 4 == 0
    assert [audit.text_mask(c.encode()) & 8 for c in "#$%&*|"] == [8] * 6 and not audit.text_mask(b"+-!@^~") & 8


def test_copies(spark):
    """The smallest id of a text is no copy, in whatever part it stands; repeated rows of it are none either; rows without an id are none."""
    rows = [(3, "t", "a"), (1, "t", "b"), (1, "t", "b"), (1, "t", "a"), (2, "t", "a"), (None, "t", "a"), (None, "t", None), (4, None, "a"), (5, "", "a")]
    labels = [(3, 1, None), (3, 0, 1), (1, 1, 1), (1, 1, 1), (None, 1, 1)]
    assert found(spark, rows, labels) == found(spark, rows, labels, clash=True) == brute(rows, labels)
    copies = {r[0]: r[6] for r in found(spark, rows, labels) if r[1] == "AEBCD" and r[2] == 1}
    assert copies == {"a": 3, "b": 2, "": 1}


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}", f"s{i % 2}") for i in range(600)]
    assert found(spark, rows, [(i, 1, i % 2) for i in range(0, 600, 3)]) == brute(rows, [(i, 1, i % 2) for i in range(0, 600, 3)])


def test_odd_documents(spark, odd_rows, odd_docs):
    """A long text, repeated rows, nulls, columns that clash."""
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, 1)], LABELS)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(audit.mask_counts(odd_docs, with_clashes(labels))).collect())
    assert got == brute([(i, t, "s") for i, t in odd_rows], [(1, 1, 0), (None, 1, 1), (5, None, 1)])


def test_no_documents(spark, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(audit.mask_counts(no_docs, labels)).count() == 0
    some = audit.audit(audit.mask_counts(docs_of(spark, [(1, "a")]), labels))
    assert some.count() == 600 and some.agg(F.sum("good_lost")).first()[0] == 0


def test_registered_query_has_every_order_and_step(spark, folder):
    rows = op13_filter_audit(spark, folder)
    assert rows.groupBy("part").agg(F.countDistinct("filter_order", "step").alias("n")).where("n <> 600").count() == 0
    assert rows.where("step = 5").groupBy("part").agg(F.countDistinct("kept").alias("n")).where("n <> 1").count() == 0
