import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import docs_of, with_clashes

from patronlens.llm import spelling
from patronlens.llm.queries import op12_spelling


def edits(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = None if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(counts):
    out, near = [], {w: [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def found(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda r: r[0])


def variants(seed, families=12):
    """Words that differ by a letter or two, with counts that make chains of forms and ties."""
    r, words = random.Random(seed), {}
    for _ in range(families):
        word = "".join(r.choices("abcdeéñßÀ", k=r.randint(6, 9)))
        for _ in range(14):
            words[word] = r.choice([1, 4, 5, 5, 6, 25, 26, 130, 700])
            at, c = r.randrange(len(word) + 1), r.choice("abcdeéñßÀ")
            word = r.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])
    return words


def texts_of(words, seed):
    r = random.Random(seed)
    tokens = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(tokens)
    return [(i, " ".join(tokens[i::40])) for i in range(40)]


def test_against_brute_force(spark):
    rows = texts_of(variants(1) | {"ABCDEF": 9, "x" * 40: 5, "x" * 41: 30, "y" * 39 + "z": 7}, 2)
    counts = brute_words(rows)
    assert any(len(w) > spelling.WIDTH for w in counts) and len(counts) > 60
    assert found(spelling.group_variants(docs_of(spark, rows))) == brute(counts)


def test_given_documents(spark, folder, document_rows):
    counts = brute_words(document_rows)
    assert found(op12_spelling(spark, folder)) == brute(counts)


def test_runs_lose_a_letter(document_rows):
    """Some runs of the documents are changed, as the hash says."""
    whole = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, t in document_rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")}
    pattern = re.compile(f"[{spelling.LETTERS}]{{6,}}")
    changed = [w for i, t in document_rows for w, _ in spelling.runs_of((t or "").encode(), str(i), pattern, 199) if w not in whole]
    assert changed


def test_any_levels_and_tiles(spark):
    """The cells and tiles decide where words meet, never which."""
    counts = {w: n for w, n in variants(5).items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").cache()
    expected = {w: (n, m) for w, _, _, _, n, m in brute(counts) if n}
    for levels, tile_rows in ((1, 10_000), (3, 7), (6, 3), (20, 1000)):
        got = {r["word"]: r for r in spelling.near_words(words, levels, tile_rows).collect()}
        assert {w: r["n_near"] for w, r in got.items()} == {w: n for w, (n, _) in expected.items()}
        assert all(r["best_n"] == m for w, r in got.items() if (m := expected[w][1]))
    words.unpersist()


def test_levels_grow_with_the_words():
    assert [spelling.cell_levels(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 22, 1 << 30)] == [3, 3, 3, 4, 5, 13]


def test_search_leaves_out_nothing():
    """All pairs within the budget, whether compared as a block or walked to the leaves."""
    r = np.random.default_rng(1)
    held = r.integers(0, 4, (300, 6)).astype(np.int8)
    held, asked = held[np.lexsort(held.T[::-1])], r.integers(0, 4, (200, 6)).astype(np.int8)
    difference = held[None].astype(int) - asked[:, None]
    expected = (np.maximum(difference, 0).sum(2) <= 1) & (np.maximum(-difference, 0).sum(2) <= 1)
    for block in (1, 64, 1 << 20):
        before, spelling.BLOCK = spelling.BLOCK, block
        try:
            got = np.zeros((200, 300), int)
            for a, b in spelling.search(held, asked):
                np.add.at(got, (a, b), 1)
        finally:
            spelling.BLOCK = before
        assert (got == expected).all()


def test_one_apart():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choices("abé", k=r.randint(0, 5))) for _ in range(2))
        assert spelling.one_apart(a, b) == (edits(a, b) == 1)


def test_verified_is_one_apart():
    r = random.Random(6)
    words = sorted({"".join(r.choices("ab", k=r.choice([3, 4, 31, 32, 33]))) for _ in range(80)} | {"a" * n for n in range(28, 36)})
    groups = {97: 0, 98: 1}
    held = spelling.Words(words, np.ones(len(words), np.int64), groups)
    a, b = (x.ravel() for x in np.indices((len(words), len(words))))
    assert spelling.verified(held, a, held, b).tolist() == [spelling.one_apart(words[i], words[j]) for i, j in zip(a, b)]


def test_ties_go_to_the_smallest_word(spark):
    rows = texts_of({"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdeé": 25}, 3)
    rows = [(None, t) for _, t in rows]  # no run loses a letter
    assert found(spelling.group_variants(docs_of(spark, rows)))[0] == ("abcdef", "abcdeg", "abcdeg", 5, 3, 25)


def test_forms_are_followed_to_the_end(spark):
    words = {"aaaaaaa" + "b" * i: 5 ** (i + 1) for i in range(5)}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    assert {r[2] for r in found(spelling.group_variants(docs_of(spark, rows)))} == {"aaaaaaabbbb"}


def test_odd_documents(spark, odd_rows, odd_docs):
    """Null ids and texts, repeated rows, a very long run of letters, columns that clash."""
    rows = [*odd_rows, *[(20, "stutter " * 5), (20, "stutter " * 5), (21, "statter " * 60), (22, "q" * 70_000 + " x")] * 5]
    assert found(spelling.group_variants(with_clashes(docs_of(spark, rows)))) == brute(brute_words(rows))
    assert found(spelling.group_variants(odd_docs)) == brute(brute_words(odd_rows))


def test_no_documents(spark, no_docs):
    assert spelling.group_variants(no_docs).count() == 0
    assert spelling.group_variants(docs_of(spark, [(1, "few words only"), (2, None)])).count() == 0
