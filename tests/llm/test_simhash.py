import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import docs_of, prose

from patronlens.llm import components, simhash


def brute_bits(text):
    words = bytes((text or ""), "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, bits) -> least id reachable over two bits or fewer."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, bits, least.get(find(i))) for i, (doc, bits) in enumerate(rows))


def result(docs):
    found = simhash.near_duplicates(docs).collect()
    return Counter((r["doc_id"], r["bits"] % (1 << 64), r["component_id"]) for r in found)


def test_given_documents(documents, document_rows):
    assert result(documents) == brute_components([(i, brute_bits(t)) for i, t in document_rows])


def test_odd_rows(odd_docs, odd_rows):
    assert result(odd_docs) == brute_components([(i, brute_bits(t)) for i, t in odd_rows])


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies(spark):
    r = random.Random(4)
    rows = []
    for g in range(12):
        words = prose(g, 400).split()
        for _ in range(6):
            copy = list(words)
            copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    assert result(docs_of(spark, rows)) == brute_components([(i, brute_bits(t)) for i, t in rows])


def test_dense_tiles(spark, monkeypatch):
    """Thousands of fingerprints around one, over several tiles, keep the components of brute force."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    r = random.Random(9)
    center = [r.getrandbits(64) for _ in range(3)]
    bits = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in center for _ in range(150)}
    rows = [(i, b) for i, b in enumerate(sorted(bits))]
    signed = [(int(np.uint64(b).astype(np.int64)),) for _, b in rows]
    links = simhash.links(spark.createDataFrame(signed, "bits long"))
    nodes, _ = components.connected_components(links)
    parts = {}
    for node, component in nodes.collect():
        parts.setdefault(component, set()).add(node % (1 << 64))
    expected = {}
    for (doc, b, least), _ in brute_components(rows).items():
        expected.setdefault(least, set()).add(b)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(p) for p in expected.values() if len(p) > 1)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("tile_rows", [4, 2048])
def test_links_of_any_radius(spark, monkeypatch, radius, tile_rows):
    """The links connect what brute force connects and nothing else, in small blocks and in cut ones."""
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    r = random.Random(radius)
    centers = [r.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    bits = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius + 3))) for c in centers for _ in range(25)})
    signed = [(int(np.uint64(b).astype(np.int64)),) for b in bits]
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame(signed, "bits long"), radius).collect()]
    wanted = [(a, b) for i, a in enumerate(bits) for b in bits[:i] if (a ^ b).bit_count() <= radius]

    def groups(links):
        root = {b: b for b in bits}

        def find(b):
            while root[b] != b:
                b = root[b]
            return b

        for a, b in links:
            root[find(a)] = find(b)
        return Counter(tuple(b for b in bits if find(b) == top) for top in {find(b) for b in bits})

    assert groups(found) == groups(wanted)


def test_copies_of_a_fingerprint_do_not_grow(spark):
    """Fingerprints without large blocks go to one tile for each part, however many there are."""
    r = random.Random(1)
    for n in (2_000, 40_000):
        bits = [(r.getrandbits(63),) for _ in range(n)]
        prints = spark.createDataFrame(bits, "bits long")
        assert simhash.tiles(prints, 2, simhash.large_blocks(prints, 2)).count() == 3 * n


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame([*chain, *star, *chain, (7, 7), (None, 3), (300, 250)], "src long, dst long")
    found = {tuple(r) for r in components.connected_components(links)[0].collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(300, 250), (250, 250)}
    assert components.connected_components(links.limit(0))[0].count() == 0
