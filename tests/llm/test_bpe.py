import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from helpers import docs_of

from patronlens.llm import bpe
from patronlens.llm.queries import RANKS, op10_bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, public_tokenizers.PATTERN)


def encoded(docs):
    return bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def test_given_documents(spark, folder, document_rows, library):
    def row(doc, text):
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        return doc, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()

    found = sorted(tuple(r) for r in op10_bpe(spark, folder).collect())
    assert found == sorted(row(*r) for r in document_rows)


def test_odd_rows(odd_docs, odd_rows, library):
    found = [(r["doc_id"], r["ids"]) for r in encoded(odd_docs).collect()]
    assert sorted(found, key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in odd_rows), key=str)
    decoded = bpe.decode(encoded(odd_docs), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in decoded) == sorted((t or "").encode() for _, t in odd_rows)
    both = bpe.round_trip(odd_docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in both if r["doc_id"]) == sorted((r["doc_id"], r["ids"]) for r in encoded(odd_docs).collect() if r["doc_id"])
    assert all(bytes(r["decoded"]) in {(t or "").encode() for i, t in odd_rows if i == r["doc_id"]} for r in both)


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(rows, RANKS).collect()}
    assert found[1] == found[2] == b"" and len(found[3]) == 2


def test_no_rows(no_docs):
    assert encoded(no_docs).count() == 0


def test_random_pieces(codec, library):
    r = random.Random(2)
    alphabets = ["abcdefgh", "aàâéêëñß", " \n\t", "!?*#%$", "日本語中文", "0123456789", "aA zZ.,'sé\n🎉"]
    for _ in range(400):
        text = "".join(r.choices(r.choice(alphabets), k=r.randint(0, 300)))
        assert codec.encode(text) == library.encode_ordinary(text)


def test_long_pieces(codec, library):
    r = random.Random(3)
    for text in ["a" * 3000, "ab" * 900, " " * 2500, "".join(r.choices("abcdeté", k=2500)), "!" * 1200]:
        assert codec.encode(text) == library.encode_ordinary(text)


def test_cache_may_be_cleared(monkeypatch, ranks, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    small = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for text in ("one two three four five six", "six five four three two one", "one", "seven eight nine one two"):
        assert small.encode(text) == library.encode_ordinary(text)


def test_ids_that_repeat(spark, library):
    docs = docs_of(spark, [(1, "same"), (1, "same"), (1, "other")])
    assert sorted(r["ids"] for r in encoded(docs).collect()) == sorted(map(library.encode_ordinary, ["same", "same", "other"]))


def test_a_worker_holds_the_pieces_of_little_text_at_once():
    texts = ["a b" * 30_000, None, "", *["c d" * 30_000] * 9, "e" * 2_000_000, "f"]
    parts = [p.column(0).to_pylist() for p in bpe._parts(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]))]
    assert [t for p in parts for t in p] == texts
    # One text may go over, whatever its length.
    assert all(sum(len(t or "") for t in p[:-1]) < 250_000 for p in parts)
