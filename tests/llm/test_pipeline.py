import hashlib
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
import tiktoken
import public_tokenizers
from helpers import docs_of, prose
from test_chains import shared_runs
from test_decontaminate import brute as benchmark_hits
from test_simhash import brute_bits, brute_components

import corpus_pipeline
from patronlens.llm import bpe, toxicity
from patronlens.llm.queries import RANKS
from patronlens.llm.store import keep
from patronlens.staging import application_folder

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The table before the first and after every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(keep(stage(spark, tables[-1], folder), name)[0])
    return tables


def staged(spark):
    return [p.name for p in Path(application_folder(spark)).iterdir()]


def rows(table):
    return sorted((r["doc_id"], r["text"]) for r in table.collect())


def test_columns(stages):
    assert all(tuple(t.columns) == corpus_pipeline.COLUMNS for t in stages[1:-1])
    assert all(t.where("n_chars <> length(text)").count() == 0 for t in stages[:-1])


def test_toxicity(spark, folder, stages):
    scored = toxicity.score_toxicity(stages[0], spark.read.parquet(f"{folder}/labels.parquet"))
    clean = {r["doc_id"] for r in scored.where("score < 0.5").collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in clean]
    assert len(clean) < stages[0].count()


def test_near_duplicates(stages):
    before = rows(stages[1])
    heads = {least for _, _, least in brute_components([(i, brute_bits(t)) for i, t in before])}
    assert rows(stages[2]) == [r for r in before if r[0] in heads]


def test_repeated_passages(stages):
    before, after = rows(stages[2]), dict(rows(stages[3]))
    assert [i for i, _ in before] == sorted(after)
    assert shared_runs(list(after.items())) == {}
    runs = shared_runs(before)
    for doc, text in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        left = Counter(re.findall(r"[^\x20\x09-\x0D]+", after[doc]))
        assert not left - Counter(words)
        if doc not in runs and left != Counter(words):
            assert len(words) - sum(left.values()) >= 40  # a passage that is nearly the same


def test_benchmark(spark, folder, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = rows(stages[3]), dict(rows(stages[4]))
    for doc, text in before:
        n, hit, _ = benchmark_hits(text, items)
        assert (doc in after) == (hit <= 0.5 * n)
        if doc in after:
            assert after[doc] == text if not hit else len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", after[doc])) == n - hit


def test_tokens(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    expected = []
    for doc, text in rows(stages[4]):
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in stages[5].collect()) == expected


def test_run(spark, folder, stages):
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(stages[-1].collect())


def test_odd_documents(spark, folder, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, folder), name)[0]
    ids = [r["doc_id"] for r in docs.collect()]
    # One row of each text stays; those without an id and the second row of an id go like any other copy.
    assert set(ids) >= {1, 2, 5, 6, 7} and ids.count(1) == 1 and None not in ids


def test_rows_are_judged_one_by_one(spark, folder):
    """A toxic row goes though a clean one has its id or has none either; copies go though they share an id."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    bad = [rows[i] for i, s in scored.items() if s >= 0.5][:1] * 2
    good = [t for t in dict.fromkeys(rows[i] for i, s in sorted(scored.items()) if s < 0.5 and rows[i]) if len(t) > 300][:3]
    given = [(i, t) for i, t in rows.items()] + [(None, bad[0]), (None, good[0]), (90_001, bad[1]), (90_001, good[1]), (90_002, good[2]), (90_002, good[2])]
    docs = docs_of(spark, given)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()]
    assert (None, good[0]) in left and (90_001, good[1]) in left and left.count((90_002, good[2])) == 2
    assert (None, bad[0]) not in left and (90_001, bad[1]) not in left
    mixed = [(None, good[0]), (None, good[0]), (5, good[1]), (5, good[1]), (5, good[2]), (7, good[2])]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, mixed), folder).collect()]
    assert sorted(left, key=str) == sorted([(None, good[0]), (5, good[1]), (5, good[2])], key=str)


def test_one_id_with_two_texts(spark, folder):
    """The greatest text takes part in substring dedup, rows with another text of the id stay whole; nothing fails."""
    passage = prose("p", 80)
    given = [(1, passage), (2, f"{prose('z', 9)} {passage}"), (2, "zz " + passage), (2, "short")]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeated_passages(spark, docs_of(spark, given), folder).collect()]
    assert (1, passage) in left and (2, "short") in left and (2, "zz ") in left and (2, f"{prose('z', 9)} {passage}") in left


def test_nothing_but_the_last_table_is_left(spark, folder):
    before = set(staged(spark))
    corpus_pipeline.run(spark, folder)
    assert len(set(staged(spark)) - before) == 1


def test_no_documents(spark, folder, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_the_rest_does_not_need_this(tmp_path):
    """The entry file imports without the subpackage and the pipeline."""
    code = (
        "import sys\n"
        "sys.modules['patronlens.llm'] = None\n"
        "sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_this():
    for path in (ROOT / "patronlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "patronlens.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
