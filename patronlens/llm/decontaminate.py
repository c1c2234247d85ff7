"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document streams through it once: at each
word the state is the longest suffix read so far that occurs in some item, and its length. Where that
length reaches the window, the words are hit. The documents are never shuffled.

The items are a query set that is held in memory, in blocks of ``BLOCK_WORDS`` words at most; each
block costs one more pass over the documents. Items longer than a block are cut with enough overlap
that no window is lost.

Nulls: a null text has no words, a null item id counts as the string "null". Repeated items add
nothing; an item without words never occurs. Rows with equal ids are separate rows. Clashing columns
of the documents are not touched: the result has the id columns asked for and its own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.store import keep
from patronlens.llm.text import ALNUM_WORD, alnum_words, cut_spans, utf8_values

WINDOW = 10
BLOCK_WORDS = 200_000
MAX_COVERAGE = 0.5
FOUND = ("n_words", "n_hit", "spans", "items")


class Automaton:
    """States with a transition per word; the initial state is 0.

    ``window`` words are a window; items of fewer words are a window as a whole.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = array("i", [-1])
        self.length = array("i", [0])
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: State of a window -> items that hold it; whole short items end in a state of their own.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.shortest = window
        for item, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.step[state][word]
                if i + 1 >= window:
                    self.items.setdefault(self.window_state(state), set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
                self.shortest = min(self.shortest, len(words))

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        """The automaton of ``vars()`` of another one."""
        made = cls.__new__(cls)
        vars(made).update(parts)
        return made

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The target of ``state`` over ``word``, cut so that its longest run ends there."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def window_state(self, state: int) -> int:
        """The state on the suffix path that stands for the last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def short_ends(self, state: int, matched: int) -> list[tuple[int, str]]:
        found = []
        while state > 0:
            found += [x for x in self.short.get(state, ()) if x[0] <= matched]
            state = self.link[state]
        return found

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans (first and last word, ascending, apart from each other) and the items that occur."""
        step, link, length, window, shortest = self.step, self.link, self.length, self.window, self.shortest
        spans: list[list[int]] = []
        ends: set[int] = set()
        items: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            target = step[state].get(word)
            if target is None:
                while state and target is None:
                    state = link[state]
                    target = step[state].get(word)
                if target is None:
                    matched = 0
                    continue
                matched = length[state]
            matched += 1
            state = target
            if matched >= shortest:
                first = i + 1
                if matched >= window:
                    ends.add(state)
                    first -= matched
                if self.short:
                    for size, item in self.short_ends(state, matched):
                        items.add(item)
                        first = min(first, i + 1 - size)
                if first <= i:
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i])
        for top in {self.window_state(s) for s in ends}:
            items |= self.items.get(top, set())
        return spans, items


def blocks(benchmark: DataFrame, id_column: str, text_column: str, window: int, block_words: int) -> Iterator[list]:
    """Items as (id, words), in lists of ``block_words`` words at most."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.col(text_column).cast("string"))
    for item, text in rows.toLocalIterator():
        words = alnum_words((text or "").encode())
        for start in range(0, max(1, len(words) - window + 1), block_words):
            part = words[start : start + block_words + window - 1]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    if block:
        yield block


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _spans_array(spans: list[list[list[int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.array([[{"first": a, "last": b} for a, b in row] for row in spans], kind)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    columns: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``columns`` of every document with ``n_words, n_hit, spans`` (words, both ends included) and ``items``."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(columns))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(text_column).cast("string").alias("_text"))
    source = source.select("*", F.lit(None).cast("array<struct<first:long,last:long>>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])

    def scanner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.of(shared.value)
            for batch in batches:
                table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                spans, items, n_words = [], [], []
                before = zip(table["_spans"].to_pylist(), table["_items"].to_pylist())
                for data, (old_spans, old_items) in zip(utf8_values(table["_text"]), before):
                    words = alnum_words(data)
                    found, names_found = automaton.scan(words)
                    if old_spans:
                        found = _merge(found + [[s["first"], s["last"]] for s in old_spans])
                    spans.append(found)
                    items.append(sorted(names_found.union(old_items or ())))
                    n_words.append(len(words))
                table["_spans"], table["_items"] = _spans_array(spans), pa.array(items, pa.list_(pa.string()))
                table["n_words"] = pa.array(n_words, pa.int64())
                table["n_hit"] = pa.array([sum(b - a + 1 for a, b in row) for row in spans], pa.int64())
                yield pa.RecordBatch.from_arrays(list(table.values()), list(table))

        return run

    def scan(automaton: Automaton) -> DataFrame:
        return source.mapInArrow(scanner(spark.sparkContext.broadcast(vars(automaton))), schema)

    result = None
    for block in blocks(benchmark, item_column, item_text_column, window, block_words):
        if result is not None:
            source = keep(result.drop("n_words", "n_hit"), "scanned")[0]
        result = scan(Automaton(block, window))
    if result is None:
        result = scan(Automaton([], window))
    named = [F.col(n).alias(c) for c, n in zip(columns, names)]
    return result.select(*named, "n_words", "n_hit", F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """The documents without hit spans; those with more than ``max_coverage`` of their words hit go.

    What stands around a span stays as it is, as do all other columns; ``n_chars``, if there, is counted anew.
    """
    text = options.pop("text_column", "text")
    kept = [f"_kept_{c}" if c in FOUND else c for c in docs.columns]
    text = kept[docs.columns.index(text)]
    found = find_contamination(docs.toDF(*kept), benchmark, tuple(kept), text, **options)
    clean = found.where(F.col("n_hit") <= max_coverage * F.col("n_words")).drop("n_words", "n_hit", "items")
    return cut_spans(clean, text, "spans", ALNUM_WORD).toDF(*docs.columns)
