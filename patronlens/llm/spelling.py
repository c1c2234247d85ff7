"""Spelling variant grouping: words that differ by one code point, found in a trie of letter counts.

1. Words. Runs of letters are counted over all texts, first inside a task, then over the cluster. Runs that a hash picks lose
   one letter, which plants known variants.
2. Trie. The letters of the words are dealt into ``GROUPS`` groups, the most frequent ones alone. A word's path through the trie is how
   often each group stands in it, group after group. One inserted letter adds one to one count, one deleted letter
   takes one off, a replaced one does both at most; so a search may leave the path of its word by a surplus of one and a deficit of one.
3. Search. The subtrees below the first levels are the cells of a shuffle. A word lives in its own cell and visits the cells that the
   budget reaches, those behind its own only, so that a pair meets once; a large cell is cut in tiles by a hash and its visitors go to
   all of them. Inside a tile the search goes depth first and carries all searched words that are still within their budgets
   down to the leaves, where the words themselves are compared.
4. Forms. A task reports for each word how many near words it met and the most frequent of them, never the pairs; these rows
   are added up. Words follow their forms to the end by doubling; each round is written.

Nulls and empty texts have no words; in a row with a null id no run loses a letter. Repeated rows count as often as they stand there.
Runs of any length are words. Ties go to the smallest word in code-point order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.store import forget, keep
from patronlens.llm.text import utf8_values

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5
DROP_EVERY = 199
GROUPS = 20
MOST_COUNT = 15
LEAST_LEVELS, LEVEL_WORDS = 3, 1 << 20
TILE_ROWS = 16384
VISITOR_ROWS = 16384
BLOCK = 1 << 14
HELD_WORDS = 200_000
WIDTH = 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- words --------------------------------------------------------------------------------------


def runs_of(data: bytes, name: str | None, pattern: re.Pattern, drop_every: int) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they stand in it; ``pattern`` matches whole runs that are long enough."""
    start = None if name is None else zlib.crc32(f"{name}:".encode())
    for run, n in Counter(pattern.findall(data.translate(LOWER).decode())).items():
        if start is not None:
            h = zlib.crc32(run.encode(), start)
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """``word, n`` of words with ``least_length`` letters or more that stand ``least_count`` times or more in all texts together."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")
        held: Counter = Counter()
        for part in batches:
            for name, data in zip(part.column(0).to_pylist(), utf8_values(part.column(1))):
                for word, n in runs_of(data, name, pattern, drop_every):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch(held)
                    held.clear()
        if held:
            yield batch(held)

    source = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("t"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- trie ---------------------------------------------------------------------------------------


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[int, int]:
    """Group of each letter: the most frequent letters one each, the others dealt from the rarest group on.

    One row for each letter comes to the driver, 90 at most with the letters of ``LETTERS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            letters, n = np.unique(code_points(part.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(letters.astype(np.int32)), pa.array(n)], names=["letter", "n"])

    counted = words.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    ordered = [r["letter"] for r in counted.orderBy(F.desc("n"), "letter").collect()]
    return {letter: i if i < groups else groups - 1 - (i - groups) % groups for i, letter in enumerate(ordered)}


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the length of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths


def count_vectors(words: list[str], groups: dict[int, int]) -> np.ndarray:
    """How often each group stands in each word; counts beyond ``MOST_COUNT`` are that, which brings no two counts further apart."""
    points, lengths = code_points(words)
    letters = np.array(sorted(groups), np.uint32)
    group = np.array([groups[int(x)] for x in letters], np.int64)[np.searchsorted(letters, points)]
    levels = max(groups.values(), default=-1) + 1
    rows = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(rows * levels + group, minlength=len(words) * levels).reshape(len(words), levels)
    return np.minimum(counts, MOST_COUNT).astype(np.int8)


def _moves(levels: int) -> np.ndarray:
    """Ways to leave a path of ``levels`` counts by a surplus of one, a deficit of one or both at different levels."""
    one = np.eye(levels, dtype=np.int64)
    both = [one[i] - one[j] for i in range(levels) for j in range(levels) if i != j]
    return np.array([*one, *-one, *both], np.int64).reshape(-1, levels)


def cell_levels(n: int) -> int:
    """Levels of the trie above the cells of ``n`` words: one more for each doubling, as the fullest cell halves with a level."""
    return LEAST_LEVELS + max((max(n, 1) - 1) // LEVEL_WORDS, 0).bit_length()


def place_words(words: DataFrame, groups: dict[int, int], cell_levels: int) -> DataFrame:
    """``cell, role, word, n``: every word in its own cell (role 0) and in those that its budget reaches behind it (role 1)."""
    levels = max(min(cell_levels, len(set(groups.values()))), 1)
    scale = (MOST_COUNT + 1) ** np.arange(levels, dtype=np.int64)
    moves = _moves(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            paths = count_vectors(part.column(0).to_pylist(), groups)[:, :levels].astype(np.int64)
            own = paths @ scale
            moved = paths[:, None, :] + moves[None]
            cells = moved @ scale
            rows, way = np.nonzero(((moved >= 0) & (moved <= MOST_COUNT)).all(axis=2) & (cells > own[:, None]))
            cell = np.concatenate([own, cells[rows, way]])
            take = pa.array(np.concatenate([np.arange(len(own)), rows]))
            role = np.repeat(np.array([0, 1], np.int32), [len(own), len(rows)])
            columns = [pa.array(cell), pa.array(role), part.column(0).take(take), part.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell long, role int, word string, n long")


def tiles(placed: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``cell, tile, role, word, n``: the cells of ``placed`` cut in tiles; what visits a cell where no word lives goes."""
    homes, visits = placed.where("role = 0"), placed.where("role = 1")
    cells = homes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles"))
    lived = homes.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles"))
    visitors = visits.join(cells, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    # Later tiles of the own cell.
    further = lived.where("tile + 1 < tiles").withColumn("tile", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)))
    names = ["cell", "tile", "role", "word", "n"]
    return lived.select(names).unionByName(visitors.select(names)).unionByName(further.withColumn("role", F.lit(1)).select(names))


def search(held: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``asked`` and in ``held`` of count vectors that differ by a surplus of one and a deficit of one at most.

    ``held`` is sorted, first level first, so the words below a node of the trie are a range of it and the children of a
    node are the runs of equal counts in it. A node with few words and searches is compared as a whole.
    """
    levels = held.shape[1]
    everyone = np.arange(len(asked))
    stack = [] if not len(held) else [(0, len(held), 0, everyone, np.ones(len(asked), np.int8), np.ones(len(asked), np.int8))]
    while stack:
        low, high, level, who, surplus, deficit = stack.pop()
        if level == levels or (high - low) * len(who) <= BLOCK:
            step = max(BLOCK // (high - low), 1)
            for start in range(0, len(who), step):
                some = who[start : start + step]
                difference = held[None, low:high, level:] - asked[some][:, None, level:]
                over = np.maximum(difference, 0).sum(axis=2, dtype=np.int16) <= surplus[start : start + step, None]
                under = np.maximum(-difference, 0).sum(axis=2, dtype=np.int16) <= deficit[start : start + step, None]
                a, b = np.nonzero(over & under)
                if len(a):
                    yield some[a], low + b
            continue
        column, counts = held[low:high, level], asked[who, level]
        cuts = np.concatenate([[0], np.nonzero(np.diff(column))[0] + 1, [high - low]])
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            difference = column[first] - counts
            left, owed = surplus - np.maximum(difference, 0), deficit - np.maximum(-difference, 0)
            stay = np.nonzero((left >= 0) & (owed >= 0))[0]
            if len(stay):
                stack.append((low + first, low + last, level + 1, who[stay], left[stay], owed[stay]))


# --- words at the leaves ------------------------------------------------------------------------


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Words:
    """Words of a tile or of its visitors: count vectors, and letters aligned at either end."""

    def __init__(self, words: list[str], n: np.ndarray, groups: dict[int, int], is_sorted: bool = False):
        self.vectors = count_vectors(words, groups)
        if is_sorted:
            order = np.lexsort(self.vectors.T[::-1])
            self.vectors, n, words = self.vectors[order], n[order], [words[i] for i in order.tolist()]
        self.words, self.n = words, n
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.front, self.back = (np.array(side, f"<U{WIDTH}").view(np.uint32).reshape(-1, WIDTH) for side in (words, [w[::-1] for w in words]))
        self.rank = np.argsort(np.argsort(np.array(words, object), kind="stable")) if words else np.empty(0, np.int64)
        self.near = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def meet(self, places: np.ndarray, other: Words, partners: np.ndarray) -> None:
        """Count near words at ``places``, and remember the most frequent one."""
        np.add.at(self.near, places, 1)
        order = np.lexsort([other.rank[partners], -other.n[partners], places])
        first = order[np.concatenate([[True], np.diff(places[order]) != 0])]
        for place, partner in zip(places[first].tolist(), partners[first].tolist()):
            found = (-int(other.n[partner]), other.words[partner])
            self.best[place] = min(self.best.get(place, found), found)

    def report(self) -> Iterator[pa.RecordBatch]:
        """``word, n_near, best_n, best`` of the words that have met any."""
        if self.best:
            places = sorted(self.best)
            counts, best = zip(*(self.best[i] for i in places))
            columns = [pa.array([self.words[i] for i in places]), pa.array(self.near[places]), pa.array([-n for n in counts], pa.int64()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _same_in_front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)


def verified(asked: Words, a: np.ndarray, held: Words, b: np.ndarray) -> np.ndarray:
    """Which of the pairs are one code point apart."""
    la, lb = asked.lengths[a], held.lengths[b]
    short = np.minimum(la, lb)
    near = np.abs(la - lb) <= 1
    long = np.maximum(la, lb) > WIDTH
    fits = np.nonzero(near & ~long)[0]
    front = np.minimum(_same_in_front(asked.front[a[fits]], held.front[b[fits]]), short[fits])
    back = np.minimum(_same_in_front(asked.back[a[fits]], held.back[b[fits]]), short[fits])
    same_length = la[fits] == lb[fits]
    near[fits] = (front + back >= short[fits] - same_length) & ~(same_length & (front == short[fits]))
    for i in np.nonzero(near & long)[0].tolist():
        near[i] = one_apart(asked.words[a[i]], held.words[b[i]])
    return near


class _Tile:
    def __init__(self, groups: dict[int, int]):
        self.groups = groups
        self.parts: list[tuple[list[str], np.ndarray]] = []
        self.held: Words | None = None

    def close(self) -> Words:
        """The words that live here, which have met each other."""
        if self.held is None:
            words = [w for part, _ in self.parts for w in part]
            n = np.concatenate([n for _, n in self.parts]) if self.parts else np.empty(0, np.int64)
            self.held = Words(words, n, self.groups, is_sorted=True)
            self.parts = []
            for a, b in search(self.held.vectors, self.held.vectors):
                a, b = a[a < b], b[a < b]
                self._met(self.held, a, b)
        return self.held

    def visit(self, words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = self.close()
        for start in range(0, len(words), VISITOR_ROWS):
            asked = Words(words[start : start + VISITOR_ROWS], n[start : start + VISITOR_ROWS], self.groups)
            for a, b in search(held.vectors, asked.vectors):
                self._met(asked, a, b)
            yield from asked.report()

    def _met(self, asked: Words, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            near = verified(asked, a, self.held, b)
            a, b = a[near], b[near]
            if len(a):
                asked.meet(a, self.held, b)
                self.held.meet(b, asked, a)


def compare_tiles(groups: dict[int, int]):
    """``word, n_near, best_n, best`` of the words of tiles and their visitors, for rows sorted by cell, tile and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            cell, number, role = (batch.column(i).to_numpy() for i in range(3))
            change = (np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(role) != 0)
            cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), len(cell)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if (cell[low], number[low]) != key:
                    if tile:
                        yield from tile.close().report()
                    key, tile = (cell[low], number[low]), _Tile(groups)
                words, n = batch.column(3).slice(low, high - low).to_pylist(), batch.column(4).slice(low, high - low).to_numpy()
                if role[low] == 0:
                    tile.parts.append((words, n))
                else:
                    yield from tile.visit(words, n)
        if tile:
            yield from tile.close().report()

    return run


# --- forms --------------------------------------------------------------------------------------


def near_words(words: DataFrame, levels: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``word, n_near, best, best_n`` of ``words`` (word, n; each word once) that have near ones."""
    groups = letter_groups(words)
    placed = place_words(words, groups, cell_levels(words.count()) if levels is None else levels)
    placed = tiles(placed, tile_rows).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "role")
    met = placed.mapInArrow(compare_tiles(groups), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    added = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return added.select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> tuple[DataFrame, str | None]:
    """``word, root`` for ``forms`` (word, form), and the path that holds them. A form has a larger count than its word, so no walk turns in circles."""
    spark = forms.sparkSession
    known, path = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new, new_path = keep(joined, "roots")
        forget(spark, path)
        known, path = new.select("word", "root"), new_path
        if not new.where("moved").limit(1).count():
            return known, path


def group_variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    form_ratio: int = FORM_RATIO,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    spark = docs.sparkSession
    words, words_path = keep(count_words(docs, id_column, text_column, least_length, least_count), "words")
    is_form = F.col("best_n") >= form_ratio * F.col("n")
    judged = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    judged, _ = keep(judged, "forms")
    forget(spark, words_path)
    root, _ = roots(judged.where("form is not null"))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
