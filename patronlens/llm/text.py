"""Bytes and words of texts inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lower-cases A-Z, keeps a-z, 0-9 and every byte of a character beyond ASCII; all else becomes a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


ROWS_AT_ONCE = 64


def utf8_values(column: pa.Array) -> Iterator[bytes]:
    """Every value as UTF-8, a few rows taken out of the batch at a time; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for start in range(0, len(column), ROWS_AT_ONCE):
        for value in column.slice(start, ROWS_AT_ONCE).cast(kind).to_pylist():
            yield value or b""


def text_parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about ``size`` bytes of the texts in ``column``; a longer text is a part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def large_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in batches of at least ``rows`` but for the last; for narrow rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def blank_words(data: bytes) -> list[bytes]:
    """Lower-cased runs without ASCII white space: ``[^\\x20\\x09-\\x0D]+``."""
    return data.lower().split()


# 1 for ASCII white space, 0 for all other bytes.
BLANK = bytes(b in b" \t\n\v\f\r" for b in range(256))


def placed_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of :func:`blank_words` of all texts as places in one run of bytes: the bytes (8 blank ones stand at the end), first and end
    of every word, and which word each text begins with, the end included."""
    values = list(utf8_values(texts))
    data = b"\n".join([b"", *values, b"\n" * 8]).lower()
    blank = np.frombuffer(data.translate(BLANK), np.uint8)
    turns = np.nonzero(blank[1:] != blank[:-1])[0] + 1
    begins = np.cumsum([1, *(len(v) + 1 for v in values)])
    return data, turns[::2], turns[1::2], np.searchsorted(turns[::2], begins)


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return data.translate(ALNUM).split()


# The words of the two functions above, as patterns over UTF-8.
BLANK_WORD = rb"[^\x20\x09-\x0d]+"
ALNUM_WORD = rb"[0-9A-Za-z\x80-\xff]+"


def without_spans(data: bytes, spans: list[tuple[int, int]], pattern: re.Pattern) -> bytes:
    """``data`` without the words from first to last of each span; spans ascend and do not meet."""
    places = [m.span() for m in pattern.finditer(data)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, data[at:]])


def cut_spans(df: DataFrame, text_column: str, spans_column: str, word: bytes) -> DataFrame:
    """``df`` less ``spans_column`` (array of first, last), its texts less the words in them; ``n_chars`` counted anew."""
    rest = [c for c in df.columns if c != spans_column]
    at = rest.index(text_column)
    rows = df.select(*rest, F.col(spans_column).cast("array<struct<first:long,last:long>>"))
    rows = rows.toDF(*[f"c{i}" for i in range(len(rest))], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(word)
        parts = (batch.slice(i, ROWS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, ROWS_AT_ONCE))
        for batch in parts:
            texts, spans = batch.column(at), batch.column(len(rest)).to_pylist()
            if any(spans):
                values = texts.cast(pa.binary()).to_pylist()
                for i, row in enumerate(spans):
                    if row and values[i] is not None:
                        values[i] = without_spans(values[i], [(s["first"], s["last"]) for s in row], pattern)
                texts = pa.array(values, pa.binary()).cast(pa.string())
            columns = [texts if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    cut = rows.mapInArrow(run, rows.schema)
    if "n_chars" in rest:
        name = f"c{rest.index('n_chars')}"
        length = F.length(f"c{at}").cast(rows.schema[name].dataType)
        cut = cut.withColumn(name, F.when(F.size("spans") > 0, length).otherwise(F.col(name)))
    return cut.drop("spans").toDF(*rest)
