"""Splitters that need a text as a whole: by separators of falling rank, and by tokens.

Both run over Arrow batches, one text at a time, and give rows (id, index, text).
Null and blank texts give no row. Repeated ids are split each on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators by rank; the empty one cuts between any two characters.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def _starts(text: str, low: int, high: int, separator: str) -> list[int]:
    """Where the pieces of a span begin: at its start and at each separator."""
    if not separator:
        return list(range(low, high))
    out = [low]
    at = text.find(separator, low, high)
    while at >= 0:
        if at > low:
            out.append(at)
        at = text.find(separator, at + len(separator), high)
    return out


def _packed(bounds: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of adjoining pieces of at most ``size``; each begins again within ``overlap`` of the last one's end."""
    first = 0
    for i, (low, high) in enumerate(bounds):
        if high - bounds[first][0] > size and first < i:
            yield bounds[first][0], low
            while first < i and (low - bounds[first][0] > overlap or high - bounds[first][0] > size):
                first += 1
    if bounds:
        yield bounds[first][0], bounds[-1][1]


def spans(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS, low: int = 0, high: int | None = None, rank: int = 0) -> Iterator[tuple[int, int]]:
    """Spans in order. Pieces too long for a span are cut by the separators of lower rank."""
    high = len(text) if high is None else high
    last = len(separators) - 1
    if low == high:
        return
    while rank < last and text.find(separators[rank], low, high) < 0:
        rank += 1
    starts = _starts(text, low, high, separators[rank])
    short: list[tuple[int, int]] = []
    for a, b in zip(starts, [*starts[1:], high], strict=True):
        if b - a < size:
            short.append((a, b))
            continue
        yield from _packed(short, size, overlap)
        short = []
        if rank == last:
            yield a, b
        else:
            yield from spans(text, size, overlap, separators, a, b, rank + 1)
    yield from _packed(short, size, overlap)


def _rows(table: DataFrame, key: str, text: str, cut: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = cut()
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                parts = [p.strip() for p in split((t.as_py() or "").strip())]
                parts = [p for p in parts if p]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(parts), batch.schema.field(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["id", "index", "text"])

    return table.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, index int, text string")


def by_separators(table: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Chunks that end at paragraphs, lines, sentences or words where they can."""
    overlap = max(0, min(overlap, size - 1))
    if size <= 0:
        return _rows(table, key, text, lambda: lambda t: [t])
    return _rows(table, key, text, lambda: lambda t: [t[a:b] for a, b in spans(t, size, overlap, separators)])


def by_tokens(table: DataFrame, key: str, text: str, vocabulary: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` tokens of the vocabulary file, decoded; RuntimeError without the library."""
    try:
        import tokenizers  # noqa: F401
    except ImportError as e:
        raise RuntimeError("splitting by tokens needs the tokenizers library") from e
    overlap = max(0, min(overlap, size - 1))

    def cut() -> Callable[[str], list[str]]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary)
        model.no_truncation()
        model.no_padding()

        def split(t: str) -> list[str]:
            ids = model.encode(t, add_special_tokens=False).ids
            last = max(1, len(ids) - overlap)
            return [model.decode(ids[i : i + size], skip_special_tokens=False) for i in range(0, last, size - overlap)] if ids else []

        return split

    return _rows(table, key, text, cut)
