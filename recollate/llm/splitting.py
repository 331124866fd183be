"""Cutting oversized texts into pieces under a limit, with a fixed overlap.

Balanced targets: the least number of pieces gives equal-length targets, each end snaps to the strongest
boundary near its target (heading, paragraph, line, sentence, word; the nearest among equals), and one more piece
is tried whenever a limit fails. Without any boundary the cut is at the target itself.

Each piece is text[start:end] in characters; piece i + 1 starts exactly ``overlap`` characters before the end of
piece i, the pieces cover the whole text, and none is longer than ``limit``. Texts within the limit, null and
empty ones give one piece or none as ``split_long`` says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Strongest first; a cut lies at the end of a match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"(?:\r?\n|\r)(?=#{1,6} )",  # before a heading
        r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)+(?!#)",  # after a blank line
        r"(?:\r?\n|\r)(?![\r\n])",  # after a line
        r"[.!?…][\"'»”’)\]]*\s+|[。！？；][”’」』）]*",  # after a sentence
        r"\s+",  # after a word
    )
)


def _snap(text: str, low: int, high: int, target: int) -> int:
    """The strongest boundary in [low, high] nearest to target, else the target."""
    base = max(0, low - 4)
    window = text[base : high + 4]
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(window):
            at = base + m.end()
            if low <= at <= high and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best
    return target


def piece_bounds(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[(start, end)] of the pieces of a text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    size, gain = len(text), limit - overlap
    if size <= limit:
        return [(0, size)] if size else []
    count = -(-(size - overlap) // gain)
    while True:
        bounds, start = [], 0
        step = (size - overlap) / count
        reach = max(1, int(step * 0.3))
        for i in range(1, count):
            target = round(overlap + step * i)
            low = max(target - reach, size - (count - i) * gain, start + overlap + 1)
            high = min(target + reach, start + limit)
            if low > high:
                break
            end = _snap(text, low, high, min(max(target, low), high))
            bounds.append((start, end))
            start = end - overlap
        else:
            if size - start <= limit:
                return [*bounds, (start, size)]
        count += 1


def split_long(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """keys, piece_no, n_pieces, start_pos, end_pos (and piece) of each text longer than ``limit`` characters.

    Shorter and null texts never leave the JVM and give no row. Other columns of df are ignored; repeated rows give repeated pieces.
    """
    schema = df.select(*keys).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", piece_no int, n_pieces int, start_pos int, end_pos int" + (", piece string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            row, cells, pieces = [], [], []
            for r, t in enumerate(texts):
                bounds = piece_bounds(t, limit, overlap)
                for no, (a, b) in enumerate(bounds):
                    row.append(r)
                    cells.append((no, len(bounds), a, b))
                    if with_text:
                        pieces.append(t[a:b])
            take = pa.array(row, pa.int32())
            arrays = [batch.column(k).take(take) for k in keys] + [pa.array([c[j] for c in cells], pa.int32()) for j in range(4)]
            names = [*keys, "piece_no", "n_pieces", "start_pos", "end_pos"]
            if with_text:
                arrays, names = [*arrays, pa.array(pieces, pa.string())], [*names, "piece"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    long = df.filter(F.length(F.col(text)) > limit).select(*keys, F.col(text).alias("__text"))
    return long.mapInArrow(cut, out)
