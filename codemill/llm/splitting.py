"""Problem 2: texts over a size limit, cut into pieces at natural boundaries.

Method: recursive bisection. A text is cut at the strongest boundary near its midpoint, and each half that still exceeds the
limit minus the overlap is cut again; then every piece but the first gets the last characters of its predecessor in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 200
#: Boundaries by falling strength; a cut stands before the match's end. Within a class the one next to the midpoint is taken.
BOUNDARIES = [
    re.compile(r"\n\s*\n(?=\S)"),  # blank line before text without indent
    re.compile(r"\n(?=[^\s)}\]])"),  # line without indent
    re.compile(r"\n[ \t]*\n"),  # blank line
    re.compile(r"\n"),  # line
    re.compile(r"[;,{}]\s*"),  # statement or element
    re.compile(r"\s+"),  # word
]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Positions where the text is cut, rising; none if it is within the limit. Parts are at most limit - overlap long."""
    if len(text) <= limit:
        return []
    most, found, todo = limit - overlap, [], [(0, len(text))]
    marks = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        middle = (lo + hi) // 2
        reach = (hi - lo) // 4
        cut = middle
        for ends in marks:
            near = _nearest(ends, middle)
            if near is not None and abs(near - middle) <= reach and lo < near < hi:
                cut = near
                break
        found.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(found)


def _nearest(ends: list[int], at: int) -> int | None:
    from bisect import bisect_left

    i = bisect_left(ends, at)
    return min(ends[max(0, i - 1) : i + 1], key=lambda e: (abs(e - at), e), default=None)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces, each at most limit long; each but the first starts overlap characters before the last one's
    end."""
    bounds = [0, *cuts(text, limit, overlap), len(text)]
    return [(max(0, lo - overlap) if lo else 0, hi) for lo, hi in zip(bounds, bounds[1:])]


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rec, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                line, at = first if first is not None else 1, 0
                for n, (lo, hi) in enumerate(pieces(text, limit, overlap)):
                    line += text.count("\n", at, lo)  # lo never falls
                    at = lo
                    # a piece that ends with a newline ends on the line before it
                    rows.append((rec, n, lo, hi, line, line + text.count("\n", lo, hi - 1), text[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _TYPES)], names=_NAMES)

    return run


_NAMES = ["rec_id", "piece_no", "start", "end", "startLine", "endLine", "piece"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """rec_id, piece_no, start, end, startLine, endLine, piece of every chunk whose content has more than limit characters
    (code points). Pieces are at most limit long; put together without their overlaps they give the content again.

    Null and short contents have no rows; a null startLine counts as 1; repeated rows of a rec_id count once."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    over = chunks.where(F.length("content") > limit).select(F.col("rec_id").cast("long").alias("rec_id"), "content", F.col("startLine").cast("int").alias("startLine"))
    schema = "rec_id long, piece_no int, start int, end int, startLine int, endLine int, piece string"
    return over.dropDuplicates(["rec_id"]).mapInArrow(_split(limit, overlap), schema)


def oversized(chunks: DataFrame) -> DataFrame:
    """rec_id of the chunks that were cut."""
    return split_oversized(chunks).where("piece_no = 1").select("rec_id")
