"""Splitting oversized items at natural boundaries (problem 3).

Pointer doubling: every boundary of a text points to its farthest legal successor, overlap included; squaring that successor table
(S, S after S, ...) marks all cuts of the greedy walk in a number of steps that grows with the logarithm of the pieces. A text is one
row, so its table lives in the task that read it; tables of all texts in an Arrow batch are squared together and nothing is shuffled.

Defined results: null texts and those within the limit (without white space at both ends) give no rows, so an empty input gives an empty
output; the kind of file is read from the name's plain form (problem 6), and an unknown or null file name is split as plain text; repeated rows are split each time they occur; a stretch without any boundary
is cut at the limit, though never before a combining mark, a joiner or a variation selector, as long as it has other places.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.lookalikes import Rewriter

#: What counts as white space at the ends of an item.
ENDS = " \t\r\n"
#: Levels of boundaries, best first: end of text, block, line, sentence or statement, word, any place.
END, BLOCK, LINE, SENTENCE, WORD, ANY = range(6)
SCHEMA = "id string, piece_no int, pieces int, start long, end long, overlap int, piece string"
#: Texts cut together hold about so many code points: a table has a few dozen bytes for each.
TOGETHER = 4_000_000


@lru_cache(1)
def _extends() -> np.ndarray:
    """For each code point of the first two planes, whether it extends the sign before it."""
    return np.array([bool(ud.combining(chr(c))) or c in (0x200C, 0x200D) or 0xFE00 <= c <= 0xFE0F or 0x1F3FB <= c <= 0x1F3FF for c in range(0x20000)])


def boundaries(codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a text of this kind may be cut and the level of each, in order of place; 0 and the end aren't among them."""
    n = len(codes)
    level = np.full(n + 1, ANY, np.int8)
    new, space = codes == 10, (codes == 32) | (codes == 9) | (codes == 160) | (codes == 0x202F)
    white = new | space | (codes == 13) | (codes == 12)
    after = np.flatnonzero(white[:-1] & ~white[1:]) + 1  # a word starts here
    level[after] = WORD
    ends = np.isin(codes, (59, 123, 125) if kind == "c" else (46, 33, 63, 0x2026))  # ; { } or . ! ? …
    closed = ends.copy()
    closers = np.isin(codes, (34, 39, 41, 93, 187, 0x2019, 0x201D))
    closed[1:] |= closers[1:] & ends[:-1]
    before = np.maximum.accumulate(np.where(~white, np.arange(n, dtype=np.int32), np.int32(-1))) if n else np.zeros(0, np.int32)  # the last sign before white space
    last = before[after - 1]
    level[after[(last >= 0) & closed[last]]] = SENTENCE
    lines = np.flatnonzero(new) + 1
    lines = lines[lines < n]
    level[lines] = LINE
    if len(lines):
        starts = np.concatenate(([0], lines))
        stops = np.concatenate((lines, [n]))
        filled = np.concatenate(([0], np.cumsum(~white, dtype=np.int32)))
        blank = filled[stops] == filled[starts]
        head = codes[starts]
        if kind == "log":
            block = ~blank
        elif kind == "c":
            block = np.concatenate(([False], blank[:-1])) | np.concatenate(([False], codes[starts[:-1]] == 125))
        else:
            block = np.concatenate(([False], blank[:-1])) | (codes[np.maximum(starts - 1, 0)] == 12)
        block &= ~blank
        if kind == "md":
            fence = np.isin(head, (96, 126)) & (starts + 2 < n)
            k = starts[fence]
            fence[fence] = (codes[k + 1] == head[fence]) & (codes[k + 2] == head[fence])
            inside = np.cumsum(fence) % 2 == 1  # the opening line and those to the closing one, which is outside again
            held = np.concatenate(([False], inside[:-1]))
            block = (block | (head == 35) | (fence & inside)) & ~held
            level[starts[held & (starts > 0)]] = SENTENCE
        level[starts[block & (starts > 0)]] = BLOCK
    at = np.flatnonzero(level[:n] < ANY)
    at = at[at > 0]
    return at, level[at]


def _cuts(texts: list[str], kinds: list[str], limit: int, overlap: int, fill: float) -> Iterator[tuple[int, int, int, int, int]]:
    """text number, piece number, start of the new part, end, overlap before the start; for all texts at once."""
    step = limit - overlap
    places, levels, owners, offset = [], [], [], 0
    for k, (text, kind) in enumerate(zip(texts, kinds)):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at, level = boundaries(codes, kind)
        n = len(codes)
        grid = np.concatenate(([0], at, [n]))
        wide = np.flatnonzero(np.diff(grid) > step)
        if len(wide):  # long stretches without a boundary get some at the step's distance
            extends = _extends()
            more = []
            for g in wide:
                x, stop = int(grid[g]), int(grid[g + 1])
                while stop - x > step:
                    y = x + step
                    while y > x + 1 and codes[y] < len(extends) and extends[codes[y]]:
                        y -= 1
                    x = y if y > x + 1 else x + step
                    more.append(x)
            at = np.concatenate((at, more)).astype(np.int64)
            level = np.concatenate((level, np.full(len(more), ANY, np.int8)))
            order = np.argsort(at, kind="stable")
            at, level = at[order], level[order]
        places.append(np.concatenate(([0], at, [n])) + offset)
        levels.append(np.concatenate(([END], level, [END])).astype(np.int8))
        owners.append(np.full(len(at) + 2, k))
        offset += n + limit + 1  # no window reaches the next text
    p, lv, owner = map(np.concatenate, (places, levels, owners))
    last = np.concatenate((np.flatnonzero(np.diff(owner)), [len(p) - 1]))
    first = np.concatenate(([0], last[:-1] + 1))
    words = p[lv < ANY]
    begin = words[np.minimum(np.searchsorted(words, p - overlap), len(words) - 1)]  # the overlap starts at a word
    carried = np.where((begin >= p - overlap) & (begin <= p), p - begin, 0)
    carried[first] = 0
    reach = p + limit - carried
    succ = np.searchsorted(p, reach, "right") - 1  # the farthest boundary of any level
    open_ = np.ones(len(p), bool)
    for most in (END, BLOCK, LINE, SENTENCE, WORD):
        mine = np.flatnonzero(lv <= most)
        k = mine[np.searchsorted(p[mine], reach, "right") - 1]
        good = open_ & (p[k] > p + (0 if most == END else fill * (limit - carried)))
        succ[good] = k[good]
        open_ &= ~good
    succ[last] = last
    mark = np.zeros(len(p), bool)
    mark[first] = True
    while True:  # mark holds the first 2^k cuts of each text, succ goes 2^k cuts on
        to = succ[mark]
        if mark[to].all():
            break
        mark[to] = True
        succ = succ[succ]
    cut = np.flatnonzero(mark)
    base = p[first][owner[cut]]
    number = np.arange(len(cut)) - np.searchsorted(owner[cut], owner[cut])
    for a, b in zip(range(len(cut) - 1), range(1, len(cut))):
        if owner[cut[a]] == owner[cut[b]]:
            yield int(owner[cut[a]]), int(number[a]), int(p[cut[a]] - base[a]), int(p[cut[b]] - base[b]), int(carried[cut[a]])


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", name_col: str = "filename", limit: int = 1500, overlap: int = 150, fill: float = 0.5) -> DataFrame:
    """Pieces of the texts that have more than limit code points without white space at both ends.

    id, piece_no (from 0), pieces, start and end (code points of the stored text that are new in the piece), overlap (code points carried over
    before start), piece. A piece has at most limit code points, its overlap among them. A cut falls on the best level of boundary that leaves
    the piece filled to at least the share `fill`: block (paragraph, heading, function, log record, as the file's kind has it), then line,
    sentence or statement, word, any place. Joining all pieces without their overlaps gives the stripped text again.
    """
    if not 0 <= overlap < limit or limit < 2:
        raise ValueError("0 <= overlap < limit")

    plain = Rewriter({})

    def kind(name: str | None) -> str:
        found = re.search(r"\.([A-Za-z0-9]+)$", plain(name) or "")
        return found[1].lower() if found else "txt"

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
            texts = [t.strip(ENDS) for _, t, _ in rows]
            lead = [len(t) - len(t.lstrip(ENDS)) for _, t, _ in rows]
            cuts = list(_cuts(texts, [kind(n) for *_, n in rows], limit, overlap, fill))
            total = np.bincount([c[0] for c in cuts], minlength=len(rows))
            made = [(rows[k][0], n, int(total[k]), a + lead[k], b + lead[k], o, texts[k][a - o : b]) for k, n, a, b, o in cuts]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], t) for j, t in enumerate(types)], ["id", "piece_no", "pieces", "start", "end", "overlap", "piece"])

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[1])
                if held > TOGETHER:
                    yield pieces(rows)
                    rows, held = [], 0
        if rows:
            yield pieces(rows)

    long = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"), F.col(name_col).alias("k")).where(F.char_length(F.btrim("t", F.lit(ENDS))) > limit)
    return long.mapInArrow(split, SCHEMA)
