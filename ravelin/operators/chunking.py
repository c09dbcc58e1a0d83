"""Splitting texts into section-aware, overlapping chunks.

Where a chunk ends depends on where the one before ended, so this is a walk through each text, run on Arrow batches; texts are independent,
and nothing is shuffled. Lengths are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T

#: Chunks shorter than this are dropped, and a shorter buffer is never closed early.
LEAST = 150
#: An overlap shorter than this isn't worth carrying over.
LEAST_OVERLAP = 20
#: Texts of fewer bytes give no chunk.
LEAST_BYTES = 50
LINE_SPACE = re.compile(r"[^\S\n]+")
NUMBERED = re.compile(r"[0-9.]*\s*(.)")
SENTENCE = re.compile(r"[.!?](?=.)", re.S)


def normalised(text: str) -> str:
    return "\n".join(" ".join(line.split()) for line in re.sub(r"\r\n?", "\n", text).split("\n"))


def opens_section(paragraph: str) -> bool:
    """As functions.text.is_section, for one paragraph."""
    if paragraph.startswith(("#", "==", "--")):
        return True
    line = paragraph.strip().split("\n", 1)[0]
    if not line or len(line) >= 80:
        return False
    title = NUMBERED.match(line) if line[0].isdigit() else None
    return bool(title and title[1].isupper()) or (len(line) > 5 and " " in line and line == line.upper())


def carried_over(text: str, n: int) -> str:
    """As functions.text.tail_sentence, for one text."""
    if len(text) <= n:
        return text
    ends = [m.end() for m in SENTENCE.finditer(text[len(text) - n :])] if n else []
    return text[len(text) - n + ends[-1] :].strip() if ends else ""


class _Packer:
    """Collects paragraphs and closes chunks."""

    def __init__(self, size: int, overlap: int, prefix: str) -> None:
        self.size, self.overlap, self.prefix = size, overlap, f"{prefix}\n" if prefix else ""
        self.done: list[str] = []
        self.held = ""

    def close(self, carry: bool) -> None:
        """A buffer that's too short is lost; what's carried over comes from the last chunk there is."""
        body, self.held = self.held.strip(), ""
        if len(body) >= LEAST:
            self.done.append(self.prefix + body)
        if carry and self.done and len(tail := carried_over(self.done[-1], self.overlap)) >= LEAST_OVERLAP:
            self.held = f"{tail}\n\n"

    def lines(self, paragraph: str) -> None:
        """A paragraph over the size, by lines. A line over the size stays whole."""
        for line in filter(None, map(str.strip, paragraph.split("\n"))):
            if len(self.held) >= LEAST and len(self.held) + len(line) > self.size:
                self.close(carry=True)
            self.held += f"{line}\n"


def semantic_chunks(text: str, size: int = 1500, overlap: int = 150, prefix: str = "") -> list[str]:
    """The chunks of one text. A section or a full buffer closes a chunk, code between fences is never cut, the end of a chunk is repeated in the next.

    The length that a paragraph is judged by is the buffer's when the paragraph comes: closing for a section doesn't reset it.
    """
    packer, in_code = _Packer(size, overlap, prefix), False
    for paragraph in filter(None, map(str.strip, normalised(text).split("\n\n"))):
        fence = paragraph.startswith(("```", "~~~"))
        in_code ^= fence
        if not (fence or in_code):
            length = len(packer.held)
            ready = length >= LEAST
            if ready and opens_section(paragraph):
                packer.close(carry=False)
            long = len(paragraph) > size
            if ready and (long or length + len(paragraph) > size):
                packer.close(carry=True)
            if long:
                packer.lines(paragraph)
                continue
        packer.held += f"{paragraph}\n\n"
    packer.close(carry=False)
    return packer.done


def chunked(df: DataFrame, path: str, text: str, size: int = 1500, overlap: int = 150, prefix: Column | None = None) -> DataFrame:
    """path, chunk_ord, text, chunks per text. Null texts and those under 50 bytes give none; a null path is kept. prefix defaults to the path's domain."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, c) for p, t, x in zip(*(c.to_pylist() for c in batch.columns)) for k, c in enumerate(semantic_chunks(t, size, overlap, x or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "chunk_ord", "text"])

    where = F.col(path).cast("string")
    rows = df.select(where.alias("p"), F.btrim(F.col(text), F.lit(T.WHITE)).alias("t"), (T.domain(where) if prefix is None else prefix).alias("x"))
    return rows.where(F.octet_length("t") >= LEAST_BYTES).mapInArrow(split, "path string, chunk_ord int, text string")


class ChunkText:
    """Table function: SELECT * FROM docs, LATERAL chunk_text(text, size, overlap, prefix)."""

    def eval(self, text, size, overlap, prefix):  # noqa: ANN001, ANN201
        for k, c in enumerate(semantic_chunks(text, size, overlap, prefix or "") if text else ()):
            yield k, c


def register(spark) -> None:  # noqa: ANN001
    """Makes chunk_text known to SQL."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_ord int, chunk string"))
