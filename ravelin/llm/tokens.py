"""Sizes in tokens of a public tokenizer. Its vocabulary file is a parameter, read on the driver and broadcast: under 2 MB."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank file of a byte-level tokenizer for many languages; RAVELIN_TOKENIZER names another.
DEFAULT = os.environ.get("RAVELIN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that belongs to such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A longer text is encoded in parts of about this many code points, cut between a sign and white space where the pattern splits anyway.
PART = 200_000
MAX_FILE = 8 << 20


def ranks(spark: SparkSession, path: str = DEFAULT) -> Broadcast:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(data)


@lru_cache(2)
def encoding(data: bytes):  # noqa: ANN201
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """The text in parts whose tokens together are the tokens of the whole: a part ends before a white space that follows another sign."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def count(data: bytes, text: str | None) -> int | None:
    if text is None:
        return None
    e = encoding(data)
    try:
        return sum(len(e.encode_ordinary(p)) for p in parts(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(e.encode_ordinary(text.encode("utf-8", "replace").decode()))


def token_count(spark: SparkSession, text: str | Column, path: str = DEFAULT) -> Column:
    """BIGINT column of a text's tokens: null for null, 0 for the empty text."""
    held = ranks(spark, path)

    @F.arrow_udf("long")
    def n(texts: pa.Array) -> pa.Array:
        return pa.array([count(held.value, x) for x in texts.to_pylist()], pa.int64())

    return n(F.col(text) if isinstance(text, str) else text)


def sized(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str = DEFAULT) -> DataFrame:
    """id, piece, pieces, tokens, char_start, char_end: each text as one piece, or as several of at most `capacity` tokens if it's larger.

    Pieces end between two tokens that don't share a character, so that each is itself a text. Null and empty texts give no piece.
    """
    held = ranks(df.sparkSession, path)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = count(held.value, text)
                if n <= capacity:
                    out.append((i, 0, 1, n, 0, len(text)))
                else:
                    cut = list(_cut(held.value, text, capacity))
                    out += ((i, k, len(cut), *c) for k, c in enumerate(cut))
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["id", "piece", "pieces", "tokens", "char_start", "char_end"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"id {kind}, piece int, pieces int, tokens long, char_start long, char_end long")


def _cut(data: bytes, text: str, capacity: int) -> Iterator[tuple[int, int, int]]:
    """tokens, start and end of consecutive pieces that are as full as the characters allow."""
    e = encoding(data)
    start = at = used = 0
    for part in parts(text.encode("utf-8", "replace").decode()):
        waiting = b""
        held = 0
        for token in e.encode_ordinary(part):
            waiting += e.decode_single_token_bytes(token)
            held += 1
            try:
                more = len(waiting.decode())
            except UnicodeDecodeError:
                continue
            if used + held > capacity and used:
                yield used, start, at
                start, used = at, 0
            used, at = used + held, at + more
            waiting, held = b"", 0
    if used:
        yield used, start, at
