"""Re-ranking of candidates by a model that reads question and text together. A model is any object with score(pairs)."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators.fusion import rescaled


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """A number for each pair of question and text, higher for a better match."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector of the same size for each text."""


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]:
        """An answer for each prompt."""


class Streamer(Protocol):
    def stream(self, prompt: str) -> Iterator[str]:
        """The tokens of the answer to a prompt, as they come."""


class HttpReranker:
    """A service that takes {query, chunks: [{id, text}]} and gives the chunks back with rerank_score, in any order."""

    def __init__(self, url: str, timeout_s: float = 0.5) -> None:
        self.url, self.timeout_s = url, timeout_s

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = [0.0] * len(pairs)
        for question in dict.fromkeys(q for q, _ in pairs):
            mine = [k for k, (q, _) in enumerate(pairs) if q == question]
            body = json.dumps({"query": question, "chunks": [{"id": str(k), "text": pairs[k][1]} for k in mine]}).encode()
            with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout_s) as r:
                for c in json.load(r):
                    out[int(c["id"])] = float(c["rerank_score"])
        return out


class HttpEmbedder:
    """A service that takes {model, input: [texts]} and gives {embeddings: [vectors]}."""

    def __init__(self, url: str, model: str, timeout_s: float = 120) -> None:
        self.url, self.model, self.timeout_s = url, model, timeout_s

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout_s) as r:
            got = json.load(r).get("embeddings") or []
        if len(got) != len(texts):
            raise ValueError("the model gave no vectors")
        return got


class HttpGenerator:
    """A service that takes {model, prompt, stream, options} and gives {response}, or as a stream a line {response, done} for each token."""

    def __init__(self, url: str, model: str, timeout_s: float = 120, options: dict | None = None) -> None:
        self.url, self.model, self.timeout_s, self.options = url, model, timeout_s, options

    def _ask(self, prompt: str, stream: bool):  # noqa: ANN202
        body = {"model": self.model, "prompt": prompt, "stream": stream} | ({"options": self.options} if self.options else {})
        return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout_s)

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            with self._ask(prompt, False) as r:
                out.append(json.load(r)["response"])
        return out

    def stream(self, prompt: str) -> Iterator[str]:
        """Tokens as they come. Empty ones are left out; a line that can't be read ends the stream."""
        with self._ask(prompt, True) as r:
            for line in r:
                if not line.strip():
                    continue
                try:
                    got = json.loads(line)
                except ValueError:
                    return
                if got.get("response"):
                    yield got["response"]
                if got.get("done"):
                    return


class HashedEmbedder:
    """Stand-in without a model: words hashed into a vector of the given size. For tests and offline runs."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dims] += 1.0 if h & 0x8000_0000 else -1.0
            out.append(v)
        return out


def embedded(df: DataFrame, text: str, out: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """df with a vector column; null texts get null. A batch that fails is left null, like a chunk without a vector."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = [None] * len(frame)
            rows = [k for k, x in enumerate(frame[text]) if x is not None]
            for s in range(0, len(rows), batch):
                part = rows[s : s + batch]
                try:
                    for k, v in zip(part, embedder.embed([frame[text].iloc[k] for k in part])):
                        vectors[k] = v
                except (OSError, ValueError):
                    continue
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))]))


def lexical_score(question, body):  # noqa: ANN001, ANN201
    """Stand-in score as a column: share of the question's tokens in the text, from -2 to 2."""
    asked = F.array_distinct(T.tokens(question))
    shared = F.size(F.array_intersect(asked, T.tokens(body)))
    return F.round(F.when(F.size(asked) > 0, 4 * shared / F.size(asked)).otherwise(0.0) - 2, 6)


def reranked(candidates: DataFrame, reranker: Reranker | None) -> DataFrame:
    """Candidates (query_id, q, id, text, score, ...) with score replaced by the re-ranker's, rescaled. Without one, or for questions where it fails, unchanged."""
    if reranker is None:
        return candidates
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            scores = reranker.score([(q, t or "") for q, t in zip(frame["q"], frame["text"])])
        except (OSError, ValueError, KeyError):
            scores = [None] * len(frame)
        return frame.assign(rerank_score=pd.Series(scores, index=frame.index, dtype="float64"))

    schema = StructType([*candidates.schema.fields, StructField("rerank_score", DoubleType())])
    got = candidates.groupBy("query_id").applyInPandas(run, schema)
    new = rescaled(got.withColumn("__old", F.col("score")))
    return new.withColumn("score", F.when(F.col("rerank_score").isNull(), F.col("__old")).otherwise(F.col("score"))).drop("__old", "rerank_score")


def generated(prompts: DataFrame, generator: Generator, batch: int = 8) -> DataFrame:
    """prompts (query_id, prompt) with answer and error: a batch that fails has its reason there and null answers. Null prompts have neither."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list = [None] * len(frame)
            errors: list = [None] * len(frame)
            rows = [k for k, p in enumerate(frame["prompt"]) if p is not None]
            for s in range(0, len(rows), batch):
                part = rows[s : s + batch]
                try:
                    for k, a in zip(part, generator.generate([frame["prompt"].iloc[k] for k in part])):
                        answers[k] = a
                except (OSError, ValueError, KeyError) as e:
                    for k in part:
                        errors[k] = str(e)
            yield frame.assign(answer=answers, error=errors)

    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def streamed(prompts: DataFrame, generator: Streamer) -> DataFrame:
    """query_id, seq, type, text of prompts (query_id, prompt): an event for each token, one for an error, and [DONE]. Null prompts have no events.

    Events are passed on as they come, a batch at a time, so that a stream of questions can be answered by a stream of events.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, prompt in zip(frame["query_id"], frame["prompt"]):
                if prompt is None:
                    continue
                held: list[tuple[str, str | None]] = []
                n = 0
                try:
                    for token in generator.stream(prompt):
                        held.append(("token", token))
                        if len(held) == 100:
                            yield pd.DataFrame([(name, n + k, *e) for k, e in enumerate(held)], columns=["query_id", "seq", "type", "text"])
                            held, n = [], n + 100
                except (OSError, ValueError, KeyError) as e:
                    held.append(("error", str(e)))
                yield pd.DataFrame([(name, n + k, *e) for k, e in enumerate([*held, ("[DONE]", None)])], columns=["query_id", "seq", "type", "text"])

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, seq int, type string, text string")
