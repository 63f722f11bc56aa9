"""Embedders: a mock, and remote ones behind a function that does the talking.

``fetch(url, headers, body) -> (status, body)`` is given by the caller; there
is no network code here.  Embedders are used a batch at a time in Arrow
batches of an executor.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import mock_embedding

Fetch = Callable[[str, dict[str, str], bytes], tuple[int, bytes]]

# Dimensions of the models that the gateway serves, and its caps.
MODEL_DIMS = {"bge-small-en-v1.5": 384, "bge-base-en-v1.5": 768, "bge-large-en-v1.5": 1024}
MOST_CHARS, MOST_TEXTS = 8_000, 100


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class MockEmbedder:
    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [mock_embedding(t, self.dim).tolist() for t in texts]


class _Remote:
    def __init__(self, fetch: Fetch, url: str, token: str, model: str):
        self.fetch, self.url, self.token, self.model = fetch, url, token, model

    def _post(self, url: str, body: dict):
        status, answer = self.fetch(url, {"authorization": f"Bearer {self.token}", "content-type": "application/json"}, json.dumps(body).encode())
        if status != 200:
            raise OSError(f"the embedder answered {status}")
        return json.loads(answer)


class GatewayEmbedder(_Remote):
    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), MOST_TEXTS):
            out += self._post(f"{self.url}/embed", {"texts": texts[at : at + MOST_TEXTS], "model": self.model})["embeddings"]
        return out


class OpenAiStyleEmbedder(_Remote):
    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        rows = self._post(f"{self.url}/embeddings", {"input": texts, "model": self.model})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]


class FeatureExtractionEmbedder(_Remote):
    """One text a call; the answer is a vector, or a list whose first row is one."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [flattened(self._post(f"{self.url}/{self.model}", {"inputs": t})) for t in texts]


def flattened(answer) -> list[float]:
    while isinstance(answer, list) and answer and isinstance(answer[0], list):
        answer = answer[0]
    if not isinstance(answer, list) or not answer or not all(isinstance(x, (int, float)) for x in answer):
        raise ValueError("not a vector")
    return [float(x) for x in answer]


def build(config: dict, fetch: Fetch | None = None) -> Embedder:
    """By ``backend``: mock, gateway, openai or feature_extraction."""
    kind = config.get("backend", "mock")
    if kind == "mock":
        return MockEmbedder(int(config.get("dim", 384)))
    kinds = {"gateway": GatewayEmbedder, "openai": OpenAiStyleEmbedder, "feature_extraction": FeatureExtractionEmbedder}
    if kind not in kinds or fetch is None:
        raise ValueError(f"no embedder {kind!r}")
    return kinds[kind](fetch, config["url"].rstrip("/"), config.get("token", ""), config.get("model", ""))


def embed(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.dropna()
        made = pd.Series(embedder.embed_batch(some.tolist()), index=some.index, dtype=object) if len(some) else pd.Series(dtype=object)
        return made.reindex(texts.index).where(texts.notna(), None)

    return run(text)


def ingest_text(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """``namespace, record_id, text`` to index rows; see ``vectors.index_rows`` for what is refused."""
    return rows.select("namespace", "record_id", embed(F.col("text"), embedder).alias("embedding"))


def request_error(text: Column, texts: Column, model: Column) -> Column:
    """Why an embedding request is refused, or null: one of text and texts, sizes, model."""
    every = F.coalesce(texts, F.array(text))
    return (
        F.when(text.isNull() == texts.isNull(), "text or texts").when(F.size(every) == 0, "no texts").when(F.size(every) > MOST_TEXTS, "too many texts")
        .when(F.exists(every, lambda t: t.isNull() | (F.trim(t) == "")), "empty text").when(F.exists(every, lambda t: F.char_length(t) > MOST_CHARS), "text too long").when(~F.coalesce(model, F.lit("bge-small-en-v1.5")).isin(list(MODEL_DIMS)), "unknown model")
    )
