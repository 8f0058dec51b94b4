"""Language-model and embedding connectors: an HTTP one, and a deterministic one that needs no network."""

from __future__ import annotations

import json
import math
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.vectors import hash_embedding


class Model(Protocol):
    def chat(self, messages: list[dict]) -> str: ...

    def chat_json(self, messages: list[dict]) -> dict: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ModelError(RuntimeError):
    """A reply that can't be had or used."""


class EmptyReply(ModelError):
    """The model completed with nothing."""


def strip_fence(text: str) -> str:
    """The inside of a code fence, if the text is one."""
    text = text.strip()
    if not text.startswith("```"):
        return text
    body = text.partition("\n")[2]
    return body.rsplit("```", 1)[0].strip()


def backoff(attempt: int) -> float:
    """Seconds before the attempt-th retry: half a second, doubled each time, 30 at most."""
    return min(30.0, 0.5 * 2 ** (attempt - 1))


def normalised(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@dataclass
class HttpModel:
    """An endpoint with /chat/completions and /embeddings. Transport errors, 429 and 5xx are tried again, other 4xx are final."""

    base_url: str
    model: str
    embed_model: str = ""
    api_key: str = ""
    retries: int = 3
    concurrency: int = 4
    timeout: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    _gate: threading.Semaphore | None = field(default=None, repr=False)

    def __post_init__(self):
        self._gate = threading.Semaphore(self.concurrency)

    def _once(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
        with self._gate, urllib.request.urlopen(request, timeout=self.timeout) as reply:
            raw = reply.read()
        try:
            return json.loads(raw)
        except ValueError as e:
            raise ModelError(f"undecodable response: {raw[:200]!r}") from e

    def _post(self, path: str, body: dict) -> dict:
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(backoff(attempt))
            try:
                return self._once(path, body)
            except urllib.error.HTTPError as e:
                last = ModelError(f"{e.code}: {e.read()[:200]!r}")
                if e.code != 429 and e.code < 500:
                    raise last from e
            except OSError as e:
                last = ModelError(str(e))
        raise last

    def _chat(self, messages: list[dict], as_json: bool) -> str:
        body = {"model": self.model, "messages": messages, "temperature": 0} | ({"response_format": {"type": "json_object"}} if as_json else {})
        choices = self._post("/chat/completions", body).get("choices") or []
        text = (choices[0].get("message", {}).get("content") or "") if choices else ""
        if not text.strip():
            raise EmptyReply("the model returned an empty completion")
        return text

    def chat(self, messages: list[dict]) -> str:
        return self._chat(messages, False)

    def chat_json(self, messages: list[dict]) -> dict:
        """A decoded object; undecodable and empty replies are sampled anew, as often as retries allow."""
        last: Exception | None = None
        for _ in range(self.retries + 1):
            try:
                return json.loads(strip_fence(self._chat(messages, True)))
            except (ValueError, EmptyReply) as e:
                last = e
        raise ModelError(f"no usable JSON: {last}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Unit vectors in the order of texts; no texts, no request."""
        if not texts:
            return []
        data = self._post("/embeddings", {"model": self.embed_model or self.model, "input": texts}).get("data") or []
        if len(data) != len(texts):
            raise ModelError(f"{len(data)} embeddings for {len(texts)} texts")
        return [normalised(list(map(float, d["embedding"]))) for d in sorted(data, key=lambda d: d.get("index", 0))]


@dataclass
class ScriptedModel:
    """Replies from a function of the messages, or from a list in turn; embeddings by hashing. Records what it was asked."""

    reply: Callable[[list[dict]], str] | list
    dims: int = 64
    asked: list = field(default_factory=list)

    def chat(self, messages: list[dict]) -> str:
        self.asked.append(messages)
        got = self.reply(messages) if callable(self.reply) else self.reply.pop(0)
        if isinstance(got, Exception):
            raise got
        return got if isinstance(got, str) else json.dumps(got)

    def chat_json(self, messages: list[dict]) -> dict:
        try:
            return json.loads(strip_fence(self.chat(messages)))
        except ValueError as e:
            raise ModelError(str(e)) from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        from strata.functions.text import STOPWORDS

        out = []
        for text in texts:
            v = [0.0] * self.dims
            for t in re.findall(r"[^\W_]+", text.lower()):
                if t not in STOPWORDS:
                    h = 2166136261
                    for b in t.encode():
                        h = (h ^ b) * 16777619 & 0xFFFFFFFF
                    v[h % self.dims] += 1
            out.append(normalised(v))
        return out


def offline_embedded(df: DataFrame, text_col: str = "text", dims: int = 64) -> DataFrame:
    """df with a vector column by hashing, in the JVM."""
    return df.withColumn("vector", hash_embedding(F.col(text_col), dims))


def embedded_by(df: DataFrame, make: Callable[[], Model], text_col: str = "text", partitions: int | None = None, batch: int = 64) -> DataFrame:
    """df with a vector column from a model that each task makes for itself; ``partitions`` bounds how many call at once."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(frames):
        model = make()
        for pdf in frames:
            vectors = []
            for at in range(0, len(pdf), batch):
                vectors += model.embed(pdf[text_col].iloc[at : at + batch].tolist())
            yield pdf.assign(vector=vectors)

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)
