"""Chat models behind HTTP: two public wire formats, called from executors in Arrow batches.

A client is a small picklable value. It sends one request for each row that has
a prompt; a row's failure to connect is an error that names the endpoint. Keys
are read from an environment variable where the call is made, never stored.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import ship_package


class ModelUnavailable(ConnectionError):
    """The endpoint cannot be reached."""


@dataclass(frozen=True)
class Reply:
    text: str
    model: str
    input_tokens: int | None
    output_tokens: int | None
    total_tokens: int | None
    latency_ms: float


class Client(Protocol):
    """Answers a system and a user prompt."""

    def __call__(self, system: str, user: str) -> Reply: ...


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(
        url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST"
    )
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{url} answered {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise ModelUnavailable(f"{url}: {e}") from e


@dataclass(frozen=True)
class ChatCompletions:
    """A server that speaks the chat-completions format, such as a local one."""

    model: str
    base_url: str = "http://localhost:1234/v1"
    temperature: float = 0.0
    max_tokens: int = 1024
    schema: str | None = None
    key_variable: str | None = None
    timeout: float = 120.0

    def __call__(self, system: str, user: str) -> Reply:
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
            "temperature": self.temperature,
            "max_tokens": self.max_tokens,
        }
        if self.schema is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "schema": json.loads(self.schema)}}
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        start = time.perf_counter()
        got = _post(f"{self.base_url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout)
        took = 1000 * (time.perf_counter() - start)
        text, usage = got["choices"][0]["message"].get("content") or "", got.get("usage") or {}
        return Reply(text, self.model, *(usage.get(f"{n}_tokens") for n in ("prompt", "completion", "total")), took)


@dataclass(frozen=True)
class GenerateContent:
    """A hosted model that speaks the generate-content format; the key comes from an environment variable."""

    model: str
    base_url: str = "https://generativelanguage.googleapis.com/v1beta"
    temperature: float = 0.2
    max_tokens: int = 1024
    schema: str | None = None
    key_variable: str = "GEMINI_API_KEY"
    timeout: float = 120.0

    def __call__(self, system: str, user: str) -> Reply:
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"the environment variable {self.key_variable} is not set")
        settings = {"temperature": self.temperature, "maxOutputTokens": self.max_tokens}
        if self.schema is not None:
            settings |= {"responseMimeType": "application/json", "responseSchema": json.loads(self.schema)}
        body = {
            "systemInstruction": {"parts": [{"text": system}]},
            "contents": [{"role": "user", "parts": [{"text": user}]}],
            "generationConfig": settings,
        }
        start = time.perf_counter()
        got = _post(f"{self.base_url.rstrip('/')}/models/{self.model}:generateContent", body, {"x-goog-api-key": key}, self.timeout)
        took = 1000 * (time.perf_counter() - start)
        first = (got.get("candidates") or [{}])[0]
        text = "".join(p.get("text", "") for p in first.get("content", {}).get("parts", []))
        usage = got.get("usageMetadata") or {}
        counts = (usage.get(n) for n in ("promptTokenCount", "candidatesTokenCount", "totalTokenCount"))
        return Reply(text, self.model, *counts, took)


REPLY = "reply string, reply_model string, input_tokens int, output_tokens int, total_tokens int, latency_ms double"


def replies(rows: DataFrame, client: Client, system: str | Column, user: Column, good: Callable[[str], bool] | None = None, attempts: int = 1) -> DataFrame:
    """Rows with the model's reply to each, its token use and latency; a null prompt has a null reply.

    good: what a usable reply is. A reply that isn't is asked for again, up to
    `attempts` times in all; then it is an error.
    """
    ship_package(rows.sparkSession)
    names = rows.columns
    schema = StructType(rows.schema.fields + StructType.fromDDL(REPLY).fields)
    asked = rows.select(
        F.struct(*names).alias("row"), (F.lit(system) if isinstance(system, str) else system).alias("system"), user.alias("user")
    )
    made = [f.name for f in StructType.fromDDL(REPLY)]

    def one(system_text: str, user_text: str | None) -> tuple:
        if user_text is None:
            return (None,) * len(made)
        for _ in range(attempts):
            got = client(system_text, user_text)
            if good is None or good(got.text):
                return got.text, got.model, got.input_tokens, got.output_tokens, got.total_tokens, got.latency_ms
        raise RuntimeError(f"no usable reply after {attempts} attempts: {got.text[:200]!r}")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_ = pd.DataFrame(batch["row"].to_list() if isinstance(batch["row"], pd.Series) else batch["row"], columns=names)
            found = pd.DataFrame([one(s, u) for s, u in zip(batch["system"], batch["user"])], columns=made)
            for n in ("input_tokens", "output_tokens", "total_tokens"):
                found[n] = found[n].astype("Int32")
            yield pd.concat([rows_.reset_index(drop=True), found], axis=1)

    return asked.mapInPandas(answer, schema)
