"""Text models behind one interface: a function from a batch of prompts to a batch of answers, run on the executors.

No model and no network is assumed: the default runtime answers from a deterministic stub. Another runtime is any function that can be
sent to the executors; it reads its own credentials there, so that none are part of a plan."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of messages of failures that may pass.
RETRYABLE = ("timeout", "timed out", "temporarily", "connection", "429", "502", "503", "504")
# Parts of messages of models that don't know a response format.
FORMAT_UNKNOWN = ("response_format", "json_schema", "json_object")


@dataclass(frozen=True)
class Runtime:
    provider: str
    endpoint: str | None = None
    model: str | None = None
    attempts: int = 3
    wait: float = 1.0
    #: the environment variable that holds the key; the key itself is read where it is used
    key_from: str | None = None


def from_environment(*prefixes: str) -> Runtime:
    """The runtime of the first prefix (without any: TEXT_MODEL) of which <prefix>_ENDPOINT and <prefix>_NAME are set, a second set of credentials being the fallback of the first; without one the
    stub. <PREFIX>_DISABLE switches a prefix off."""
    for prefix in prefixes or ("TEXT_MODEL",):
        endpoint, model = (os.environ.get(f"{prefix}_{x}", "").strip() for x in ("ENDPOINT", "NAME"))
        off = os.environ.get(f"{prefix}_DISABLE", "").strip().lower() in ("1", "true", "yes")
        if endpoint and model and not off:
            return Runtime("http", endpoint, model, key_from=f"{prefix}_KEY")
    return Runtime("stub")


def chat_url(endpoint: str) -> str:
    """An endpoint's address for chat completions, given with or without that path."""
    bare = endpoint.strip().rstrip("/")
    return bare if bare.endswith("/chat/completions") else f"{bare}/chat/completions"


def content_of(reply: dict) -> str:
    """The text of a chat reply: a string, or the text parts of a list."""
    choices = reply.get("choices") or []
    if not choices:
        raise ValueError("reply without choices")
    content = (choices[0].get("message") or {}).get("content")
    if isinstance(content, list):
        content = "".join(p.get("text", "") for p in content if isinstance(p, dict))
    if not isinstance(content, str) or not content.strip():
        raise ValueError("reply without content")
    return content.strip()


def http_chat(runtime: Runtime, response_format: dict | None = None, system: str = "", temperature: float = 0.0, max_tokens: int = 2048, timeout: float = 90, opener: Callable = urllib.request.urlopen) -> Callable[[list[str]], list[str]]:
    """A model behind a chat endpoint. The key is read from the environment of the executor that asks."""

    def ask(prompt: str) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = {"model": runtime.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        if response_format is not None:
            body["response_format"] = response_format
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(runtime.key_from or "", "").strip()
        if key:
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(chat_url(runtime.endpoint), json.dumps(body).encode(), headers, method="POST")
        try:
            with opener(request, timeout=timeout) as reply:
                return content_of(json.loads(reply.read()))
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:500]}") from e
        except urllib.error.URLError as e:
            raise RuntimeError(f"connection: {e.reason}") from e

    return lambda prompts: [ask(p) for p in prompts]


def with_formats(make: Callable[[dict | None], Callable[[list[str]], list[str]]], formats: list[dict | None]) -> Callable[[list[str]], list[str]]:
    """Asks in the first of the formats that the model knows (None: no format). A failure that isn't about the format is no reason for the next one."""

    def call(prompts: list[str]) -> list[str]:
        for k, one in enumerate(formats):
            try:
                return make(one)(prompts)
            except Exception as e:
                if one is None or k + 1 == len(formats) or not any(m in str(e).lower() for m in FORMAT_UNKNOWN):
                    raise
        raise ValueError("no formats")

    return call


def stub(prompts: list[str]) -> list[str]:
    return ['{"entities": [], "facts": [], "key": "%s"}' % hashlib.sha256(p.encode()).hexdigest()[:20] for p in prompts]


def with_retries(model: Callable[[list[str]], list[str]], runtime: Runtime) -> Callable[[list[str]], list[str]]:
    def call(prompts: list[str]) -> list[str]:
        for k in range(runtime.attempts):
            try:
                return model(prompts)
            except Exception as e:
                if k + 1 == runtime.attempts or not any(m in str(e).lower() for m in RETRYABLE):
                    raise
                time.sleep(runtime.wait * 2**k)
        raise AssertionError("unreachable")

    return call


def answer(prompts: DataFrame, model: Callable[[list[str]], list[str]] = stub, runtime: Runtime = Runtime("stub"), batch: int = 32) -> DataFrame:
    """prompts (key, prompt) -> (key, prompt, answer). Equal prompts are asked once."""
    asked = prompts.select("prompt").where("prompt is not null").distinct()
    call = with_retries(model, runtime)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf["prompt"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"prompt": part, "answer": call(part)})

    return prompts.join(asked.mapInPandas(run, "prompt string, answer string"), "prompt", "left").select(*prompts.columns, F.col("answer"))
