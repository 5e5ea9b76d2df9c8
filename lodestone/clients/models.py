"""Language models behind HTTP: a local server and a hosted one, with the same request and the same errors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from lodestone.clients.transport import Broken, HttpProblem, Status, TimedOut, Transport, Unavailable, post_json, urlopen

# Defaults of the services' addresses, models and limits.
LOCAL_HOST = "http://localhost:11434"
LOCAL_MODEL = "qwen2.5-coder:14b"
EMBED_MODEL = "bge-small-en-v1.5"
HOSTED_ROOT = "https://generativelanguage.googleapis.com/v1beta/models"
HOSTED_KEY = "GEMINI_API_KEY"
MOST_TOKENS = 1024
SECONDS = 120.0


class Refused(RuntimeError):
    """The service is there and will not serve: a missing or wrong key. Never holds the key."""


@dataclass(frozen=True)
class Request:
    """What is asked; a schema constrains the reply where the service can do so."""

    system: str
    user: str
    temperature: float = 0.0
    seconds: float = SECONDS
    schema: dict | None = None


def _mapped(call):
    """The services' errors: a rejected key is for a person to mend, all else that is no connection is a broken exchange."""
    try:
        return call()
    except Status as e:
        if e.code in (401, 403):
            raise Refused(f"the service rejected the request (status {e.code})") from None
        raise Broken(str(e)) from None


@dataclass
class LocalModel:
    """A model server on this or another machine, without credentials."""

    host: str = LOCAL_HOST
    model: str = LOCAL_MODEL
    transport: Transport = urlopen

    @property
    def name(self) -> str:
        return f"local/{self.model}"

    def body(self, r: Request) -> dict:
        out = {"model": self.model, "system": r.system, "prompt": r.user, "stream": False, "options": {"temperature": r.temperature, "num_predict": MOST_TOKENS}}
        return out | ({"format": r.schema} if r.schema else {})

    def ask(self, r: Request) -> str:
        answer = _mapped(lambda: post_json(f"{self.host.rstrip('/')}/api/generate", self.body(r), timeout=r.seconds, transport=self.transport))
        text = answer.get("response") if isinstance(answer, dict) else None
        if not isinstance(text, str):
            raise Broken("the answer has no `response`")
        return text

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        return self.ask(Request(system, user, schema=schema))


@dataclass
class HostedModel:
    """A hosted model; its key comes from the environment, goes into a header and is never shown."""

    model: str
    key: str = field(default="", repr=False)
    transport: Transport = urlopen

    def __post_init__(self) -> None:
        self.key = self.key or os.environ.get(HOSTED_KEY, "")
        if not self.key.strip():
            raise Refused(f"{HOSTED_KEY} is not set")

    @property
    def name(self) -> str:
        return f"hosted/{self.model}"

    def body(self, r: Request) -> dict:
        settings: dict = {"temperature": r.temperature}
        if r.schema:
            settings |= {"responseMimeType": "application/json", "responseSchema": r.schema}
        return {"system_instruction": {"parts": [{"text": r.system}]}, "contents": [{"parts": [{"text": r.user}]}], "generationConfig": settings}

    def ask(self, r: Request) -> str:
        url = f"{HOSTED_ROOT}/{self.model}:generateContent"
        answer = _mapped(lambda: post_json(url, self.body(r), {"x-goog-api-key": self.key}, r.seconds, self.transport))
        try:
            text = answer["candidates"][0]["content"]["parts"][0]["text"]
        except (KeyError, IndexError, TypeError):
            text = None
        if not isinstance(text, str):
            raise Broken("the answer has no candidate text")  # a blocked request looks like this; it is not an empty reply
        return text

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        return self.ask(Request(system, user, schema=schema))


@dataclass
class Embedder:
    """Vectors of texts from a model server: one call a batch, or one a text where the server is an older one."""

    host: str = LOCAL_HOST
    model: str = EMBED_MODEL
    transport: Transport = urlopen

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        host = self.host.rstrip("/")
        try:
            answer = post_json(f"{host}/api/embed", {"model": self.model, "input": texts}, timeout=SECONDS, transport=self.transport)
        except Status as e:
            if e.code != 404:
                raise
            return [self._one(host, t) for t in texts]
        rows = answer.get("embeddings") if isinstance(answer, dict) else None
        if not isinstance(rows, list):
            raise Broken("the answer has no `embeddings`")
        out = [_vector(r) for r in rows]
        if len(out) != len(texts):
            raise Broken(f"{len(texts)} vectors expected, {len(out)} came")
        return out

    def _one(self, host: str, text: str) -> list[float]:
        answer = post_json(f"{host}/api/embeddings", {"model": self.model, "prompt": text}, timeout=SECONDS, transport=self.transport)
        return _vector(answer.get("embedding") if isinstance(answer, dict) else None)


def _vector(x: object) -> list[float]:
    if not isinstance(x, list) or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in x):
        raise Broken("a vector is missing or not made of numbers")
    return [float(v) for v in x]


__all__ = ["Broken", "Embedder", "HostedModel", "HttpProblem", "LocalModel", "Refused", "Request", "TimedOut", "Unavailable"]
