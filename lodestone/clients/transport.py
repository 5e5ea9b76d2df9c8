"""HTTP with a small set of errors; the only place that opens connections.

A transport is a callable (method, url, body, headers, timeout) that gives
(status, bytes) or raises Unavailable, TimedOut or Broken. Services take one as a
parameter, so they can be tested, and run on executors, without a network.
"""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request
from collections.abc import Callable

AGENT = "lodestone/1 (corpus and triage engine)"
Transport = Callable[[str, str, bytes | None, dict[str, str], float], tuple[int, bytes]]


class HttpProblem(RuntimeError):
    """What can go wrong between here and an answer. Headers never go into a message, as they may hold secrets."""

    kind = "transport"


class Unavailable(HttpProblem, ConnectionError):
    """No connection: the service is not there."""

    kind = "unavailable"


class TimedOut(HttpProblem):
    kind = "timeout"


class Status(HttpProblem):
    """An answer that is not a success."""

    kind = "status"

    def __init__(self, code: int):
        super().__init__(f"http status {code}")
        self.code = code


class Broken(HttpProblem):
    """A connection that broke, or an answer that cannot be read."""


def urlopen(method: str, url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """The transport over urllib."""
    request = urllib.request.Request(url, data=body, method=method, headers={"User-Agent": AGENT} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except (TimeoutError, socket.timeout) as e:
        raise TimedOut("no answer in time") from e
    except urllib.error.URLError as e:
        if isinstance(e.reason, (TimeoutError, socket.timeout)):
            raise TimedOut("no answer in time") from e
        raise Unavailable(str(e.reason)) from e
    except OSError as e:
        raise Broken(str(e)) from e


def get_bytes(url: str, timeout: float = 30.0, transport: Transport = urlopen) -> bytes:
    status, body = transport("GET", url, None, {}, timeout)
    if not 200 <= status < 300:
        raise Status(status)
    return body


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 120.0, transport: Transport = urlopen) -> object:
    """The JSON that a service answers to some JSON."""
    sent = {"Content-Type": "application/json"} | (headers or {})
    status, answer = transport("POST", url, json.dumps(body).encode(), sent, timeout)
    if not 200 <= status < 300:
        raise Status(status)
    try:
        return json.loads(answer)
    except ValueError as e:
        raise Broken("the answer is not JSON") from e


def outcome(call: Callable[[], object]) -> tuple[object | None, str]:
    """(value, "ok") or (None, the kind of problem), for a status column."""
    try:
        return call(), "ok"
    except HttpProblem as e:
        return None, e.kind
