"""Many requests at a time from one task, in order, with retries and one stop for all tasks."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from threading import local

from lodestone.clients.transport import HttpProblem, Unavailable
from lodestone.session import arrow_store

#: Requests that a task has under way, times that one is tried again, and seconds before the first of these.
WORKERS, RETRIES, PAUSE = 8, 2, 0.5
#: Seconds for which a task does not look again whether another one has stopped.
_LOOK = 1.0


class Stop:
    """Whether a service is gone: one file that all tasks see, below the shared folder."""

    def __init__(self, uri: str | None):
        self.uri, self.why, self.looked = uri, None, 0.0

    def set(self, why: str) -> None:
        self.why = self.why or why
        if self.uri:
            store, path = arrow_store(self.uri)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(self.why.encode())

    def reason(self) -> str | None:
        """Why to stop, or None; the file is looked for once a second at most."""
        now = time.monotonic()
        if self.why is None and self.uri and now - self.looked >= _LOOK:
            self.looked = now
            store, path = arrow_store(self.uri)
            if store.get_file_info(path).is_file:
                with store.open_input_stream(path) as f:
                    self.why = f.read().decode() or "stopped"
        return self.why


def tried(ask: Callable[[], object], retries: int = RETRIES, pause: float = PAUSE) -> object:
    """What a request gives; one that fails for a time is tried again, after twice as long each time."""
    for k in range(retries):
        try:
            return ask()
        except Unavailable:
            raise
        except HttpProblem as e:
            if getattr(e, "code", 500) < 500 and getattr(e, "code", 500) != 429:
                raise  # the request itself is wrong
            time.sleep(pause * 2**k)
    return ask()


def in_order(items: Iterable, make: Callable[[], object], ask: Callable[[object, object], object], stop: Stop, workers: int = WORKERS, retries: int = RETRIES, pause: float = PAUSE) -> Iterator[tuple[object, object, Exception | str | None]]:
    """(item, result, problem) for each item, in their order.

    At most ``workers`` requests are under way and twice as many items are held;
    each thread has a client of its own. Once a service is unavailable, here or in
    another task, no further request is begun and the problem is the reason as text.
    """
    mine = local()

    def one(item):
        why = stop.reason()
        if why is not None:
            return None, why
        try:
            if not hasattr(mine, "client"):
                mine.client = make()
            return tried(lambda: ask(mine.client, item), retries, pause), None
        except Unavailable as e:
            stop.set(str(e) or "unavailable")
            return None, stop.why
        except Exception as e:  # the caller says which problems cost one item and which end the task
            return None, e

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        waiting: deque[tuple[object, Future]] = deque()
        for item in items:
            waiting.append((item, pool.submit(one, item)))
            if len(waiting) >= 2 * max(1, workers):
                first, got = waiting.popleft()
                yield (first, *got.result())
        while waiting:
            first, got = waiting.popleft()
            yield (first, *got.result())
