"""Driver-side helpers: retries and readiness of services."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def retried(call: Callable[[], T], times: int = 10, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; its last error after ``times`` failures."""
    for attempt in range(1, times + 1):
        try:
            return call()
        except OSError:
            if attempt == times:
                raise
            sleep(pause)
    raise ValueError("times must be positive")


def wait_for_port(host: str, port: int, delay: float = 1.0, timeout: float = 2.0, limit: float | None = None) -> bool:
    """True once the port takes connections; False after ``limit`` seconds, if there is a limit."""
    began = time.monotonic()
    while True:
        try:
            with socket.create_connection((host, port), timeout=timeout):
                return True
        except OSError:
            if limit is not None and time.monotonic() - began > limit:
                return False
            time.sleep(delay)


def wait_until(ready: Callable[[], bool], delay: float = 1.0, limit: float | None = None) -> bool:
    """True once ``ready`` says so, as for a topic that appears late."""
    began = time.monotonic()
    while not ready():
        if limit is not None and time.monotonic() - began > limit:
            return False
        time.sleep(delay)
    return True
