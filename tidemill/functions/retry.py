"""Commit conflicts: how long to wait before the next attempt, what counts as one, what an error says."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")
MAX_RETRIES, MAX_DELAY_MS = 8, 50


class Conflict(Exception):
    """Another writer committed the version that this one was made for."""


def backoff_ms(attempt: int, max_delay_ms: int = MAX_DELAY_MS) -> int:
    return min(max_delay_ms, 2**attempt)


def backoff_column(attempt: Column, max_delay_ms: int = MAX_DELAY_MS) -> Column:
    return F.least(F.lit(max_delay_ms), F.pow(F.lit(2), attempt)).cast("long")


def is_conflict(error: BaseException) -> bool:
    return isinstance(error, (Conflict, FileExistsError)) or "FileAlreadyExistsException" in str(error)


def with_retries(body: Callable[[], T], max_retries: int = MAX_RETRIES, max_delay_ms: int = MAX_DELAY_MS, sleep=time.sleep) -> T:
    """Run ``body`` anew from its start for as long as it meets conflicts; real time, not the injected clock."""
    attempt = 0
    while True:
        try:
            return body()
        except Exception as error:
            attempt += 1
            if not is_conflict(error) or attempt > max_retries:
                raise
            sleep(backoff_ms(attempt, max_delay_ms) / 1000)


def error_text(error: BaseException | str) -> str:
    return str(error)


def whole(name: str, value: int, least: int) -> int:
    """An option that is a whole number from ``least`` on."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")
    return value
