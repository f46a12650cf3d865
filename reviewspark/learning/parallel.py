"""Independent fits submitted from several driver threads, so that their jobs share the cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

PARALLELISM = 4

Result = TypeVar("Result")


def run_all(tasks: Sequence[Callable[[], Result]], parallelism: int = PARALLELISM) -> list[Result]:
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda task: task(), tasks)
