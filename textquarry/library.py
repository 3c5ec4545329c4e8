"""Archives that fail and tire apart from each other: one tagged job for each, under one time budget."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from textquarry.engine import Engine
from textquarry.operators import search as S
from textquarry.plans import paging

#: Seconds that one call over all archives may take, archives asked at a time, and the most hits of one.
BUDGET, AT_ONCE, MOST_HITS = 20.0, 8, 50


@dataclass
class Outcome:
    """What became of one archive: its value, or an error, or neither because the time was up."""

    name: str
    value: Any = None
    error: str | None = None
    late: bool = False


def apart(spark: SparkSession, jobs: dict[str, Callable[[], Any]], budget: float = BUDGET, at_once: int = AT_ONCE) -> list[Outcome]:
    """Runs each job in a thread under a tag of its own; those unfinished after ``budget`` seconds (0: no limit) are interrupted.

    A job that raises costs only its own result.
    """
    ends = time.monotonic() + budget if budget > 0 else None
    run = uuid.uuid4().hex[:12]
    tags = {name: f"apart-{run}-{i}" for i, name in enumerate(jobs)}

    def one(name: str) -> Any:
        if ends is not None and time.monotonic() >= ends:
            raise TimeoutError
        spark.addTag(tags[name])
        try:
            return jobs[name]()
        finally:
            spark.removeTag(tags[name])

    pool = ThreadPoolExecutor(max(1, min(at_once, len(jobs))))
    futures: dict[str, Future] = {name: pool.submit(inheritable_thread_target(spark)(partial(one, name))) for name in jobs}
    wait(futures.values(), timeout=None if ends is None else max(0.0, ends - time.monotonic()))
    out = []
    for name, f in futures.items():
        if not f.done():
            f.cancel()
            spark.interruptTag(tags[name])
            out.append(Outcome(name, late=True))
        elif isinstance(f.exception(), TimeoutError):
            out.append(Outcome(name, late=True))
        elif f.exception() is not None:
            out.append(Outcome(name, error=f"{type(f.exception()).__name__}: {f.exception()}"))
        else:
            out.append(Outcome(name, f.result()))
    pool.shutdown(wait=False, cancel_futures=True)
    return out


class Library:
    """Archives by name, each given by its entries or by a function that opens them, and each with an engine of its own."""

    def __init__(self, spark: SparkSession, archives: dict[str, DataFrame | Callable[[], DataFrame]], indexes: dict[str, str] | None = None):
        self.spark, self.archives, self.indexes = spark, archives, indexes or {}
        self._engines: dict[str, Engine] = {}

    def engine(self, name: str) -> Engine:
        """The engine of one archive, opened at its first use."""
        if name not in self._engines:
            given = self.archives[name]
            self._engines[name] = Engine(given() if callable(given) else given, self.indexes.get(name))
        return self._engines[name]

    def search_all(self, query: str, limit_per_file: int = 5, budget: float = BUDGET) -> dict:
        """The first hits of every archive, in the archives' order, with what failed and what the time did not allow."""
        if not S.parsed_query(query):
            raise ValueError("the query has no word")
        if not 1 <= limit_per_file <= MOST_HITS:
            raise ValueError(f"limit_per_file must be 1 to {MOST_HITS}")
        jobs = {name: partial(lambda n: self.engine(n).search(query, limit=limit_per_file), name) for name in sorted(self.archives)}
        found = apart(self.spark, jobs, budget)
        rows = [{"archive": o.name, "has_hits": bool(o.value and o.value.total), "result": o.value, "error": o.error is not None, "error_message": o.error} for o in found if not o.late]
        late = [o.name for o in found if o.late]
        failed = sum(r["error"] for r in rows)
        hits = sum(r["result"].total for r in rows if r["result"] is not None)
        reasons = [paging.reason(query, 1, out_of_time=True)] * bool(late) + [paging.reason(query, 1, failed_archives=failed)] * bool(failed)
        if not hits:
            reasons.append(paging.reason(query, 0))
        return {
            "query": query, "results": rows, "files_available": len(jobs), "files_searched": len(rows), "files_with_hits": sum(r["has_hits"] for r in rows), "files_searched_successfully": len(rows) - failed,
            "files_failed": failed, "files_late": late, "done": not late, "meta": {"reason": reasons[0], "reasons": reasons} if reasons else {},
        }

    def close(self) -> None:
        for e in self._engines.values():
            e.close()
        self._engines.clear()
