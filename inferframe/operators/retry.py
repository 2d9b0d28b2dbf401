"""Attempts of a call, rate limits, and what their outcome means for a row."""

from __future__ import annotations

import contextlib
import heapq
import os
import random
import re
import threading
import time
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.records import scratch_path

#: Fixed values of the retry policy: attempts after the first, bounds of the wait in seconds, jitter.
RETRIES, WAIT_LEAST, WAIT_MOST, JITTER = 5, 0.001, 30.0, 0.2


class Transient(Exception):
    """Worth another attempt."""


class Fatal(Exception):
    """No further attempt can help."""


@dataclass
class Outcome:
    """ok, fatal, recovered, given_up or unrecoverable, with the errors of all failed attempts in order."""

    kind: str
    value: Any = None
    errors: list[str] = field(default_factory=list)


def attempts(call: Callable[[], Any], retries: int = RETRIES, rng: random.Random | None = None) -> Generator[float, None, Outcome]:
    """Calls until it succeeds, fails for good, or has failed too often; gives the seconds to wait before each next attempt, which grow exponentially."""
    rng = rng or random.Random()
    errors: list[str] = []
    for i in range(retries + 1):
        try:
            return Outcome("recovered" if errors else "ok", call(), errors)
        except Fatal as e:
            return Outcome("unrecoverable" if errors else "fatal", None, [*errors, str(e)])
        except Transient as e:
            errors.append(str(e))
        if i < retries:
            wait = min(WAIT_MOST, WAIT_LEAST * (WAIT_MOST / WAIT_LEAST) ** (i / max(1, retries - 1)))
            yield wait * (1 + rng.uniform(-JITTER, JITTER))
    return Outcome("given_up", None, errors)


def attempt(call: Callable[[], Any], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Outcome:
    """All attempts of a call, one after another."""
    steps = attempts(call, retries, rng)
    while True:
        try:
            sleep(next(steps))
        except StopIteration as done:
            return done.value


class Waits:
    """Rows that wait for their next attempt, by one thread, so that none holds a place among the calls."""

    def __init__(self):
        self.heap: list[tuple[float, int, Callable[[], Any]]] = []
        self.change, self.n, self.closed = threading.Condition(), 0, False
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def add(self, seconds: float, go: Callable[[], Any]) -> None:
        with self.change:
            self.n += 1
            heapq.heappush(self.heap, (time.monotonic() + seconds, self.n, go))
            self.change.notify()

    def _run(self) -> None:
        while True:
            with self.change:
                while not self.closed and (not self.heap or self.heap[0][0] > time.monotonic()):
                    self.change.wait(self.heap[0][0] - time.monotonic() if self.heap else None)
                if self.closed:
                    return
                go = heapq.heappop(self.heap)[2]
            go()

    def __enter__(self) -> Waits:
        return self

    def __exit__(self, *_) -> None:
        """What still waits is dropped: its results are no longer asked for."""
        with self.change:
            self.closed = True
            self.change.notify()
        self.thread.join()


@dataclass(frozen=True)
class RateLimit:
    """So many attempts a second or minute."""

    n: int
    period: str

    @classmethod
    def parse(cls, text: str) -> RateLimit:
        m = re.fullmatch(r"(\d+)/([sm])", text)
        if not m or int(m[1]) < 1:
            raise ValueError(f"{text!r} is no rate limit like 10/s or 5/m")
        return cls(int(m[1]), m[2])

    def __str__(self) -> str:
        return f"{self.n}/{self.period}"

    @property
    def seconds(self) -> float:
        return 1.0 if self.period == "s" else 60.0

    def share(self, parts: int) -> list[int]:
        """Permits of each of some partitions that run together; they add up to n, so no more than n may run."""
        if parts > self.n:
            raise ValueError(f"{parts} partitions can't share {self}")
        return [self.n // parts + (i < self.n % parts) for i in range(parts)]


class Bucket:
    """A token bucket that is refilled whole after each period."""

    def __init__(self, permits: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.permits, self.seconds, self.clock, self.sleep = permits, seconds, clock, sleep
        self.left, self.until, self.lock = permits, clock() + seconds, threading.Lock()

    def take(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                if now >= self.until:
                    self.left, self.until = self.permits, now + self.seconds
                if self.left:
                    self.left -= 1
                    return
                wait = self.until - now
            self.sleep(wait)


@dataclass(frozen=True)
class Throttle:
    """A rate limit shared out over the partitions of a stage; pickled to workers, where each task makes its bucket of it."""

    permits: tuple[int, ...]
    seconds: float

    @classmethod
    def of(cls, limit: str | None, slots: int) -> Throttle | None:
        if not limit:
            return None
        parsed = RateLimit.parse(limit)
        return cls(tuple(parsed.share(slots)), parsed.seconds)

    def bucket(self) -> Bucket:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        return Bucket(self.permits[part % len(self.permits)], self.seconds)


class LeasedBucket:
    """Permits of a Ledger as one task takes them: a lease at a time, and only when a call asks."""

    def __init__(self, ledger: Ledger, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.ledger, self.clock, self.sleep, self.lock = ledger, clock, sleep, threading.Lock()
        self.slice, self.next, self.left = -1, 0, 0

    def take(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                if int(now // self.ledger.seconds) != self.slice:
                    # what is left of a lease ends with its slice
                    self.slice, self.next, self.left = int(now // self.ledger.seconds), 0, 0
                while not self.left and self.next < len(self.ledger.leases):
                    if self.ledger.claim(self.slice, self.next):
                        self.left = self.ledger.leases[self.next]
                    self.next += 1
                if self.left:
                    self.left -= 1
                    return
                wait = (self.slice + 1) * self.ledger.seconds - now
            self.sleep(max(wait, 0.001))


@dataclass(frozen=True)
class Ledger:
    """A rate limit for a whole run: each period's permits are leased, a few at a time, by creating a file in a folder that all machines mount.

    Creation is atomic, so each lease of a period has one holder, and no more permits than n go out in
    a period, whichever tasks ask: a busy task has what idle ones don't take. Periods are those of the machines' clocks.
    """

    folder: str
    leases: tuple[int, ...]
    seconds: float

    @classmethod
    def of(cls, folder: str, limit: str, tasks: int) -> Ledger:
        """Leases of a sixteenth of a task's share, or single permits."""
        parsed = RateLimit.parse(limit)
        size = max(1, parsed.n // (16 * max(1, tasks)))
        whole, rest = divmod(parsed.n, size)
        return cls(folder, (size,) * whole + ((rest,) if rest else ()), parsed.seconds)

    def claim(self, period: int, lease: int) -> bool:
        """Whether this lease is the caller's from now on. The first of a period clears those of an old one."""
        os.makedirs(self.folder, exist_ok=True)
        try:
            os.close(os.open(f"{self.folder}/{period}-{lease}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        if not lease:
            for i in range(len(self.leases)):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self.folder}/{period - 5}-{i}")
        return True

    def bucket(self) -> LeasedBucket:
        return LeasedBucket(self)


def limiter(spark: SparkSession, limit: str | None, tasks: int) -> Ledger | Throttle | None:
    """How the tasks of a run keep to one limit: by leases, or, where the scratch folder isn't a mounted file system, by fixed shares."""
    if not limit:
        return None
    where = urlparse(scratch_path(spark, "permits"))
    return Ledger.of(where.path, limit, tasks) if where.scheme in ("", "file") else Throttle.of(limit, min(tasks, RateLimit.parse(limit).n))


def dealt_jobs(jobs: int, slots: int) -> tuple[int, ...]:
    """Calls at a time in each of some tasks that run together: they add up to `jobs`, so there are no more tasks than that."""
    slots = max(1, min(jobs, slots))
    return tuple(jobs // slots + (i < jobs % slots) for i in range(slots))


def own_jobs(dealt: tuple[int, ...] | int) -> int:
    """This task's part; a number is that of every task."""
    if isinstance(dealt, int):
        return max(1, dealt)
    return dealt[(TaskContext.get().partitionId() if TaskContext.get() else 0) % len(dealt)]


def tasks_for(spark: SparkSession, jobs: int, limit: Ledger | Throttle | None = None) -> int:
    """Tasks that `jobs` calls at a time run in: as many as can run at once, and as share the permits where these are shared."""
    most = min(max(1, jobs), spark.sparkContext.defaultParallelism)
    return min(most, len(limit.permits)) if isinstance(limit, Throttle) else most


def outcome_status(kind: Column) -> Column:
    return F.when(kind.isin("ok", "recovered"), "ok").otherwise("failed")


def last_attempt(attempts: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """Outcome of each key's recorded attempts: the first success and the failures before it, within the policy's number."""
    w = Window.partitionBy(key).orderBy(*order)
    tried = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= RETRIES + 1)
    first = F.min(F.when(F.col(ok), F.col("_n")))
    out = tried.groupBy(key).agg(first.alias("_first"), F.count("*").alias("_all"))
    kind = F.when(F.col("_first") == 1, "ok").when(F.col("_first").isNotNull(), "recovered").otherwise("given_up")
    return out.select(key, kind.alias("outcome"), outcome_status(kind).alias("status"), F.coalesce(F.col("_first") - 1, "_all").cast("bigint").alias("n_errors"))


def admitted(requests: DataFrame, ts: str, order: list[str], limit: RateLimit) -> DataFrame:
    """Adds `admitted`: whether a bucket that is refilled at fixed times would let a request pass at once."""
    w = Window.partitionBy("_period").orderBy(*order)
    period = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(int(limit.seconds * 1_000_000)))
    return requests.withColumn("_period", period).withColumn("admitted", F.row_number().over(w) <= limit.n).drop("_period")
