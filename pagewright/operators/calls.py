"""Calls that may be refused: how long to wait before a call is made again, and a backend that does so.

``wait`` is the rule for one failed call; ``waits`` is the same as a Column, for tables of calls. Backends that make calls raise
``CallFailed`` and ``Truncated``; ``Patient`` stands before one in a task and asks it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# What some gateways say with a status 400, the budget of a page's reply, and how a cut reply is asked for again.
LIMIT_TEXT = "rate limit"
BUDGET = 8000
WARMER = (0.3, 0.6)


class Rule(NamedTuple):
    """How often a call is made, and the seconds between: ``doubling`` from ``first`` up to ``longest`` where too much was asked, or what the
    service says up to ``longest`` (``first`` if it says nothing); a multiple of ``step`` after other failures."""

    attempts: int
    first: int
    longest: int
    doubling: bool
    step: int
    other_attempts: int
    #: The least status that is tried again besides those that say too much was asked.
    least_status: int


# A gateway that speaks the common chat protocol, and a service that says when to come back.
GATEWAY = Rule(attempts=7, first=5, longest=60, doubling=True, step=3, other_attempts=3, least_status=400)
SERVICE = Rule(attempts=4, first=20, longest=120, doubling=False, step=5, other_attempts=4, least_status=500)


class CallFailed(Exception):
    """A call without a reply: its status (null where there was no connection), what was said, and the seconds after which to come back."""

    def __init__(self, status: int | None, said: str = "", retry_after: int | None = None) -> None:
        super().__init__(status, said, retry_after)  # as they came, so that it travels between processes
        self.status, self.said, self.retry_after = status, said, retry_after

    def __str__(self) -> str:
        return f"{f'status {self.status}' if self.status else 'no connection'}: {self.said[:200]}"


class Truncated(Exception):
    """A reply that was cut at its budget."""


class CallingBackend(Protocol):
    def call(self, prompt: str, max_tokens: int, temperature: float | None) -> str: ...


def limited(status: int | None, said: str) -> bool:
    """Too much was asked: 429, or 400 with words that say so."""
    return status == 429 or (status == 400 and LIMIT_TEXT in said.lower())


def is_limited(status: Column, said: Column) -> Column:
    """The same over a table; a null status is none."""
    return F.coalesce((status == 429) | ((status == 400) & F.contains(F.lower(F.coalesce(said, F.lit(""))), F.lit(LIMIT_TEXT))), F.lit(False))


def wait(rule: Rule, attempt: int, failure: CallFailed) -> int | None:
    """Seconds to wait after the attempt of this number (from 0) has failed, null if the call is given up."""
    if limited(failure.status, failure.said):
        asked = rule.first * 2**attempt if rule.doubling else rule.first if failure.retry_after is None else failure.retry_after
        return min(rule.longest, max(asked, 0)) if attempt + 1 < rule.attempts else None
    again = failure.status is None or failure.status >= rule.least_status
    return rule.step * (attempt + 1) if again and attempt + 1 < rule.other_attempts else None


def waits(rule: Rule, attempt: Column, status: Column, said: Column, retry_after: Column) -> Column:
    """``wait`` over a table of failed calls."""
    # Past the rule's attempts no wait is told, so that the doubling stays small.
    asked = (F.pow(F.lit(2), F.least(attempt, F.lit(rule.attempts))) * rule.first).cast("int") if rule.doubling else F.coalesce(retry_after.cast("int"), F.lit(rule.first))
    after_limit = F.when(attempt + 1 < rule.attempts, F.least(F.lit(rule.longest), F.greatest(asked, F.lit(0))))
    again = (status.isNull() | (status >= rule.least_status)) & (attempt + 1 < rule.other_attempts)
    return F.when(is_limited(status, said), after_limit).when(again, (attempt.cast("int") + 1) * rule.step).cast("int")


class Patient:
    """A backend for ``run.replies`` that asks another one again by a rule, and for a cut reply again with other temperatures.

    Waiting holds up its own task only. What is left without a reply is raised, and becomes the page's failure.
    """

    def __init__(self, backend: CallingBackend, rule: Rule = GATEWAY, budget: int = BUDGET, sleep: Callable[[float], None] = time.sleep) -> None:
        self.backend, self.rule, self.budget, self.sleep = backend, rule, budget, sleep

    def transcribe(self, prompt: str) -> str:
        for temperature in (None, *WARMER):
            try:
                return self._answer(prompt, temperature)
            except Truncated:
                continue
        raise ValueError(f"the reply was cut at {self.budget} tokens, {1 + len(WARMER)} times")

    def _answer(self, prompt: str, temperature: float | None) -> str:
        attempt = 0
        while True:
            try:
                return self.backend.call(prompt, self.budget, temperature)
            except CallFailed as failure:
                seconds = wait(self.rule, attempt, failure)
                if seconds is None:
                    raise
            self.sleep(seconds)
            attempt += 1
