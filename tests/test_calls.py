import itertools

import pytest
from pyspark.sql import functions as F

from pagewright.operators import calls, run

FAILURES = [(429, "", None), (429, "", 7), (429, "", 500), (429, "", -3), (400, "Rate limit hit", None), (400, "bad", None), (404, "", None), (503, "", None), (None, "rate limit", None)]


def schedule(rule, failure):
    return list(itertools.takewhile(lambda s: s is not None, (calls.wait(rule, k, calls.CallFailed(*failure)) for k in range(20))))


def test_waits_between_calls():
    assert schedule(calls.GATEWAY, (429, "", None)) == schedule(calls.GATEWAY, (400, "a RATE LIMIT", 9)) == [5, 10, 20, 40, 60, 60]
    assert schedule(calls.GATEWAY, (None, "", None)) == schedule(calls.GATEWAY, (404, "", None)) == [3, 6]
    assert schedule(calls.SERVICE, (429, "", None)) == [20, 20, 20]
    assert schedule(calls.SERVICE, (429, "", 500)) == [120, 120, 120]
    assert schedule(calls.SERVICE, (503, "", None)) == schedule(calls.SERVICE, (None, "", None)) == [5, 10, 15]
    assert schedule(calls.SERVICE, (404, "", None)) == []


@pytest.mark.parametrize("rule", [calls.GATEWAY, calls.SERVICE])
def test_tables_wait_alike(spark, rule):
    rows = [(k, *f) for k in (*range(9), 5000) for f in FAILURES]
    table = spark.createDataFrame(rows, "k int, status int, said string, after int")
    found = table.select("*", calls.waits(rule, *[F.col(c) for c in ("k", "status", "said", "after")]).alias("s")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["s"] == calls.wait(rule, r["k"], calls.CallFailed(r["status"], r["said"], r["after"])), r


class Scripted:
    """Fails as its list says, then tells what it was asked."""

    def __init__(self, *failures):
        self.failures, self.asked = list(failures), []

    def call(self, prompt, max_tokens, temperature):
        self.asked.append((max_tokens, temperature))
        if self.failures:
            raise self.failures.pop(0)
        return f'{{"html": "<p>{prompt}</p>"}}'


def test_a_patient_backend():
    slept, backend = [], Scripted(calls.CallFailed(429), calls.CallFailed(None), calls.Truncated(), calls.CallFailed(429), calls.Truncated())
    assert calls.Patient(backend, sleep=slept.append).transcribe("x") == '{"html": "<p>x</p>"}'
    assert slept == [5, 6, 5] and backend.asked == [(8000, None)] * 3 + [(8000, 0.3)] * 2 + [(8000, 0.6)]
    with pytest.raises(ValueError, match="cut at 50"):
        calls.Patient(Scripted(*[calls.Truncated() for _ in range(3)]), budget=50).transcribe("x")
    with pytest.raises(calls.CallFailed, match="status 404"):
        calls.Patient(Scripted(calls.CallFailed(404)), calls.SERVICE, sleep=slept.append).transcribe("x")


def test_pages_outlive_refused_calls(spark):
    prompts = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, page_index int, prompt string").coalesce(1)

    class Refusing:
        """Of this test alone, so that it travels with the task."""

        failures = [calls.CallFailed(429), calls.CallFailed(401, "no key"), calls.CallFailed(503)]

        def call(self, prompt, max_tokens, temperature):
            if self.failures:
                raise self.failures.pop(0)
            return f'{{"html": "<p>{prompt}</p>"}}'

    def make():
        return calls.Patient(Refusing(), calls.SERVICE, sleep=lambda s: None)

    found = {r["page_index"]: (r["reply"], r["failure"]) for r in run.replies(prompts, make).collect()}
    assert found[1] == (None, "status 401: no key") and found[2] == ('{"html": "<p>b</p>"}', None)
