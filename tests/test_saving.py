"""Edits of pages against a plain loop."""

import random

from pagewright.operators import saving

PAGES = "doc_id string, page_index int, label string, html string, starts_mid_paragraph boolean, ends_mid_paragraph boolean, skip boolean, status string, notes string, version int, changed_by string, updated_at string, figures array<string>, extra int"
EDITS = "event_id long, doc_id string, page_index int, base_version int, label string, skip boolean, starts_mid_paragraph boolean, ends_mid_paragraph boolean, html string, notes string, status string, actor string, at string, figures array<string>, `a.b` int"


def test_edits_of_pages(spark):
    rng = random.Random(4)
    pages = [(d, p, "1", "<p>old</p>", False, True, False, "done", "", p, "reader", None, ["f"], 7) for d in "ab" for p in (1, 2, 3)]
    edits = [
        (n, rng.choice("abx"), rng.choice([1, 2, None]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "", f"l{n}"]), rng.choice([None, False, True]), rng.choice([None, True]), None, rng.choice([None, " ", f"<p>{n}</p>"]),
         rng.choice([None, "", "see"]), rng.choice([None, "done", "pending", "error"]), f"who{n}", f"t{n}", rng.choice([None, [], ["g"]]), 1)
        for n in range(60)
    ]
    state = {(p[0], p[1]): list(p) for p in pages}
    outcomes = {}
    for n, d, p, base, label, skip, starts, ends, html, notes, status, actor, at, figures, _ in edits:
        page = state.get((d, p))
        if page is None or base not in (None, page[9]):
            outcomes[n] = (None, "no page") if page is None else (page[9], "conflict")
            continue
        body, skip = (html or "").strip(), bool(skip)
        empty = not body and not skip
        said = " | ".join(x for x in (notes, "the result is empty" if empty else "") if x)
        follows = "needs_review" if empty or said else "done"
        chosen = ("pending" if empty else status) if status in saving.SETTABLE else follows
        page[2:13] = [label or page[2], body, bool(starts), bool(ends), skip, chosen, said, page[9] + 1, actor, at, page[12] if figures is None else figures]
        outcomes[n] = (page[9], "accepted")
    before, made = spark.createDataFrame(pages, PAGES).repartition(3), spark.createDataFrame(edits, EDITS).repartition(4)
    assert {r["event_id"]: (r["version"], r["outcome"]) for r in saving.settle(before, made).collect()} == outcomes
    after = saving.save(before, made)
    assert after.columns == before.columns and sorted(map(tuple, after.collect())) == sorted(tuple(p) for p in state.values())
    assert {(r["event_id"], r["version"]) for r in saving.conflicts(before, made).collect()} == {(n, v) for n, (v, o) in outcomes.items() if o == "conflict"}
    assert {o for _, o in outcomes.values()} == {"accepted", "conflict", "no page"}


def test_no_edits(spark):
    pages = spark.createDataFrame([("a", 1, None, None, None, None, None, None, None, 0, None, None, None, 1)], PAGES)
    none = spark.createDataFrame([], EDITS)
    assert saving.save(pages, none).collect() == pages.collect() and saving.settle(pages, none).isEmpty()
    assert saving.save(pages.limit(0), none).isEmpty()
