from pyspark.sql import functions as F

from pagewright.operators import drafts

PAGE = "doc_id string, page_index int"
LINE = f"{PAGE}, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"
LAYER = f"{PAGE}, block int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"


def test_rows_of_lines(spark):
    """Half a row goes to the even one: 6 and 30 are in rows 0 and 2, 18 is in row 2 too."""
    lines = spark.createDataFrame([("d", 1, t, x, y, x + 9, y + 9, 100.0, 100.0) for t, x, y in [("c", 5.0, 30.0), ("b", 1.0, 18.0), ("a2", 9.0, 0.0), ("a1", 2.0, 6.0), ("d", 0.0, 31.0)]], LINE)
    assert [r["text"] for r in drafts.ordered_lines(lines).orderBy("line").collect()] == ["a1", "a2", "b", "c", "d"]


def test_words_of_a_layer(spark):
    rows = [("d", 1, 1, 0, 0, "last", 0.0, 0.0, 30.0, 10.0), ("d", 1, 0, 1, 0, "second", -5.0, 190.0, 60.0, 250.0), ("d", 1, 0, 0, 1, " ", 1.0, 1.0, 2.0, 2.0), ("d", 1, 0, 0, 0, "first", 10.0, 20.0, 30.0, 40.0)]
    words = drafts.layer_words(spark.createDataFrame([(*r, 100.0, 200.0) for r in rows], LAYER)).first()["words"]
    assert [tuple(w) for w in words] == [("first", 100.0, 100.0, 300.0, 200.0), ("second", 0.0, 950.0, 600.0, 1000.0), ("last", 0.0, 0.0, 300.0, 50.0)]


def test_only_short_layers_are_recognised_and_only_once(spark, tmp_path):
    long, path = "x" * 40, str(tmp_path / "drafts")
    texts = spark.createDataFrame([("a", 1, long), ("a", 2, "x" * 39), ("a", 4, None)], f"{PAGE}, text string")
    layer = spark.createDataFrame([("a", 1, 0, 0, 0, long, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], LAYER)
    lines = spark.createDataFrame([("a", i, f"line of {i}", 0.0, 0.0, 11.0, 10.0, 11.0, 10.0) for i in (1, 2, 3)], LINE)
    asked, given = [], []

    def recognise(pages):
        asked.append(sorted(tuple(r) for r in pages.collect()))
        return lines.join(pages, ["doc_id", "page_index"], "left_semi")

    def compute(missing):
        given.append(sorted(tuple(r) for r in missing.select("doc_id", "page_index").collect()))
        return drafts.drafts(missing, texts, layer, recognise)

    pages = spark.createDataFrame([("a", i, "print") for i in (1, 2, 3, 4)] + [("a", 5, None), ("a", 1, "print")], f"{PAGE}, fingerprint string")
    first = {r["page_index"]: r for r in drafts.kept(pages, path, compute).collect()}
    assert asked == [[("a", 2), ("a", 3), ("a", 4)]]
    assert {i: (r["draft_text"], r["draft_source"]) for i, r in first.items()} == {1: (long, "textlayer"), 2: ("line of 2", "ocr"), 3: ("line of 3", "ocr"), 4: ("", "ocr")}
    assert [w["text"] for w in first[2]["words"]] == ["line", "of", "2"] and first[4]["words"] == [] and first[1]["words"][0]["text"] == long
    again = {r["page_index"]: r for r in drafts.kept(pages, path, compute).collect()}
    assert again == first and len(given) == 1
    # The file under another id is known; a changed one is not.
    copies = spark.createDataFrame([("copy", 2, "print"), ("a", 2, "changed")], f"{PAGE}, fingerprint string")
    found = {r["doc_id"]: r["draft_text"] for r in drafts.kept(copies, path, compute).collect()}
    assert found == {"copy": "line of 2", "a": "line of 2"} and given[1:] == [[("a", 2)]]
    assert drafts.kept(pages.limit(0), path, compute).count() == 0
    assert drafts.ordered_lines(lines.limit(0)).withColumn("n", F.lit(1)).count() == 0
