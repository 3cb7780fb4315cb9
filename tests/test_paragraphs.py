"""Loose text and inline tags of a page gathered in paragraphs."""

from pagewright.operators import sanitize

PAGES = [
    ('a /> b<p id="/>">c</p> d ', '<p>a /&gt; b</p><p id="/&gt;">c</p><p>d</p>'),
    (" <em> x</em><math><a<>z</a<></math> ", "<p><em> x</em><math><a<>z</a<></math></p>"),
    ("<article>x </article> ", "<p>x</p>"),
    ("one<br><ul><li>two</li></ul> three <hr> ", "<p>one<br></p><ul><li>two</li></ul><p>three</p><hr>"),
    (None, ""),
    ("  ", ""),
]


def test_what_is_loose_is_gathered(spark):
    rows = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(PAGES)], "id int, html string")
    assert [r["html"] for r in sanitize.sanitize(rows).orderBy("id").collect()] == [clean for _, clean in PAGES]


def test_no_text_grows_token_by_token(spark, capsys):
    """A page's markup is joined once: a fold that adds to it would copy all of it for each token."""
    sanitize.sanitize(spark.createDataFrame([(1, "x")], "id int, html string")).explain()
    assert "aggregate(" not in capsys.readouterr().out


def test_a_page_of_many_blocks(spark):
    blocks = "".join(f"loose {i} <em>e</em><p>block {i}</p>" for i in range(3_000))
    found = sanitize.sanitize(spark.createDataFrame([(1, blocks)], "id int, html string")).first()["html"]
    assert found == "".join(f"<p>loose {i} <em>e</em></p><p>block {i}</p>" for i in range(3_000))
