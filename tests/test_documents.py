"""Registry documents and names in texts, against plain Python."""

import random

from pyspark.sql import functions as F

from quarrystone.sources import documents

PAGE = """<p>[1] One</p><p>no [2] ref</p><ol><li>[2] Two <b>bold</b><li>[3]Three</ol><li>[1] Uno</li>
<table><tr><td>a</td><td>b</td><td>c</td></tr></table>
<table><tr><th>Name</th><th>x</th><th>y</th></tr>
<tr><td> Alpha  set </td><td><table><tr><td>1</td></tr><tr><td>2</td></tr></table></td><td>see [2], [1] and [2]; [9]</td></tr>
<tr><td>Beta</td><td>q<td>unclosed [3]
<tr><td>short</td><td>row</td></tr></table>"""


def test_entries_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE, "alpha SET of things", 5), (2, "", "x", 5), (3, None, "x", 5), (4, "<table>", "x", 5), (5, "<td>x</td></table></p>", "x", 5)], "id int, html string, project string, row int")
    got = sorted((r["name"], r["description"], r["augmented"]) for r in documents.entries(pages.drop("row"), "id", "html").collect())
    assert got == [
        ("Alpha set", "see [2], [1] and [2]; [9]", "see [2], [1] and [2]; [9]\n\nReferences:\n[1]: Uno\n[2]: Two bold"),
        ("Beta", "unclosed [3]", "unclosed [3]\n\nReferences:\n[3]: Three"),
    ]
    some = documents.entries(pages.drop("row"), "id", "html", F.col("project")).collect()
    assert [r["name"] for r in some] == ["Alpha set"]


def test_names_in_texts_by_both_ways(spark):
    r = random.Random(5)
    draw = lambda a, b: "".join(r.choices("abÉ中 ", k=r.randint(a, b)))
    names = [draw(1, 12) for _ in range(60)] + [None, "", "a", "a", "abc" * 5]
    texts = [draw(0, 60) for _ in range(80)] + [None, "", "abc" * 5, "a"]
    n = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    t = spark.createDataFrame(list(enumerate(texts)), "k2 long, text string")
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(texts) if a and b is not None and a in b}
    for most in (1 << 20, 0):
        got = [tuple(x) for x in documents.names_in_texts(n, t, "k", "name", "k2", "text", most_chars=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert documents.names_in_texts(n.limit(0), t, "k", "name", "k2", "text").count() == 0
