"""Pages as texts with TeX, on hand-made pages."""

from __future__ import annotations

import pytest

from strataloom.operators import markup as op

MATH = '<math id="m" alttext="a+b"><mi>a</mi><annotation encoding="application/x-tex">x &lt; y</annotation></math>'


@pytest.mark.parametrize(
    ("html", "text", "kinds"),
    [
        (f"p {MATH} q", "p \n\n\\[x < y\\]\n\n q", [("html_equation", "decoded", "x < y")]),
        ('<math alttext="a+b"><mi>a</mi></math>', "\n\\[a+b\\]\n", [("html_equation", "decoded", "a+b")]),
        ("<math><mi>a&amp;</mi></math>", "\n<math><mi>a&amp;</mi></math>\n", [("html_equation", "unresolved", "<math><mi>a&amp;</mi></math>")]),
        ("<h2>A <b>b</b></h2>x", "\n## \nA \nb\nx", [("html_heading", None, "A b")]),
        ('<a href="/t">one <i>two</i><img alt="no"></a><a>bare</a>', "[one two](/t)\nbare", [("html_reference", None, "one two")]),
        ('<img src="s"><img alt="">', "[Image: not transcribed]\n[Image: ]", [("html_image", "unresolved", ""), ("html_image", "unresolved", "")]),
        ("<body>out<nav><h1>no</h1></nav><article>in<article>deep</article>too</article><article>second</article></body>", "in\ndeep\ntoo", []),
        ("<head><title>t</title></head><body>b<script>1<2</script></body>after", "b", []),
        ('<h1>open <a href="x">link', "\n# \nopen \n[link](x)", [("html_heading", None, "open link"), ("html_reference", None, "link")]),
        ("<style>x</style><footer>y<footer>z</footer></footer>end", "end", []),
        ("", "", []),
        (None, "", []),
    ],
)
def test_pages(html, text, kinds):
    got, found = op.parse(html)
    assert got == text
    assert [(f["kind"], f["status"], f["text"]) for f in found] == kinds


def test_prepared_rows(spark):
    rows = op.prepared(spark.createDataFrame([(1, f'<h3 id="h">T</h3>{MATH}', "x"), (2, None, "y")], "page_id long, html string, text string")).orderBy("page_id").collect()
    assert [(f.kind, f.element_id, f.level) for f in rows[0].found] == [("html_heading", "h", 3), ("html_equation", "m", None)]
    assert rows[1].text == "" and rows[1].found == []
    assert op.prepared(spark.createDataFrame([], "page_id long, html string")).count() == 0
    long = op.parse("<p>" + "word <b>x</b> " * 200_000)[0]
    assert long.count("x") == 200_000
