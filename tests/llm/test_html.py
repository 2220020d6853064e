import pytest

from serixa.llm.html_text import extract, render


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("a<b>b</b>c <i> d</i>", "abc d"),
        ("<title>t</title><style>p{}</style><script>var x='</p>';</script>x", "x"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<table><tr><th>id<th>name<tr><td>1<td>long name<tr><td colspan=2>all</table>", "id  name\n1   long name\nall"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<p hidden>a</p><p style='display: none'>b</p><div style='x:y'>c</div>", "c"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a<!-- x --> b <!doctype q> 1 < 2 </unknown> c", "a b 1 < 2 c"),
        ("x <a href='never ends", "x"),
        ("</p></td>x<b><p>y</b>z", "x\n\nyz"),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
        ("<table><tr><td><table><tr><td>in</table>after</table>", "in\n\nafter"),
        ("<div hidden><span>a</div>b", "b"),
        ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_render(source, text):
    assert render(source) == text


def test_odd_pages(spark, sf_dir):
    deep = "<div>" * 20000 + "x"
    rows = [(1, deep, "u"), (2, None, "u"), (None, "<p>y", None), (3, "<a " * 50000, "u"), (4, "</td>" * 1000 + "<td>" * 1000 + "z", "u"), (1, deep, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "x"), (1, "x"), (2, ""), (None, "y"), (3, ""), (4, "z")], key=str)
    assert extract(df.where("page_id < 0")).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert extract(pages).where("n_chars > 0").count() == pages.count()
