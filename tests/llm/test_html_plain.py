"""Rendering against plain versions: the visible words by another parser, and tables laid out cell by cell."""

import random
from html.parser import HTMLParser

import pytest

from serixa.llm import queries
from serixa.llm.html_text import render

GONE = {"head", "script", "style", "template", "title", "noembed", "noframes", "iframe", "datalist", "object", "audio", "video", "canvas"}
VOID = {"br", "hr", "img", "meta", "link", "input", "wbr"}
APART = set("p h1 h2 div article nav footer ul ol li table tr td th br hr body html section blockquote details summary dialog pre".split())


class Words(HTMLParser):
    """Words of what is not within an invisible element; well-formed nesting is taken for granted but for p and li."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        style = known.get("style") or ""
        if tag in APART and not any(gone for _, gone, _ in self.stack) and not ("hidden" in known or "display:none" in style):
            self.out.append(" ")
        if tag in VOID:
            return
        self.stack.append((tag, tag in GONE or "hidden" in known or "display:none" in style, "hidden" if "visibility:hidden" in style else "visible" if "visibility:visible" in style else ""))

    def handle_endtag(self, tag):
        if tag in APART and not any(gone for _, gone, _ in self.stack):
            self.out.append(" ")
        if any(t == tag for t, *_ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        seen = [v for *_, v in self.stack if v]
        if not any(gone for _, gone, _ in self.stack) and (not seen or seen[-1] == "visible"):
            self.out.append(data)


def words(source):
    parser = Words()
    parser.feed(source or "")
    parser.close()
    return "".join(parser.out).split()


def test_words_of_all_pages(spark, sf_dir):
    """Every page: the rendered words are those of the plain version, bullets aside."""
    pages = {r.page_id: r.html for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet").collect()}
    found = {r.page_id: r.text for r in queries.op10_html_text(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    assert set(found) == set(pages) and len(pages) > 100
    for i, source in pages.items():
        assert [w for w in found[i].split() if w != "-"] == words(source)


def soup(r, depth=0):
    if depth > 5 or r.random() < 0.3:
        return " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 4)))
    inner = "".join(soup(r, depth + 1) for _ in range(r.randint(0, 4)))
    tag = r.choice(["div", "section", "b", "i", "span", "blockquote", "em", "script", "template"])
    if tag == "script":
        return "<script>var a='<p>x</p>';</script>"
    more = r.choice(["", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'", " class=x"])
    return f"<{tag}{more}>{inner}</{tag}>" + r.choice(["", " ", "<br>", "<!-- c -->"])


def test_words_of_nested_elements():
    r = random.Random(6)
    for _ in range(600):
        source = "".join(soup(r) for _ in range(3))
        assert render(source).split() == words(source), source


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\n   D  E"),
        ("<table><tr><td>x<td rowspan=2 colspan=2>yy<td>z<tr><td>u<td>v</table>", "x  yy  z\nu      v"),
        ("<table><tr><td rowspan=3>long<td>b<tr><td>c</table>after", "long  b\n      c\n\nafter"),
        ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>d", "b\n\nd"),
        ("a<dialog>b</dialog>c<dialog open>d</dialog>e", "ac\nd\ne"),
        ("<details>x<summary>s</summary><p>y</p><summary>t</summary></details>z", "s\nz"),
        ("<details open><summary>s</summary>y</details>z", "s\ny\nz"),
        ("<details><details><summary>n</summary>m</details><summary>s</summary></details>z", "s\nz"),
        ("<p title=it's>Hello</p>", "Hello"),
    ],
)
def test_spans_and_visibility(source, text):
    assert render(source) == text


def test_tables_cell_by_cell():
    """Random grids of spans: every cell's text begins in the column that a plain grid gives it."""
    r = random.Random(3)
    for _ in range(200):
        rows = [[(f"c{y}x{x}" + "q" * r.randint(0, 3), r.choice([1, 1, 1, 2]), r.choice([1, 1, 2, 3])) for x in range(r.randint(1, 4))] for y in range(r.randint(1, 5))]
        source = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}" for t, c, d in row) for row in rows) + "</table>"
        grid, at = {}, {}
        for y, row in enumerate(rows):
            x = 0
            for t, c, d in row:
                while (y, x) in grid:
                    x += 1
                for i in range(d):
                    for j in range(c):
                        grid.setdefault((y + i, x + j), t)
                at[t] = (y, x)
                x += c
        lines = render(source).split("\n")
        begins = {}
        for t, (y, x) in at.items():
            begins.setdefault(x, set()).add(lines[y].index(t))
        assert all(len(v) == 1 for v in begins.values()), source
        order = [next(iter(begins[x])) for x in sorted(begins)]
        assert order == sorted(set(order))
