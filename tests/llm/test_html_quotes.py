"""Stray quotes in tags are part of names and unquoted values."""

import pytest

from serixa.llm.html_text import render


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p title=it's>Hello", "Hello"),
        ('<a href="x"">see</a> rest', "see rest"),
        ('<img alt=5">one</p><p>two <b class="k">three</b>', "one\n\ntwo three"),
        ("<p title = 'a > b' hidden>x</p>y", "y"),
        ('<p a= title="x>y">z', 'y">z'),
        ('<p a=>b <i "c>d</i>', "b d"),
        ('a<p title="never ends>b', "a"),
        ('<p style=x"y hidden>a</p>b', "b"),
        ("<p/title='q'/>x", "x"),
    ],
)
def test_stray_quotes(source, text):
    assert render(source) == text
