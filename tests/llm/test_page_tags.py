"""The scanner of tags: what it finds, and that its time is linear in pages that are broken in every way."""

import time

import pytest

from trajecta.llm import html_extract as he


def found(page):
    return [("/" if t.close else "") + t.name + t.attributes for t in he.tags(page)]


def test_tags():
    assert found("<p><a title=it's href=x>text</a></P>") == ["p", "a title=it's href=x", "/a", "/p"]
    assert found("<b class = 'x>y' z>q<i a=>1<u =b>2<input value=\"a>b\"/><br/>") == ["b class = 'x>y' z", "i a=", "u =b", 'input value="a>b"/', "br/"]
    assert found('<x y="unclosed>t<p>') == ['x y="unclosed', "p"]
    assert found("a < b <1> <!-- <p> --> <!doctype html><?x y?> <script>if (a<b) '</p>'</script ><style>p>a</style><![CDATA[ <p> ]]><q>") == ["", "", "", "", "", "", "q"]
    assert found("<p") == [] and found("") == [] and found("<!-- open <p>") == [""] and found("<script>x<p>") == [""] and found("<p a='1' b>") == ["p a='1' b"]
    assert [(t.start, t.end) for t in he.tags("ab<p x>c</p>")] == [(2, 7), (8, 12)]


def test_an_apostrophe_loses_no_text():
    page = "<article><h1>Head of it</h1><p>Before all <a title=it's href=x>a link</a> after.</p><p>And one more paragraph.</p></article>"
    text = "".join(t.text for t in he.tokens(page))
    assert "Before all " in text and "a link" in text and " after." in text and "And one more paragraph." in text


@pytest.mark.parametrize("part", ["<script ", "<a ", '<a href="x ', "<? ", "<a b='", "<!--", "<a =", "<a x= ", "</", "<p title=it's ", '<a "', "<style>", "<![CDATA[", "<a b=\"c' ", "<div>", "<table><tr><td>", "&amp;&"])
@pytest.mark.parametrize("tail", ["", "\"'>"])
def test_a_broken_page_of_a_megabyte(part, tail):
    page = part * (1_000_000 // len(part)) + tail
    start = time.process_time()
    he.tags(page)
    assert time.process_time() - start < 3
