import pytest

from trajecta.llm import html_extract

TEXT = "the story has many words and it goes on for a while so that it is the main text of this page"
HEAD = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("wrapper", ["div class='no-sidebar'", "div class='content-sidebar-wrap'", "div id='with-comments'", "div class='sidebar'", "div data-id='search'", "form", "section title='a class=ad'"])
def test_wrappers_keep_the_article(model, wrapper):
    page = f"{HEAD}<{wrapper}><article><h1>Title</h1><p>{TEXT}</p></article></{wrapper.split()[0]}></body></html>"
    assert model.extract(page) == f"Title\n{TEXT}"


@pytest.mark.parametrize("heading", ["related-work", "login-flow", "search", "comments"])
def test_heading_ids(model, heading):
    page = f"{HEAD}<article><p>{TEXT}</p><h2 id='{heading}'>Heading</h2><p>{TEXT}</p></article></body></html>"
    assert model.extract(page) == f"{TEXT}\nHeading\n{TEXT}"


def test_sections_with_a_heading_and_a_paragraph(model):
    section = f"<section id='search'><h2>Heading</h2><p>{TEXT}</p></section>"
    assert model.extract(f"{HEAD}<article><p>{TEXT}</p>{section}</article></body></html>") == f"{TEXT}\nHeading\n{TEXT}"
    assert model.extract(f"{HEAD}{section}</body></html>") == f"Heading\n{TEXT}"
    assert model.extract(f"{HEAD}<form><h2>Heading</h2><p>{TEXT}</p></form></body></html>") == f"Heading\n{TEXT}"


def test_other_text_still_goes(model):
    after = f"<section class='comments'><h2>Replies</h2><p>{TEXT}</p></section><div class='related posts'><p>{TEXT}</p></div><div id='cookie-notice'><p>{TEXT}</p></div>"
    page = f"{HEAD}<article><h1>Title</h1><p>{TEXT}</p><div class='ad'>Buy this</div></article>{after}</body></html>"
    assert model.extract(page) == f"Title\n{TEXT}"
