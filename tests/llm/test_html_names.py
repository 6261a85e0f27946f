import duckdb
import pytest

from fernsieve.llm import html_text
from fernsieve.llm.html_text import main_text

STORY = [f"Sentence number {k} of the story goes on for a while, so that it is a line of prose like others." for k in range(5)]
PROSE = "".join(f"<p>{x}</p>" for x in STORY)
NAV, FOOT = "<nav><a href=x>Home</a><a href=y>News</a></nav>", "<footer>&copy; somebody, all rights reserved, in a rather long line of text here</footer>"


def page(body):
    return f"<html><body>{NAV}{body}{FOOT}</body></html>"


@pytest.mark.parametrize("element", ["<div class='post social'>{}</div>", "<section id='related-work'>{}</section>", "<div class='entry no-comments'>{}</div>", "<main role='banner'>{}</main>", "<div>{}</div>"])
def test_a_story_is_found_whatever_its_element_is_called(element):
    assert main_text(page(element.format(PROSE))).split("\n") == STORY


def test_named_parts_of_a_page_with_a_story_go():
    comments = "<div id=comments>" + "<p>I liked this very much and wrote a long comment about it, longer than the story's lines are.</p>" * 9 + "</div>"
    notice = "<div class='cookie-notice'>We use something here, and say so in a long sentence that is as dense as any other.</div>"
    for body in (f"<article>{PROSE}</article>{comments}", f"{notice}<article>{PROSE}{comments}<div class=share><a>tweet</a></div></article>", f"<div>{PROSE}</div><aside><p>{STORY[0]}</aside>{notice}"):
        assert main_text(page(body)).split("\n") == STORY
    assert main_text(page("")) == main_text(page(notice)) == "" and main_text(page(f"<p>{STORY[0]}</p>")) == STORY[0]


def test_the_headline_in_an_articles_header_stays():
    body = f"<article><header><h1>Head line</h1><a>by somebody</a></header>{PROSE}</article><header><h1>Site</h1></header>"
    assert main_text(page(body)).split("\n") == ["Head line", *STORY]


def test_the_threshold_decides_what_furniture_goes(monkeypatch):
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' WHERE html LIKE '%<article>%'").fetchall()]
    texts = list(map(main_text, pages))
    assert all("class=\"ad\"" in h and "©" not in t for h, t in zip(pages, texts))
    monkeypatch.setattr(html_text, "threshold", lambda ratios: -1.0)
    assert all(main_text(h) != t for h, t in zip(pages, texts))
