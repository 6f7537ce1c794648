import html
import re
import time

import pytest

from lamina.llm.html_extraction import extract_pages, extract_text


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("   ", ""), ("only text, no tag", "only text, no tag"), ("<!-- never closed", ""), ("<p", ""),
    (page("<article><p>One,\n  two.<p>Three &lt;b&gt; &eacute;&#33;</article>"), "One, two.\nThree <b> é!"),
    (page("<nav><a href=/a>Menu</a></nav><div class='x'><p>Body, with commas, here.</p></div><footer>foot</footer>"), "Body, with commas, here."),
    (page("<article><p>Kept, kept.</p><div id='comments'><p>Great post, really, truly great.</p></div></article>"), "Kept, kept."),
    (page("<main><p>a, b</p><aside><p>side, side, side</p></aside><form><p>form, form</p></form><p>c</p></main>"), "a, b\nc"),
    (page("<div><p>a, b, c</p></div><script>var p = '<p>no</p>';</script><style>p{}</style>"), "a, b, c"),
    (page("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>p  q\n r</pre></article>"), "x\ny\n1\n2\np q r"),
    (page("<article><p>line<br>next <b>bold <a href='#'>link</a></p></article>"), "line next bold link"),
    (page("<article><p>a, b, c.</p></article><article><p>d, e, f.</p></article>"), "a, b, c.\nd, e, f."),
    (page("<div class='cookie-notice'><p>We use cookies, many cookies, for all purposes, always.</p></div><div><p>Short.</p></div>"), "Short."),
    (page("<div><p>Text, of the page.</p><ul><li><a href='1'>One</a><li><a href='2'>Two</a></ul></div>"), "Text, of the page."),
    (page("<ARTICLE><P>Upper</P></ARTICLE>"), "Upper"),
    (page("<div class='post no-sidebar' data-id='nav'><p title='hidden gems, role=search'>Body, kept.</p><p hidden>gone</p></div>"), "Body, kept."),
    (page("<div class=content><p>Text, here.</p><div class='ad'>Buy, buy, buy.</div><p style='display: none'>gone</p></div>"), "Text, here."),
])
def test_text_of_a_page(source, text):
    assert extract_text(source) == text


@pytest.mark.parametrize("source", ["<div><p>x</p>" * 5000, "<b>x</i>" * 30000, '<a href="q>' * 5000, "<" * 100000, "<p><b>x</p>" * 20000])
def test_odd_pages_take_linear_time(source):
    started = time.process_time()
    extract_text(source)
    assert time.process_time() - started < 5


def test_given_pages_give_the_paragraphs_of_their_article(spark, sf_dir):
    import __spark_entry__ as entry

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = entry.queries()["op1_html"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    for row in found:
        inside = re.search(r"<article>(.*?)</article>", pages[row["page_id"]]["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", part)).split()) for part in re.split("</?(?:h1|p)>", inside))
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_rows_stay(make):
    rows = [(1, "<p>a", "u", "old"), (1, "<p>a", "u", "old"), (None, None, None, None)]
    found = extract_pages(make(rows, "page_id long, html string, url string, text string"))
    assert sorted(map(str, (r.asDict() for r in found.collect()))) == sorted(map(str, [
        {"text": "a", "page_id": 1, "url": "u"}, {"text": "a", "page_id": 1, "url": "u"}, {"text": "", "page_id": None, "url": None}]))
    assert extract_pages(make([], "page_id long, html string")).collect() == []


BODY = "".join(f"<p>Sentence {n} of the story, with a clause, another one, and some more words to fill the line.</p>" for n in range(40))


@pytest.mark.parametrize("before, after, kept", [
    ("<h1>Headline</h1><p>The lead, short.</p>", "<p>The closing words.</p>", ["Headline", "The lead, short.", "The closing words."]),
    ("<h1>Headline</h1><div class=lead><p>A lead in a box of its own, as long as one line of the story.</p></div>", "",
     ["Headline", "A lead in a box of its own, as long as one line of the story."]),
    ("<pre>code</pre><blockquote>Quoted, by someone.</blockquote>", "<h2>Notes</h2><p>First note.</p>", ["code", "Quoted, by someone.", "Notes", "First note."]),
    ("<p><a href=/>Home</a> <a href=/a>All</a></p>", "<h3>More stories</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>", []),
    ("Bare text, not in a paragraph.", "", ["Bare text, not in a paragraph."]),
])
def test_what_stands_beside_the_body(before, after, kept):
    found = extract_text(page(f"<div id=content>{before}<div class=body>{BODY}</div>{after}</div>")).split("\n")
    assert [x for x in found if not x.startswith("Sentence ")] == kept and len(found) == len(kept) + 40


def test_linked_paragraphs_of_an_article_stay():
    assert extract_text(page("<article><p>One, two.</p><p><a href=x>All of this is a link</a></p></article>")) == "One, two.\nAll of this is a link"


def test_names_of_given_columns_meet_no_others(make):
    pages = make([(1, "<p>one</p>", "a", "b")], "page_id long, html string, _html string, text string")
    found = extract_pages(pages)
    assert found.columns == ["text", "page_id", "_html"] and tuple(found.first()) == ("one", 1, "a")


STORY = "".join(f"<p>Sentence {n} of the story, with a clause, another one, and some more words to fill the line.</p>" for n in range(15))
COMMENTS = "".join(f"<div class=c><p>Reader {n} says that this is, all in all, a fine story, thank you very much.</p></div>" for n in range(10))


@pytest.mark.parametrize("source, extra", [
    (f"<div class='post category-social-science tag-notice'><h1>H</h1>{STORY}</div>", ["H"]),
    (f"<article>{STORY}<section class=related-work><p>Earlier work, by others, treats the same question at some length.</p></section></article>",
     ["Earlier work, by others, treats the same question at some length."]),
    (f"<div class=c><div>{STORY}</div><div class=notice-period><p>The period of notice, as agreed before, is three months.</p></div></div>",
     ["The period of notice, as agreed before, is three months."]),
    (f"<div class=sidebar-layout><article>{STORY}</article><div class=sidebar><p>More, much more, of the same kind.</p></div></div>", []),
    (f"<div class=widget-wrap><h1>H</h1>{STORY}</div><div><p>Elsewhere.</p></div>", ["H"]),
    *[(f"<main>{STORY}<div class='{name}'>{COMMENTS}</div></main>", []) for name in (
        "commentlist", "usercomments", "reader-feedback", "adbox", "sidenav", "cookiebar", "comments-area", "related-posts", "cookie-notice")],
    (f"<div>{STORY}</div><div class=related-reading-tips><a href=1>One more story, to read</a><a href=2>And another one</a></div>", []),
])
def test_marks_give_way_to_the_article(source, extra):
    found = extract_text(page(source)).split("\n")
    assert sum(x.startswith("Sentence ") for x in found) == 15
    assert sorted(x for x in found if not x.startswith("Sentence ")) == sorted(extra)
