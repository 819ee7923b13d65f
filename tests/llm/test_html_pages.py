"""Whole pages with their exact main text: names that mislead, names in one word, foreign elements."""

import pytest

from ashlar.llm import html

LONG = "The river rose in the night, and the town waited; nobody knew how long it would last, or why. "
P = [LONG * 2 + f"Part {i}." for i in range(5)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in P)
BODY = "\n".join(P)
MENU = "<div><ul>" + "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(8)) + "</ul></div>"


def page(*parts):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(parts)}</body></html>"


def article(inner):
    return page(MENU, f"<div><h1>Title</h1>{inner}</div>", MENU)


INSIDE = {  # elements within the article that belong to it, by a name that has a skip word
    "section id='related-work'": "Work that came before it was wide, and is told here in full. ",
    "p class='notice-period'": "The period of notice is three months, as the law says. ",
    "p class='search-result'": "The search had one result, and it was found at dawn. ",
    "p class='share-price'": "The price of a share fell by half, and then rose again. ",
    "p id='cookie-recipe'": "Take flour, butter and sugar; bake for ten minutes. ",
    "p class='social-history'": "The history of the valley is one of work, and of water. ",
    "p class='legal-history'": "The court sat twice, in spring and in autumn. ",
    "p class='adverb'": "Slowly, the boats came back, one after another. ",
    "p class='has-sidebar-note'": "A note, and nothing but a note, was left behind. ",
}
OUTSIDE = {  # elements that do not, however their names are written
    "ol class='commentlist'": "<li>Great text, thanks!</li><li>I do not agree, sorry.</li>",
    "div class='cookiebar'": "We use cookies on this site, as others do. Accept?",
    "div id='comments-area'": "<p>First, as always, and proud of it, I am.</p>",
    "div class='siteFooter'": "Contact, imprint, terms and more, all here.",
    "div class='ad-slot ad-slot-2'": "Buy now, pay later, smile always, they say.",
    "div class='related-posts'": "<p>Read also: another text, and a third one.</p>",
    "div class='newsletter-signup'": "Sign up, get a letter, every week, for free.",
    "div class='shareButtons'": "Share it, like it, send it, print it.",
    "aside": "By the way, this is no part of it, at all.",
    "form": "Name, mail, text, send.",
    "div role='navigation'": "Home, up, next, last.",
    "div hidden": "Not seen, not read, not kept.",
    "div class='sidebar_right'": "On the right, a box, with more, and more.",
    "div class='loginform'": "Name, word, enter, forgot?",
}


@pytest.mark.parametrize("name", INSIDE)
def test_named_parts_of_the_article_stay(name):
    tag = name.split()[0]
    text = INSIDE[name] * 3
    inner = f"<p>{text}</p>" if tag == "section" else text
    assert html.extract(article(f"<p>{P[0]}</p><{name}>{inner}</{tag}><p>{P[1]}</p><p>{P[2]}</p>")) == "\n".join(["Title", P[0], text.strip(), P[1], P[2]])


@pytest.mark.parametrize("name", OUTSIDE)
def test_what_is_no_article_goes(name):
    tag = name.split()[0]
    assert html.extract(article(f"{PARAGRAPHS}<{name}>{OUTSIDE[name]}</{tag}>")) == f"Title\n{BODY}"
    assert html.extract(page(MENU, f"<div><h1>Title</h1>{PARAGRAPHS}</div><{name}>{OUTSIDE[name]}</{tag}>")) == f"Title\n{BODY}"


@pytest.mark.parametrize("empty", ["<svg class='x'/>", "<math/>", "<svg viewBox='0 0 1 1' />", "<svg><path d='M0'/></svg>", "<math><mi>x</mi></math>"])
def test_foreign_elements_lose_nothing(empty):
    assert html.extract(article(f"<p>{P[0]}</p>{empty}<p>{P[1]}</p><p>{P[2]} {empty}</p>{PARAGRAPHS}")) == "\n".join(["Title", *P[:3], BODY])


def test_line_of_rights_at_the_end():
    for line in ("Copyright 2020 Corp.", "© 2021 The Town. All rights reserved.", "(c) 1999 A. B."):
        assert html.extract(page(f"<main><h1>Title</h1>{PARAGRAPHS}<div>{line}</div></main>")) == f"Title\n{BODY}"
    assert html.extract(page(f"<main><p>Copyright law is old.</p>{PARAGRAPHS}</main>")) == f"Copyright law is old.\n{BODY}"
    assert html.extract("Copyright 2020") == "Copyright 2020"
