"""Pages put together from known parts, odd markup, and pages that fail a whole test."""

import random
import time

import pytest

from evspark.llm.html_main import blocks_of, main_text

ENGLISH = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there".split()


def sentence(r, words=None, n=None):
    own = words or ENGLISH
    return " ".join(r.choice(own) if r.random() < 0.5 else "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(n or r.randint(20, 60))) + "."


@pytest.mark.parametrize("seed", range(40))
def test_articles_come_back_whole(seed):
    r = random.Random(seed)
    want, parts = [], []
    for _ in range(r.randint(2, 9)):
        kind = r.choice(["p", "p", "p", "h2", "li", "blockquote", "td", "math"])
        text = sentence(r, n=r.randint(2, 6) if kind in ("h2", "li", "td") else None)
        want.append(text)
        shown = text.replace(" ", r.choice([" ", "\n  ", "&#32;"]), 1).replace("a", "&#x61;", 1)
        parts.append({"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "math": "<p><math><mi>{}</mi></math></p>"}.get(kind, f"<{kind} class=x>{{}}</{kind}>").format(shown))
    junk = ["<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<aside>" + sentence(r) + "</aside>", "<div class='cookie-banner'><p>" + sentence(r) + "</p></div>",
            "<form><p>" + sentence(r) + "</p><input></form>", "<footer><p>" + sentence(r) + "</p></footer>", "<script>if (a < b) { x('<p>no</p>') }</script>", "<style>p > a {}</style>"]
    inner = [*parts, "<!-- <p>no</p> -->"]
    inner.insert(r.randrange(len(inner)), r.choice(["<div class='ad'><p>" + sentence(r) + "</p></div>", "<div hidden>" + sentence(r) + "</div>"]))
    page = "<html><head><title>t</title></head><body>" + "".join(r.sample(junk, 4)) + "<article>" + "".join(inner) + "</article>" + "".join(r.sample(junk, 3)) + "</body></html>"
    assert main_text(page).split("\n") == want


def test_pages_that_fail_as_a_whole():
    r = random.Random(1)
    finnish = [sentence(r, "ja on ei se että hän oli mutta niin kuin".split()) for _ in range(3)]
    english = [sentence(r) for _ in range(3)]
    menu = "<nav><a href=/>Etusivu</a></nav><footer>(c) kukaan</footer>"
    paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    assert main_text(f"<body>{menu}<div>{paragraphs(finnish)}</div></body>").split("\n") == finnish
    assert main_text(f"<body>{menu}<form action=/>{paragraphs(english)}</form></body>").split("\n") == english
    assert main_text(f"<body>{menu}<div class='sidebar'>{paragraphs(english)}</div></body>").split("\n") == english
    assert main_text(f"<body><div class='content has-sidebar'>{paragraphs(english)}</div><div class='sidebar'><p>{sentence(r)}</p></div></body>").split("\n") == english
    assert main_text(f"<body>{menu}<p>Lyhyt.</p><p>Toinen.</p></body>").split("\n") == ["Lyhyt.", "Toinen."]
    assert main_text("<nav><a href=/>x</a></nav>") == "" and main_text("") == main_text(None) == ""


@pytest.mark.parametrize("page", ["<a b " * 40000, '<a b" ' * 40000 + ">", "<p>x " * 20000, "<div>" * 20000 + "</p></ul>" * 20000, "<head>" * 20000, "<" * 100000 + ">", "<!-- " * 40000, "<script>" * 20000])
def test_markup_without_end_takes_linear_time(page):
    began = time.process_time()
    blocks_of(page)
    main_text(page)
    assert time.process_time() - began < 5


def body(*inner, before="<nav><a href=/>Home</a></nav>", after="<footer>(c) nobody</footer>"):
    r = random.Random(3)
    first, last = sentence(r), sentence(r)
    page = f"<body>{before}<article><p>{first}</p>{''.join(inner)}<p>{last}</p></article>{after}</body>"
    return [x for x in main_text(page).split("\n") if x not in (first, last)]


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>See <a href=/x>the long and patient guide to all the bridges of the town</a> too.</p>", ["See the long and patient guide to all the bridges of the town too."]),
        ("<ul><li><a href=/a>First source</a></li><li><a href=/b>Second source</a></li></ul>", ["First source", "Second source"]),
        ("<h2><a href=#x>Linked heading</a></h2>", ["Linked heading"]),
        ('<h2 class="section-header">A heading</h2>', ["A heading"]),
        ('<div class="entry-header"><h1>The headline</h1></div>', ["The headline"]),
        ('<div class="related-work"><p>Others have looked at this.</p></div>', ["Others have looked at this."]),
        ('<div class="side-by-side"><p>Two pictures of one bridge.</p></div>', ["Two pictures of one bridge."]),
        ('<section id="legal"><p>The law of bridges is old.</p></section>', ["The law of bridges is old."]),
        ('<p class="share-price">The price rose to 5 on that day.</p>', ["The price rose to 5 on that day."]),
        ("<header><h1>The headline</h1></header>", ["The headline"]),
        ('<div class="grid hidden md-block"><p>Shown on large screens.</p></div>', ["Shown on large screens."]),
        ("<div hidden><p>Never shown to anyone at all.</p></div>", []),
        ("<div data-x='y' HIDDEN><p>Never shown to anyone at all.</p></div>", []),
        ('<div style="display: none"><p>Never shown.</p></div>', []),
        ('<div class="related-posts"><a href=/a>Another story</a> <a href=/b>A third story</a></div>', []),
        ('<div class="share-buttons"><a href=/f>Share</a> <a href=/t>Tell</a></div>', []),
        ('<div class="comment-list"><p>I do not agree with this at all, and that is that.</p></div>', []),
        ('<section id="comments"><p>Nice text.</p></section>', []),
        ('<div class="newsletter-box"><p>Get our letter every week.</p></div>', []),
        ("<aside><p>An aside of some length that says little.</p></aside><footer>By nobody.</footer>", []),
    ],
)
def test_names_and_links_inside_an_article(inner, want):
    assert body(inner) == want


def test_names_outside_articles_still_decide():
    r = random.Random(4)
    text = [sentence(r) for _ in range(3)]
    rest = "".join(f"<div class='{c}'><p>{sentence(r)}</p></div>" for c in ("site-header", "left-sidebar", "post-comments", "page-footer"))
    page = f"<body>{rest}<h2 class='section-header'>A heading</h2>" + "".join(f"<p>{t}</p>" for t in text) + "</body>"
    assert main_text(page).split("\n") == ["A heading", *text]
