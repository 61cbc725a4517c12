import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from trialscope.llm.html import extract, main_text


class Tree(HTMLParser):
    """An independent reading of well-formed pages by the standard library's parser: the blocks of the article, without
    elements that are never text or have an unwanted class."""

    BLOCKS = {"html", "head", "body", "div", "nav", "ul", "li", "p", "h1", "h2", "article", "main", "footer", "section", "aside", "table", "tr", "blockquote"}
    GONE = {"script", "style", "title", "nav", "footer", "aside", "form"}
    VOID = {"meta", "br", "img", "hr", "link"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], ""
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if x := " ".join(self.now.split()):
            self.blocks.append(x)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.now += " " if self.live() else ""
        if tag not in self.VOID:
            self.stack.append((tag, tag in self.GONE or dict(attrs).get("class") in ("ad", "comments", "cookie-notice")))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def live(self):
        return any(t in ("article", "main") for t, _ in self.stack) and not any(gone for _, gone in self.stack)

    def handle_data(self, data):
        if self.live():
            self.now += data


def made_page(rng):
    words = lambda n: " ".join(rng.choice(["plain", "words", "&amp;", "caf&eacute;", "<b>bold</b>", "<a href='/x'>link</a>", "a<br>b", "&#x41;", "12 &lt; 13"]) for _ in range(n))
    block = lambda: rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<section class='has-menu'><p>{}</p></section>"]).format(words(rng.randrange(0, 30)))
    junk = lambda: rng.choice(["<div class='ad'>{}</div>", "<aside>{}</aside>", "<div class='comments'><p>{}</p></div>", "<form>{}</form>", "<script>var x='{}</p>';</script>", "<!-- {} -->", "<div class='cookie-notice'><p>{}</p></div>"]).format("buy this " * rng.randrange(30))
    inner = "".join(rng.choice([block, block, junk])() for _ in range(rng.randrange(1, 12)))
    wrap = rng.choice(["{}", "<div class='content has-sidebar'>{}</div>", "<div class='layout with-widgets'>{}</div>", "<div class='post no-comments'>{}</div>", "<div id='page'>{}</div>"])
    main = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(inner)
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>menu</li></ul></nav>{junk()}{wrap.format(main)}{junk()}<footer>foot</footer></body></html>"


def test_against_another_parser():
    rng = random.Random(3)
    for _ in range(600):
        page = made_page(rng)
        assert main_text(page).split("\n\n") == (Tree(page).blocks or [""]), page


def test_given_pages_against_another_parser():
    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    for page in pq.read_table(path).column("html").to_pylist():
        assert main_text(page) == "\n\n".join(Tree(page or "").blocks)


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "post no-comments", "layout with-widgets", "no-menu", "page sidebar", "menu-open", "widget"])
def test_wrappers_of_the_article(wrapper):
    body = "<article><p>" + "plain words " * 40 + "</p></article>"
    talk = "<div class='comments'><article><p>" + "said so " * 400 + "</p></article></div>"
    want = ("plain words " * 40).strip()
    assert main_text(f"<body><div class='{wrapper}'>{body}{talk}</div></body>") == want
    assert main_text(f"<body><div id='{wrapper}'><main>{body}</main></div>{talk}</body>") == want


@pytest.mark.parametrize("form", ['<form id="aspnetForm" method=post>', "<form>", '<form class="page">'])
def test_a_form_around_the_page_is_a_wrapper(form):
    body, controls = "plain words " * 40, '<label>Your name</label><input name=a><select><option>x</select><button>Go</button><textarea>t</textarea>'
    want = body.strip()
    for main in (f"<main><p>{body}</p></main>", f"<article><p>{body}</p></article>", f"<div><p>{body}</p></div>"):
        assert main_text(f"<body>{form}<nav>menu</nav>{controls}{main}<footer>f</footer></form></body>") == want
        assert main_text(f"<body><form><p>Search the site</p>{controls}</form>{main}<form><p>Subscribe</p></form></body>") == want
    inner = f"<main><p>{body}</p>{form}<p>Leave a reply here</p>{controls}</form></main>"
    assert main_text(f"<body><form>{inner}</form></body>") == main_text(inner) == want


def test_slugs_are_no_boxes():
    page = '<article><h2 id="related-work">Related</h2><section id="social-impact"><p>Impact</p></section><p class="notice-period">Period</p><div id="on-sharing"><p>Sharing</p></div><h3 id="share">Share</h3><p id="ad">Ad</p>{}</article>'
    text = "Related\n\nImpact\n\nPeriod\n\nSharing\n\nShare\n\nAd"
    boxes = ["<div id='related'>x</div>", "<div class='related-posts'>x</div>", "<div class='social-links'>x</div>", "<section class='article-newsletter'>x</section>", "<div id='ad-slot'>x</div>", "<div class='comment-body'>x</div>", "<section id='comments'>x</section>", "<div class='notice'>x</div>"]
    for box in ["", *boxes]:
        assert main_text(page.format(box)) == text, box


def test_unwanted_parts_of_a_line_go():
    assert main_text('<article><p>a <span style="display:none">x <b>y</b></span> b <span hidden>z</span>c</p><p>d</p></article>') == "a b c\n\nd"
    assert main_text('<article><p>a</p><span class="ad">x</span><p>b</p></article>') == "a\n\nb"
    assert main_text('<my-app class="menu-open"><main><p>a</p></main></my-app>') == "a"


def test_hidden_text_stays_out():
    for style in ("display:none", "color: red; display : none;", "visibility:hidden", "DISPLAY:NONE !important"):
        assert main_text(f'<article><p>seen</p><div style="{style}"><p>not seen</p></div><p style="{style}">nor this</p></article>') == "seen"
    assert main_text('<article><p style="display:block">a</p><p style="background:url(display:none.png)">b</p></article>') == "a\n\nb"


@pytest.mark.parametrize("tag", ['<div class="ad">', "<form>", '<div class="widget">', '<div class="comments">', "<section>"])
def test_deep_nesting_takes_linear_time(tag):
    began = time.process_time()
    main_text(tag * 80_000 + "<main><p>x</p></main>" + "<p>y</p>" * 10)
    main_text((tag + "t") * 80_000)
    assert time.process_time() - began < 6


def test_related_cards_stay_out():
    cards = "<div class='related'>" + "<article><h3>Card</h3><p>teaser</p></article>" * 9 + "</div>"
    assert main_text(f"<article><p>own text</p></article>{cards}") == "own text"


def test_long_pages_take_time_in_proportion():
    pages = ["<div>" * 40_000 + "</p>" * 40_000 + "<p>end</p>" + "</div>" * 40_000, "<div class='widget'>" * 40_000 + "x", "<p><b><i>x" * 80_000, "<a '\">" * 120_000 + "x", "<a x=\"" * 120_000, "<p>" + "&amp; " * 200_000, "<" * 1_000_000]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 6 * max(1, len(page) / 1e6), page[:30]


def test_article_of_a_whole_page():
    page = '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><a href=/>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one\n  two<br>three<p>four</p></article><footer>&copy;</footer></body></html>'
    assert main_text(page) == "A & B\n\none two three\n\nfour"


def test_what_is_not_text_goes():
    page = '<main><header><h1>T</h1></header><div class="cookie-notice">c</div><p>keep</p><aside>s</aside><form>f</form><section id="comments"><article><p>said</p></article></section><!-- x --><ul><li>i<li>j</ul></main><p>outside</p>'
    assert main_text(page) == "T\n\nkeep\n\ni\n\nj"


def test_surge_and_dive_without_a_main_element():
    links = "<ul>" + "<li><a href=x>link text here</a></li>" * 20 + "</ul>"
    body = "<h2>Head</h2><p>" + "plain words " * 30 + "</p><p>short</p>"
    assert main_text(f"<div>{links}</div><div>{body}</div><div>{links}</div>").startswith("Head\n\nplain words")
    assert "link text" not in main_text(f"{links}{body}{links}")


def test_all_of_an_article_without_a_main_element():
    advert = '<div class="advert"><p>buy</p><p>now</p><p>here</p><p>!</p></div>'
    long, closing = ["plain words " * 100] * 4, "closing words " * 28
    body = "".join(f"<p>{t}</p>" for t in long)
    want = [t.strip() for t in (*long, closing)]
    assert main_text(f"<div>{body}{advert}<p>{closing}</p></div>").split("\n\n") == want
    assert main_text(f"<div>{body}{advert}<p>The end.</p></div><div><p>by us</p></div>").split("\n\n") == [*want[:-1], "The end."]


def test_a_teaser_does_not_stand_for_the_page():
    teaser, body = "<article><p>A card.</p></article>", "".join(f"<p>{'plain words ' * 60}</p>" for _ in range(5))
    advert = '<div class="advert"><p>buy</p><p>now</p><p>here</p></div>'
    text = main_text(f"{teaser}<div>{body}{advert}<p>Last.</p></div>{advert}<div><p>by us</p></div>")
    assert text.count("plain words") == 300 and text.startswith("A card.") and text.endswith("Last.")


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- open") == ""
    assert main_text("plain") == "plain"
    assert main_text("<p>a < b &lt;c&gt; &#x41; &nbsp; d</p>") == "a < b <c> A d"
    assert len(main_text("<article>" + "<p>w</p>" * 20000 + '<a href="')) == 20000 * 3 - 2


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 5), (1, "u", "<p>x</p>", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    rows = extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert extract(df.limit(0)).count() == 0
