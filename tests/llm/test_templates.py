import random
import time
from xml.etree import ElementTree

from pyspark.sql import functions as F

from dayledger.llm import templates

from .helpers import none_of, sentence

SCHEMA = "page_id bigint, url string, html string, host string, templates string, text int"


def page(rng, i, article, host="a.example.com"):
    """A page whose menu differs from page to page and whose unmarked strip does not."""
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in sentence(rng, 4).split())
    html = (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script>"
        f"</head><body><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><!-- ad {i} -->"
        f"<div class='ad'>buy {i}</div><div class='strip'><span>Read our</span> other pages</div>"
        f"{article}<footer>&copy; {host} {i}</footer></body></html>"
    )
    return (i, f"https://{host.upper()}/{i}", html, "x", "y", 1)


def articles(rng, n):
    made = []
    for _ in range(n):
        paragraphs = [sentence(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 4))]
        paragraphs.append("A passage that many pages share.")
        html = "".join(f"<p>{p.replace(' ', '  <b>', 1)}<br>" for p in paragraphs)
        made.append((f"<article><h1>H &amp; T</h1>{html}</article>", " ".join(["H & T", *paragraphs])))
    return made


def test_article_without_what_surrounds_it(spark):
    rng = random.Random(1)
    made = articles(rng, 30)
    rows = [page(rng, i, html) for i, (html, _) in enumerate(made)]
    found = templates.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {i: text for i, (_, text) in enumerate(made)}
    assert {r["page_id"]: r["text"] for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_recurring_subtrees_go_where_no_article_is_marked(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 15) for _ in range(12)]
    rows = [page(rng, i, f"<div><p>{t}</p></div>") for i, t in enumerate(texts)]
    rows += [page(rng, 100 + i, f"<div><p>{t}</p></div>", "b.example.com") for i, t in enumerate(texts[:2])]
    found = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] == t for i, t in enumerate(texts))
    # A host of two pages has no template.
    assert all(found[100 + i] == f"Read our other pages {t}" for i, t in enumerate(texts[:2]))


def test_copies_of_a_page_make_no_template(spark):
    rng = random.Random(3)
    same = page(rng, 0, "<div><p>The only text.</p></div>")
    rows = [(i, f"https://a.example.com/{i}", same[2], "x", "y", 1) for i in range(20)]
    found = templates.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in found} == {"Read our other pages The only text."}


def test_parts_of_an_article_that_are_not_text():
    html = (
        "<main><article><header><h1>Title</h1></header><p>One<sup>2</sup>\n three&nbsp;four"
        "<aside>side</aside><p>Five <button>Go</button><ul><li>six<li>seven</ul>"
        "<div class='post-comments'><p>First!</p></div><div id='cookie-notice'>ok?</div>"
        "<form>mail <input></form><table><tr><td>8<td>9</table><pre>a\n b</pre></article>"
        "<section class='related'><p>More</p></section></main><p>after"
    )
    assert templates.main_text(html, set()) == "Title One2 three four Five six seven 8 9 a b"


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>no host</p>", "x", "y", 1), (2, "not a url", "plain &lt;text&gt;", "x", "y", 1),
        (3, "http://h.example.com/", None, None, None, None), (4, "http://h.example.com/", "", "x", "y", 1),
        (None, "http://h.example.com/", "<div>" * 3000 + "deep", "x", "y", 1),
        (6, "http://h.example.com/", "</p></div><b>un<i>closed <script>x", "x", "y", 1),
        (6, "http://h.example.com/", "</p></div><b>un<i>closed <script>x", "x", "y", 1),
        (7, "http://h.example.com/", "<p>" + "long " * 50_000 + "</p>", "x", "y", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = templates.main_texts(df).collect()
    texts = sorted(((r["page_id"], r["text"]) for r in found), key=str)
    want = [
        (1, "no host"), (2, "plain <text>"), (3, ""), (4, ""), (None, "deep"), (6, "unclosed"),
        (6, "unclosed"), (7, ("long " * 50_000).strip()),
    ]
    assert texts == sorted(want, key=str)
    assert templates.main_texts(none_of(df)).count() == 0
    assert templates.main_texts(df).select(F.max("n_chars")).first()[0] == 249_999


def test_names_are_read_whole_and_spare_the_article():
    text = "<p>The text of the page, which is long enough.</p>"
    for name in ("page has-sidebar", "no-sidebar", "widget", "sidebar"):
        html = f"<div class='{name}'><article>{text}</article></div><div class='ad'><p>buy</p></div>"
        assert templates.main_text(html, set()) == "The text of the page, which is long enough."
        html = f"<div class='{name}'>{text}</div><div class='ad'><p>buy</p></div>"
        assert templates.main_text(html, set()) == "The text of the page, which is long enough."
    html = (
        f"<article>{text}<section id='related-work'><p>Others</p></section><h2 id='social-security'>Law</h2>"
        "<div class='x related-posts'><p>more</p></div></article>"
    )
    assert templates.main_text(html, set()) == "The text of the page, which is long enough. Others Law"


def test_copies_in_other_surroundings_and_notices_of_a_large_host(spark):
    rng = random.Random(7)
    same = "<div id='c{i}'><p>One text that is told on many pages.</p></div>"
    rows = [page(rng, i, same.format(i=i % 3)) for i in range(30)]
    rows += [page(rng, 30 + i, f"<div><p>{sentence(rng, 15)}</p></div>") for i in range(20)]
    notice = "<div class='x'><span>On a part of the pages.</span></div>"
    rows += [
        page(rng, 1000 + i, f"<div><p>{sentence(rng, 15)}</p></div>{notice if i % 5 == 0 else ''}", "b.example.com")
        for i in range(600)
    ]
    found = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Copies keep their text and are no template; the strip of all pages goes.
    assert all(found[i] == "One text that is told on many pages." for i in range(30))
    # A fifth of 600 pages is enough.
    assert not any("On a part" in found[1000 + i] for i in range(600))
    assert all(len(found[1000 + i].split()) == 15 for i in range(600))


TEXT = "<p>The text of the page, which is long enough.</p>"
WANT = "The text of the page, which is long enough."


def test_comments_of_readers_go():
    """Also marked as articles, within the page's article or after it, and longer than it."""
    said = "".join(f"<article class='comment-body'><p>Reader {i} says a lot about it, again and again.</p></article>" for i in range(9))
    for comments in (
        f"<div id='comments' class='comments-area'><h2>Nine comments</h2>{said}</div>",
        f"<section class='user-comments'>{said}</section>", f"<ol class='commentlist'><li>{said}</ol>", said,
        "<div class='reader-comments'>" + "<div><p>Says a lot about it, again and again and again.</p></div>" * 9 + "</div>",
    ):
        assert templates.main_text(f"<article><h1>T</h1>{TEXT}{comments}</article>", set()) == f"T {WANT}"
        assert templates.main_text(f"<article><h1>T</h1>{TEXT}</article>{comments}", set()) == f"T {WANT}"
        assert templates.main_text(f"<div id='content'><main>{TEXT}{comments}</main></div>", set()) == WANT


def test_compound_names():
    for name in ("ad-300x250", "google-ads-top", "article-share-tools", "related-articles", "site-header",
                 "cookie-consent-banner", "newsletter-signup", "nav-menu-left", "sponsored-posts", "popup_box"):
        assert templates.named_out(name), name
        assert templates.main_text(f"<article>{TEXT}<div class='{name}'><p>else</p></div></article>", set()) == (
            WANT if name != "site-header" else f"{WANT} else"
        )
    for name in ("has-sidebar", "no-ads", "related-work", "social-security", "entry-header", "commentary", "header-image-caption"):
        assert not templates.named_out(name), name
    html = f"<article><div class='article-header'><h1>T</h1></div><div class='content-widget'>{TEXT}</div></article>"
    assert templates.main_text(html, set()) == f"T {WANT}"


def subtree(element) -> str:
    """A plain picture of an element: its tag, names, text and children."""
    names = element.get("class", "") + " " + element.get("id", "")
    own = "".join((element.text or "").split())
    return f"<{element.tag} {names}>{own}" + "".join(subtree(c) + "".join((c.tail or "").split()) for c in element) + "</>"


def test_templates_against_a_plain_count(spark):
    """Subtrees of well-formed pages without articles, counted one by one over different texts."""
    rng = random.Random(9)
    parts = [f"<div class='x{i}'><span>{sentence(rng, 3)}</span></div>" for i in range(12)]
    pages, seen, bodies = [], {}, set()
    for i in range(40):
        own = rng.choice([sentence(rng, 9), "one of two texts", "the other text"])
        shown = [p for p in parts if rng.random() < 0.35]
        html = f"<html><body>{''.join(shown)}<div><p>{own}</p></div></body></html>"
        pages.append((i, "https://a.example.com/", html, "x", "y", 1))
        bodies.add(own)
        for e in ElementTree.fromstring(html).iter():
            if e.tag == "div":
                seen.setdefault(subtree(e), set()).add(own)
    need = max(5, min(0.3 * len(bodies), 3 * len(bodies) ** 0.5))
    often = [p for p in parts if len(seen.get(subtree(ElementTree.fromstring(p)), ())) >= need]
    assert 0 < len(often) < len(parts)
    found = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(pages, SCHEMA)).collect()}
    for i, _, html, *_ in pages:
        for part in often:
            html = html.replace(part, "")
        tree = ElementTree.fromstring(html)
        assert found[i] == " ".join(" ".join("".join(d.itertext()) for d in tree.iter("div")).split())


def test_a_deep_page_takes_no_long(spark):
    html = "<div><p>word " * 60_000
    began = time.process_time()
    assert templates.main_text(html, set(templates.candidates(templates.read(html))[:1]))
    assert time.process_time() - began < 20
