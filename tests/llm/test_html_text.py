from __future__ import annotations

from tabaudit.llm.html_text import extract, main_text, smoothed, split_at
from tests.llm.cases import prose

A, B, C = prose(1, 40), prose(2, 35), prose(3, 50)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">item {k}</a></li>' for k in range(8)) + "</ul>"


def test_template_with_all_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head>
    <body><header><h2>Site name</h2>{MENU}</header><nav>{MENU}</nav><div class="cookie-notice">We use cookies {A}</div>
    <div id="content"><article><header><h1>Head &amp; line</h1></header><p>{A}</p><p>Short.</p>
    <div class="ad-slot">Buy {B}</div><form><label>Mail</label><input></form><p>{B}<br>{C}</p>
    <aside>Related {C}</aside><ul><li>point one</li><li>point&nbsp;two</li></ul></article>
    <section class="comments"><article class="comment"><p>{C} {C} {C}</p></article></section></div>
    <div class="sidebar">{MENU}{A}</div><footer>&copy; us {B}</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head & line", A, "Short.", f"{B} {C}", "point one", "point two"])


def test_without_article_element():
    page = f'<body>{MENU}<div class="main-text"><p>{A}<p>x<p>{B}</div><div class="links">{MENU}</div></body>'
    assert main_text(page) == "\n".join([A, "x", B])
    flat = f"<body>{MENU}<p>{A}<p>{B}<p>{C}{MENU}</body>"
    assert main_text(flat) == "\n".join([A, B, C])


def test_broken_markup():
    assert main_text(f"<article><h1>T</h1><p><b>{A}<br><p>{B}</p><p>{C}") == "\n".join(["T", A, B, C])
    assert main_text(f"<article><p>a &lt;b&gt; &#233;&eacute; {A}</p></article></div></p>") == f"a <b> éé {A}"
    assert main_text(f"<p>{A}</p><!-- {B} --><script>if (a < b) {{}}") == A
    assert main_text("<") in ("", "<") and main_text("just text") == "just text"


def test_short_article_in_a_large_frame():
    page = f"<body><nav>{MENU}</nav><article><h1>Sthe.</h1></article><footer>{A} {B}</footer></body>"
    assert main_text(page) == "Sthe."


def test_clustering():
    values = smoothed([1.0, 1.0, 90.0, 100.0, 95.0, 2.0])
    assert len(values) == 6
    assert [bool(v >= split_at(values)) for v in values] == [False, False, True, True, True, False]
    assert split_at(smoothed([5.0])) == 5.0


def test_table(spark):
    rows = [(1, "u", f"<article><p>{A}</p></article>", 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p></p>", 4)]
    rows += [(5, "long", "<article>" + "<p>para graph</p>" * 20_000 + "</article>", 5)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = [tuple(r) for r in extract(pages).collect()]
    long = "\n".join(["para graph"] * 20_000)
    wanted = [(1, "u", A, len(A)), (2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0)] + [(5, "long", long, len(long))] * 2
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_wrappers_with_boilerplate_words():
    """A word in the name of what holds the page's text is no reason to drop it; inner elements are still judged."""
    body = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
    for name in ("content right-sidebar", "no-sidebar", "has-comments", "ad-free", "widget", "layoutNoSidebar"):
        assert main_text(f'<body>{MENU}<div class="{name}">{body}</div></body>') == "\n".join([A, B, C]), name
    inner = f'{body}<div class="comments"><p>{A}</p></div><div class="ad-slot">{B}</div>'
    assert main_text(f'<body><div id="page" class="has-comments">{inner}</div></body>') == "\n".join([A, B, C])
    assert main_text(f'<body><form action="/">{MENU}<div>{body}</div><form><p>Mail us</p></form></form></body>') == "\n".join([A, B, C])
    posts = "".join(f'<div class="post ad-free"><p>{t}</p></div>' for t in (A, B, C))
    assert main_text(f"<body>{MENU}{posts}</body>") == "\n".join([A, B, C])
    assert main_text(f'<body><div class="comments"><p>{A}</p></div></body>') == A


def test_large_boilerplate_beside_an_article():
    comments = "".join(f'<div class="comment"><p>{C} {C}</p></div>' for _ in range(4))
    assert main_text(f'<body><div class="post"><p>{A}</p><p>{B}</p></div><div id="comments">{comments}</div></body>') == "\n".join([A, B])
    page = f'<body><article><p>{A}</p><p>{B}</p></article><div class="comments-area"><p>{C} {C}</p></div></body>'
    assert main_text(page) == "\n".join([A, B])


def test_title_and_lead_around_the_text():
    text = f"<p>{A} {A}</p><p>{B} {B}</p><p>{C} {C}</p>"
    wanted = "\n".join(["Title", "A lead.", f"{A} {A}", f"{B} {B}", f"{C} {C}"])
    assert main_text(f'<body>{MENU}<div class=post><h1>Title</h1><p>A lead.</p><div class=text>{text}</div></div></body>') == wanted
    assert main_text(f"<body>{MENU}<main><h1>Title</h1><p>A lead.</p><article>{text}</article></main></body>") == wanted
    assert main_text(f"<body><h1>Title</h1><p>A lead.</p><div class=text>{text}</div></body>") == wanted
    parts = f"<main><article><p>{A} {A}</p><p>{C}</p></article><article><p>{B}</p></article></main>"
    assert main_text(f"<body>{MENU}{parts}</body>") == "\n".join([f"{A} {A}", C, B])


def built(k: int, tag: str, names: bool) -> tuple[str, list[str]]:
    """A page and its article's blocks; ``tag`` encloses the article, and other parts are plain unless ``names``."""
    blocks = [f"Title {k}"] + [prose(100 * k + j, 3 + (k * 17 + j * 29) % 70) for j in range(3 + k % 4)] + ["Short end."] * (k % 2)
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    menu, advert, footer = ("nav", 'div class="ad"', "footer") if names else ("div", "div", "div")
    frame = f"<{menu}>{MENU}</{menu}><{advert}>{prose(9 * k, 8)}</div>%s<{footer}>&copy; {prose(7 * k, 9)}</{footer}>"
    return f"<body>{frame % (f'<{tag}>{inner}</{tag}>' if tag else inner)}</body>", blocks


def differing(pages: list[tuple[str, list[str]]]) -> tuple[float, float]:
    """Characters lost and gained, as shares of the articles."""
    lost = gained = total = 0
    for page, blocks in pages:
        found = main_text(page).split("\n")
        lost += sum(len(b) for b in blocks if b not in found)
        gained += sum(len(b) for b in found if b not in blocks)
        total += sum(map(len, blocks))
    return lost / total, gained / total


def test_pages_without_article_elements_or_names():
    assert differing([built(k, "", True) for k in range(60)]) == (0.0, 0.0)
    lost, gained = differing([built(k, "div", False) for k in range(60)])
    assert lost < 0.02 and gained < 0.02


def test_clusters_decide(monkeypatch):
    """Without the threshold, adverts and footers without names stay in the text."""
    pages = [built(k, "div", False)[0] for k in range(60)]
    by_method = [main_text(page) for page in pages]
    monkeypatch.setattr("tabaudit.llm.html_text.split_at", lambda values: float("-inf"))
    assert sum(main_text(page) != text for page, text in zip(pages, by_method)) >= 30
