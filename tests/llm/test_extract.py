import html
import re

import numpy as np

from seqloom.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header>%(nav)s<div class="cookie-notice">We use cookies.</div>
%(open)s<h1>The &amp; title</h1><p>First   paragraph
of text, <b>bold</b> and <a href="x">linked</a>.<p>Second &lt;one&gt; here<br>and on.</p>
<div class="ad">Buy now! Cheap watches and more for you, today only.</div>
<p>Be.</p><!-- no --><form><input value="x"><label>Mail</label></form><p>Last paragraph, with a caf&eacute; &#8364; sign.</p>%(close)s
<aside><p>Side text that is quite long, to be left out of the result in any case.</p></aside>
<section id="comments"><h2>3 comments</h2><p>I disagree with this article, strongly, and at length.</p></section>
<footer>&copy; Someone. All rights reserved, and so on.</footer></body></html>"""
WANT = "The & title\nFirst paragraph of text, bold and linked.\nSecond <one> here and on.\nBe.\nLast paragraph, with a café € sign."
NAV = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(6)) + "</ul></nav>"


def test_article_with_and_without_its_element():
    assert extract.main_text(PAGE % {"nav": NAV, "open": "<article>", "close": "</article>"}) == WANT
    assert extract.main_text(PAGE % {"nav": NAV, "open": "<div>", "close": "</div>"}) == WANT
    plain = NAV.replace("nav>", "div>")
    assert extract.main_text(PAGE % {"nav": plain, "open": "<div>", "close": "</div>"}) == WANT


def test_surges_and_dives_against_window_sums():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(0, 3, 30) * rng.integers(0, 2, 30) * rng.integers(0, 2, 30)
        sums = [lengths[max(0, k - extract.WINDOW + 1) : k + 1].sum() for k in range(30)]
        live, spans = False, []
        for k, s in enumerate(sums):
            if s and not live:
                spans.append([k, k])
            if lengths[k]:
                spans[-1][1] = k + 1
            live = s > 0
        assert extract.surges(lengths) == [tuple(s) for s in spans]


def test_pages_against_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert extract.main_text(r.html) == "\n".join(x for x in parts if x)


def test_broken_markup():
    assert extract.main_text("") == extract.main_text(None) == extract.main_text("<p></p>") == ""
    assert extract.main_text("just text & more") == "just text & more"
    assert extract.main_text("<p>cut <b>off") == "cut off"
    assert extract.main_text("<p>cut off <a href='") == "cut off"
    assert extract.main_text("<nav><a>x</a><article><p>body text.</p></article>") == "body text."
    assert extract.main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert extract.main_text("<p>a < b and then the rest") == "a < b and then the rest"
    assert extract.main_text("plain text where 1 < 2 and so on") == "plain text where 1 < 2 and so on"
    assert extract.main_text("<p>x <!-- a > b --> y <?php z ?> w<![CDATA[ q > r ]]></p>") == "x y w"
    assert extract.main_text("<p title='a > b' class=\"c > d\">text</p>") == "text"
    assert extract.main_text("<p title='it's > odd'>text") and extract.main_text('<p title="never closed>text</p><p>more</p>').endswith("more")
    assert extract.main_text("<svg/><p>one</p><svg><text>no</text></svg>") == "one"
    assert extract.main_text("<script>never closed") == ""
    assert len(extract.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999
    assert extract.main_text("<" * 5000 + "p>x") is not None


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>one</p>", "x", "x"), (2, None, None, None, None), (None, "u", "", "x", "x"), (1, "u", "<p>one</p>", "x", "x")]
    got = extract.extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "one", 3), (1, "one", 3), (2, "", 0)]
    assert extract.extracted(spark.createDataFrame([], schema)).count() == 0


def paragraphs(*which):
    return ["<p>" + " ".join(f"w{k}x{j}" for j in range(20)) + "</p>" for k in which]


def test_surges_choose_also_where_there_is_an_article_element():
    teaser, body = "<article><p>A short teaser of something else.</p></article>", "".join(paragraphs(*range(5)))
    gap = "<ul>" + "<li><a href='x'>Some link or other</a></li>" * 5 + "</ul>"
    assert extract.main_text(f"<body>{teaser}{gap}<div>{body}</div></body>").count("\n") == 4
    several = "".join(f"<article>{x}</article>" for x in paragraphs(*range(5)))
    assert extract.main_text(f"<body>{several}</body>").count("\n") == 4
    beside = "<p>Right beside it.</p>"
    assert extract.main_text(f"<body>{beside}<article>{body}</article>{beside}</body>").count("\n") == 4


def test_boxes_of_several_lines_do_not_split_an_article():
    for n in (3, 10):
        for box in ('<div class="ad">' + "<p>Buy now, only today.</p>" * n + "</div>", "<form>" + "<p>Mail</p>" * n + "</form>", "<ul>" + "<li><a href='x'>A related link here</a></li>" * n + "</ul>"):
            for around in ("%s", "<div>%s</div>"):
                page = around % ("".join(paragraphs(0, 1, 2)) + box + "".join(paragraphs(3, 4)))
                assert extract.main_text(f"<body>{page}</body>").split("\n") == [x[3:-4] for x in paragraphs(*range(5))]


def test_a_sign_after_the_last_tag_is_text():
    assert extract.main_text("<p>if x < y then go on") == "if x < y then go on"
    assert extract.main_text("1 < 2 and <3 <a href='") == "1 < 2 and <3"


def test_broken_markup_takes_no_longer():
    import time

    for page in ("<a" * 100_000, "<a" * 100_000 + ">", "<script " * 50_000, "<a '" * 100_000, '<a ">"' * 100_000, "<!--" * 100_000, "<![CDATA[" * 50_000, "<" * 200_000, "</" * 100_000, "<svg>" * 50_000, "<p <b <i " * 40_000 + ">x", "</x <y " * 60_000, "</" * 300_000 + ">x", "<!" * 100_000 + "x>", "<div>" * 60_000 + "x" + "</p>" * 60_000):
        began = time.time()
        extract.main_text(page)
        assert time.time() - began < 3, page[:20]


def test_names_of_containers_are_no_more_than_evidence():
    body = "".join(paragraphs(*range(5)))
    for mark in ('class="side-by-side"', 'id="search-engines-explained"', 'class="has-sidebar main"', 'class="content-with-social-proof-study"'):
        assert extract.main_text(f"<body><div {mark}>{body}</div></body>").count("\n") == 4, mark
    for mark in ('class="ad-slot-top"', 'id="comments"', 'class="comment-list"', 'class="cookie-notice"', 'role="search"', 'class="sidebar-left"', 'id="site-footer"'):
        assert extract.main_text(f"<body><div>{body}</div><div {mark}>{body[:130]}</div></body>").count("\n") == 4, mark


def windows_brute_force(texts):
    """The stretch of most letters between surge and dive, by the sums themselves."""
    lengths = [len(t) for t in texts]
    sums = [sum(lengths[max(0, k - extract.WINDOW + 1) : k + 1]) for k in range(len(lengths))]
    spans, live = [], False
    for k, s in enumerate(sums):
        if s and not live:
            spans.append([])
        if lengths[k]:
            spans[-1].append(k)
        live = s > 0
    return max(spans, key=lambda s: sum(lengths[k] for k in s), default=[])


def test_pages_without_marks_against_window_sums():
    rng = np.random.default_rng(4)
    for _ in range(60):
        kept, blocks, links = [], [], 0
        for k in range(40):
            if rng.random() < 0.5:
                kept.append("")
                blocks.append(f"<li><a href='#'>link {k}</a></li>")
            else:
                kept.append("word " * int(rng.integers(1, 9)) + str(k))
                blocks.append(f"<li>{kept[-1]}</li>")
        # Each line in a list of its own: no container joins stretches.
        page = "".join(f"<section>{b}</section>" for b in blocks)
        assert extract.main_text(page) == "\n".join(kept[k] for k in windows_brute_force(kept))


def ablated(monkeypatch, **names):
    for name, value in names.items():
        monkeypatch.setattr(extract, name, value)


def test_the_distribution_decides_on_the_table(spark, monkeypatch):
    """Without its stretches results change on every page; without lists of names, or without names and
    article elements, nine of ten articles stay."""
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [extract.main_text(h) for h in rows]
    with monkeypatch.context() as m:
        m.setattr(extract, "chosen", lambda found, menus, slight: (0, len(found)))
        assert all(extract.main_text(h) != w for h, w in zip(rows, want))
    nothing = frozenset()
    with monkeypatch.context() as m:
        ablated(m, WORDS=nothing, APART=nothing, ROLES=nothing, PARTING=nothing, ENDING=nothing)
        assert sum(w in extract.main_text(h) for h, w in zip(rows, want)) >= 0.9 * len(rows)
        bare = [re.sub("</?article>", "", h) for h in rows]
        assert sum(w in extract.main_text(h) for h, w in zip(bare, want)) >= 0.9 * len(rows)
    bare = [re.sub("</?article>", "", h) for h in rows]
    assert sum(extract.main_text(h) == w for h, w in zip(bare, want)) >= 0.9 * len(rows)


def test_unmarked_menus_and_footers_are_dives():
    """Where no name says anything, few letters a line do."""
    short = lambda n: "".join(f"<div>m{k}</div>" for k in range(n))
    body = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(12))
    for before, after in ((8, 8), (30, 3), (0, 12)):
        got = extract.main_text(f"<body><div>{short(before)}</div><div>{body}</div><section>{short(after)}</section></body>").split("\n")
        own = [x for x in got if x.startswith("word")]
        assert len(own) == 12 and len(got) - 12 <= 2 * (extract.WINDOW - 1), (before, after)


def test_what_is_around_most_of_the_page_is_no_form_and_no_sidebar():
    inner = "".join(paragraphs(*range(5)))
    want = [x[3:-4] for x in paragraphs(*range(5))]
    aside = "<nav><ul><li><a href='x'>One</a></li><li>Two</li></ul></nav>", "<div class='ad'>Buy this now.</div><footer>Imprint and all that.</footer>"
    for around in ('<form id="aspnetForm">%s</form>', '<div class="sidebar-layout">%s</div>', '<form><div class="sidebar-layout">%s</div></form>', '<div id="comments-page">%s</div>'):
        for own in ("<article>%s</article>", "<main>%s</main>", "<div>%s</div>"):
            page = around % (aside[0] + own % inner + aside[1])
            assert extract.main_text(f"<body>{page}</body>").split("\n") == want, (around, own)


def test_names_of_attributes_are_whole_and_prose_has_no_role():
    for mark in ('hidden-text="x"', 'data-role="search"', 'data-hidden', 'id="share"', 'class="notice"', 'aria-hidden="false"'):
        page = "<article>" + "".join(paragraphs(0, 1)) + f"<p {mark}>{'prose in a paragraph ' * 5}</p>" + "".join(paragraphs(2)) + "</article>"
        assert extract.main_text(page).count("\n") == 3, mark
    for mark in ("hidden", 'aria-hidden="true"', 'role="search"'):
        assert extract.main_text("<article>" + "".join(paragraphs(0, 1)) + f"<p {mark}>{'prose in a paragraph ' * 3}</p></article>").count("\n") == 1, mark


def test_a_menu_between_two_parts_of_an_article():
    parts = ["<div>" + "".join(paragraphs(*k)) + "</div>" for k in ((0, 1, 2), (3, 4))]
    for menu in ("<nav><p>Page one</p><p>Page two</p><p>Page three</p></nav>", "<nav>" + "<p>Next</p>" * 9 + "</nav>"):
        assert extract.main_text(f"<body>{parts[0]}{menu}{parts[1]}</body>").split("\n") == [x[3:-4] for x in paragraphs(*range(5))]
