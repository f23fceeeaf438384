"""Main text of pages, against pages built from known articles."""

import html
import random

from knotwork.llm import html_text, queries

MENU = "<nav><ul><li><a href='/a'>Home page of all</a></li><li><a href='/b'>News</a></li></ul></nav>"


def test_pages_without_semantic_elements_and_all_kinds_of_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <div id="siteHeader" role="banner">The daily site</div>{MENU}<div class="cookie-notice">We use cookies, a long and wordy notice about them.</div>
    <div id="wrap"><div class="story"><h1>A title</h1><p>First &amp; <b>long</b> paragraph of the text,\n with   white space and&nbsp;references.</p><p>Short.</p>
    <p>A second long paragraph<br>with a break and more words to read for everyone.</p><!-- no --></div>
    <div class="sidebar"><p>Read this other very long story about something else entirely.</p></div>
    <form><p>Your name and your address, please, in full.</p><input></form>
    <section id="comments"><p>I think that this is the best text that I have ever read anywhere.</p></section></div>
    <footer>&copy; all of us</footer></body></html>"""
    want = "A title\nFirst & long paragraph of the text, with white space and references.\nShort.\nA second long paragraph with a break and more words to read for everyone."
    assert html_text.extract(page) == want


def test_article_keeps_short_blocks_and_its_heading_but_no_comments():
    body = "<header><h1>Head</h1><p>by someone</p></header><p>x</p><p><b>One.<br><p>Two words.</p><aside>no</aside><ul><li>item</ul>"
    page = f"<body><header><h1>Site</h1></header>{MENU}<main><article>{body}<div class='comments'><article><p>I agree with every word.</p></article></div></article></main>"
    assert html_text.extract(page) == "Head\nx\nOne.\nTwo words.\nitem"


def test_menus_without_marks_are_left_out_by_their_links():
    links = "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><h2>Head</h2><p>{'long text ' * 30}</p><p>end</p><ul>{links}</ul></body>"
    assert html_text.extract(page).split("\n") == ["Head", ("long text " * 30).strip(), "end"]


def test_odd_pages():
    for page, want in {None: "", "": "", "plain  text": "plain text", "<nav>menu</nav>": "", "<p>a<p": "a", "<![CDATA[x]]>tail": "tail", "</div>a</p>": "a", "<div " * 50_000: ""}.items():
        assert html_text.extract(page) == want
    assert html_text.extract("<p>a" * 20_000) == "\n".join("a" * 20_000)
    assert html_text.extract("<div>" * 50_000 + "x") == "x"


def test_random_articles_come_back_whole(spark, tables):
    rng, rows, want = random.Random(3), [], {}
    for i in range(60):
        blocks = [" ".join("".join(rng.choices("abcdeé&<ü", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 3, 60]))) for _ in range(rng.randint(1, 12))]
        rows.append((i, f"u{i % 3}", f"<body>{MENU}<div class='ad'>buy</div><article>{''.join(f'<p>{html.escape(b)}</p>' for b in blocks)}</article><footer>f</footer>", "extra"))
        want[i] = "\n".join(blocks)
    rows += [(None, None, None, None), (7, "again", rows[7][2], None)]
    folder = tables(pages=(rows, "page_id long, url string, html string, text string"))
    out = [tuple(r) for r in queries.op13_html_extraction(spark, folder).collect()]
    assert len(out) == 62 and (None, None, "", 0) in out
    assert all(text == want[i] and n == len(text) for i, _, text, n in out if i is not None)
    empty = tables(pages=([], "page_id long, url string, html string"))
    assert queries.op13_html_extraction(spark, empty).collect() == []
