import html
import re

from conftest import SF001

from mnemo.llm import html_extract, queries


def _plain(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    got = queries.op7_html_extraction(spark, SF001).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == _plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_kinds_and_markup():
    e = html_extract.extract
    assert e(None) == e("") == e("<p></p>") == ""
    assert e("plain &amp; simple &lt;3") == "plain & simple <3"
    assert e("<div class='menu'><a href=1>Home</a></div><p>Hello&nbsp; <b>w</b>orld<p>Two<br>x<ul><li>a<li>b</ul>") == "Hello world\nTwo x\na\nb"
    assert e("<body><header>Site</header><main><h1>T</h1><p>x</p><form>f</form><aside>s</aside></main><footer>f</footer>") == "T\nx"
    assert e("<nav><ul><li><a>m</a><article><header><h1>T</h1>by me</header><p>one</p><div class='ad box'>z</div></article>") == "T\none"
    assert e("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open") == "yes"
    assert e("<article>a<section class='reader-comments'><p>c</p></section></article><div id=cookie-notice>n</div>") == "a"
    assert e("<table><tr><td>1<td>2<tr><td>3</table></p></div>end") == "1\n2\n3\nend"
    assert e("<p>a < b and c > d</p>") == "a < b and c > d"
    assert e("<article class='social notice'><p>text</p><article class=comment>no</article></article><article class=related>x</article>") == "text"
    assert e("<div class=banner>b</div><ol class=commentlist><li>c</ol><p>text</p><div role=alert>d</div>") == "text"
    assert len(e("<div>" * 5000 + "deep" + "</div>" * 10)) == 4


def test_templates_are_counted_per_host(spark):
    rows = []
    for k in range(30):
        body = f"<div><div class=t{k % 3 == 9}>Read all our stories today</div><p>Story {k} of many words.</p></div>"
        rows.append((k, f"http://a.example/{k}", f"<html><body>{body}<div><a href=/x{k}>Link {k}</a> <a href=/y>B</a></div></body></html>"))
    rows += [(100 + k, f"http://copy.example/{k}", "<body><p>An exact copy.</p></body>") for k in range(20)]
    rows += [(200 + k, f"http://b.example/{k}", f"<body><article><p>Shared passage.</p><p>Own {k}.</p></article></body>") for k in range(20)]
    rows += [(300, None, None), (301, "", ""), (301, "", ""), (None, "http://a.example/0", "<p>Solo</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS key", "1 AS host")
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for k in range(30):
        assert text[k] == f"Story {k} of many words."
    assert all(text[100 + k] == "An exact copy." for k in range(20))
    assert all(text[200 + k] == f"Shared passage.\nOwn {k}." for k in range(20))
    assert text[300] == text[301] == "" and text[None] == "Solo"
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_templates_inside_and_beside_declared_main_content(spark):
    box = "<div class=teaser-x>Read all our stories today</div>"
    para = "<div class=para>Shared words of many articles.</div><div class=para>Para {k}.</div>"
    more = "<ul class=more><li><a href=/{k}>Other story {k}</a></ul>"
    rows = [(k, f"http://a.example/{k}", f"<article><h1>Title {k}</h1><p>Shared passage.</p><p>Story {k} of many words, told at length.</p>{box}"
             f"{para.format(k=k)}{more.format(k=k)}<p><a href=/s{k}>Source {k}</a></p></article><div>About this site</div>") for k in range(20)]
    # no declared main content: what recurs beside the articles of the host goes
    rows += [(100, "http://a.example/p", f"<body><p>A plain page.</p>{box}<div>About this site</div></body>")]
    # copies of an article on pages that differ elsewhere stay whole
    rows += [(200 + k, f"http://c.example/{k}", f"<nav>n{k}</nav><article><h1>T</h1><section>One part.</section><section>Two.</section></article>")
             for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for k in range(20):
        assert text[k] == (f"Title {k}\nShared passage.\nStory {k} of many words, told at length.\nShared words of many articles.\nPara {k}."
                           f"\nSource {k}")
    assert text[100] == "A plain page."
    assert all(text[200 + k] == "T\nOne part.\nTwo." for k in range(8))
    assert all(html_extract.subtrees(page)[1] for _, _, page in rows)


def test_names_and_wrappers_drop_no_article_text():
    e = html_extract.extract
    for name in ("layout has-sidebar", "with-menu", "no-ads", "social-science", "sidebar", "widget"):
        assert e(f"<div class='{name}'><p>All of the text.</p></div><footer>f</footer>") == "All of the text."
        two = f"<article><p>One of them.</p></article><article><p>Two.</p></article><p>tail</p></div><nav><a>m</a></nav>"
        assert e(f"<body><div class='{name}'>{two}") == "One of them.\nTwo."
    assert e("<nav><ul><li><a>m</a><article><p>one</p></article><article><p>two</p></article>") == "one\ntwo"
    assert e("<article>first</article><nav><a>m</a><article>second</article>") == "first\nsecond"
    assert e("<article>first</article><nav><a>m</a><article>teaser</article></nav>") == "first"
    assert e("<aside><article>teaser</article></aside><p>The text of the page.</p>") == "The text of the page."
    assert e("<article><p>text</p></article><div class=comments><article>c</article></div>") == "text"
    assert e("<form id=page><div class=menu><a>m</a></div><p>The text of the page.</p></form>") == "The text of the page."
    assert e("<header><p>Not closed, so all of the page is in it.</p><p>More.</p>") == "Not closed, so all of the page is in it.\nMore."
    parts = "".join(f"<div class='{n}'><p>{n}</p></div>" for n in ("related-work", "notice", "market-share", "share", "section-header", "header"))
    assert e(f"<article><h1>T</h1>{parts}</article>") == "T\nrelated-work\nnotice\nmarket-share\nshare\nsection-header\nheader"
    assert e("<article><p>The text.</p><div class=related><a>Other</a></div><div class=site-ads>x</div></article>") == "The text."
    assert e("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>") == "so x=1 holds"
    assert e("<div class='comment-list'><p>c</p></div><div id=comment-12>d</div><p>The text.</p>") == "The text."
    deep = "<div class=notice>" * 3000
    assert e(f"<article>{deep}<p>deep</p>") == e(f"{deep}<p>deep</p>") == "deep"


def test_chrome_is_learnt_without_any_list(monkeypatch):
    """With the lists of names, roles, tags and main content emptied, hosts of
    five pages or more give the same texts: what recurs beside the core goes."""
    import duckdb
    from conftest import SF01

    pages = duckdb.sql(f"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, html FROM '{SF01}/pages.parquet'").fetchall()
    for name in ("DROPPED_WORDS", "DROPPED_ROLES", "ARTICLE_WORDS", "SURE", "SUBJECTS", "PARTS", "HEADERS", "CLOSED", "ASIDES", "MAINS"):
        monkeypatch.setattr(html_extract, name, set())
    monkeypatch.setattr(html_extract, "DROPPED_TAGS", html_extract.NO_TEXT)
    hosts = {}
    for i, host, page in pages:
        hosts.setdefault(host, {}).setdefault(page, i)
    large = {h: p for h, p in hosts.items() if len(p) >= html_extract.MIN_PAGES}
    assert len(large) >= 15
    for own in large.values():
        times, votes = {}, {}
        for page in own:
            _, found, core = html_extract.subtrees(page)
            for h in found:
                times[h] = times.get(h, 0) + 1
            for h in core:
                votes[h] = votes.get(h, 0) + 1
        least = max(html_extract.MIN_PAGES, html_extract.SHARE * len(own))
        learnt = {h for h, n in times.items() if n >= least} | {h for h, n in votes.items() if n >= max(html_extract.MIN_PAGES, html_extract.CORE * len(own))}
        assert learnt
        for page in own:
            assert html_extract.extract(page, learnt) == _plain(page)
            assert html_extract.extract(page) != _plain(page)      # nothing else takes the chrome away


def test_places_keep_headings_leads_and_other_layouts(spark):
    rows = [(k, "http://c.example/", f"<body><div class=x>Words of the day number {k} and some more</div><div class=y><h1>Title {k}</h1></div>"
             f"<div class=story><p>{'Long story text. ' * 20}{k}</p></div><p>Lead {k}</p></body>") for k in range(8)]
    rows += [(50, "http://c.example/", "<body><div class=x>Only this box here.</div></body>")]
    text = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        story = " ".join(("Long story text. " * 20 + str(k)).split())
        assert text[k] == f"Title {k}\n{story}\nLead {k}"
    assert text[50] == "Only this box here."


def test_odd_markup_takes_linear_time():
    import time

    mb = 1_000_000
    for page in ('<a "' * (mb // 4), '<a "' * (mb // 4) + ">", "<b>" * (mb // 7) + "</i>" * (mb // 7), "<i><div>" + "<b>" * (mb // 7) + "</i>" * (mb // 7),
                 "<b>" * (mb // 14) + "<div></div>" * (mb // 14), "<" * mb, "<a '\"" * (mb // 6), "<script>" * (mb // 8), "<!--" * (mb // 4), "<li>" * (mb // 4),
                 "<td><tr>" * (mb // 8), "<a x='>" * (mb // 7) + "text"):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 15, page[:20]
