import re
from html import unescape

import pytest

from clusterscope.llm import wrappers
from clusterscope.llm.texts import table


def page(n, article, extra="", host="news.example.org"):
    return (f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
            f"<nav><ul><li><a href=/>Home</a><li><a href=/x>News {n}</a></ul></nav><div class='cookie-notice'>We use cookies</div>{extra}{article}"
            f"<div id=comments><p>reader says {n}</p></div><aside>side {n}</aside><form><p>Sign up</p><input name=x></form><footer>&copy; all</footer></body></html>")


def test_article_pages():
    w = wrappers.Wrapper(None)
    text = w.text(page(1, "<article><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld&nbsp;&#233;\n  word<br>next<p>Two<ul><li>a<li>b</ul>"
                          "<div class=ad>buy</div><table><tr><td>c1<td>c2</table><!-- x --><pre> p  q </pre></article>"))
    assert text == "Head & tail\n\nOne bold é word next\n\nTwo\n\na\n\nb\n\nc1\n\nc2\n\np q"


@pytest.mark.parametrize("bad, text", [("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", "<p"), ("<p>x</div></p>y", "x\n\ny"), ("<script>if", ""), ("<!-- open", ""),
                                       ("<article><p>x", "x"), ("<a href='x>y</a>z", None), ("x" * 10 + "<b", "x" * 10 + "<b"), ("</p>t", "t")])
def test_broken_html(bad, text):
    got = wrappers.Wrapper(None).text(bad)
    assert text is None or got == text


def test_wrapper_finds_content_and_template_text():
    body = lambda n, k: "<div class=wrap><div class=col><h2>Title %d</h2>%s</div><div class=box>Our standing offer to everybody</div></div>" % (
        n, "".join(f"<p>Long paragraph number {n} {i} of this story about things</p>" for i in range(k)))
    pages = [page(n, body(n, n + 1), "<p>seen <i>today</i></p>" if n % 2 else "") for n in range(6)]
    held = wrappers.infer(pages)
    assert held["region"][-1] == "div.col"
    assert "(<p>#</p>)+" in held["expression"] and ")?" in held["expression"] and "|" not in held["expression"].replace(r"\|", "")
    import json
    w = wrappers.Wrapper(json.dumps(held))
    new = page(9, body(9, 2))
    assert w.text(new) == "Title 9\n\nLong paragraph number 9 0 of this story about things\n\nLong paragraph number 9 1 of this story about things"
    assert any("Our standing offer to everybody" == t for _, t in held["literals"])


def test_alignment_is_union_free():
    a, b = wrappers.read("<div><p>x</p><p>y</p><hr></div><h3>k</h3><p>1</p><h3>l</h3><p>2</p>"), wrappers.read("<div><p>x</p><ul><li>q</ul></div><h3>k</h3><p>1</p>")
    text = wrappers.expression(wrappers.align(a, b))
    assert text == "<div>(<p>#</p>)+(<ul><li>q</li></ul>)?</div>(<h3>#</h3><p>#</p>)+"
    assert wrappers.expression(wrappers.read("<ul><li>a<li>b<li>c</ul>")) == "<ul>(<li>#</li>)+</ul>"


def simple(html):
    """The article of the driver's pages, by plain patterns."""
    body = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:h1|p)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_driver_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = wrappers.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        assert r.text == simple(r.html)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://a.b/c", "<p>x</p>"), (2, "/relative", ""), (3, "http://a.b", "<article>y</article>")],
                               "page_id long, url string, html string")
    df = df.selectExpr("*", "'clash' as text", "1 as host", "2 as wrapper")
    got = sorted((r.page_id or 0, r.text) for r in wrappers.extract_text(df).collect())
    assert got == [(0, "x"), (1, ""), (1, ""), (2, ""), (3, "y")]
    assert wrappers.extract_text(df.limit(0)).count() == 0


def story(n, k=2):
    return page(n, f"<div class=top><article><h3>Teaser {n}</h3></article></div><div class=story>{''.join(f'<p>Long paragraph {n} {i} of the story</p>' for i in range(k))}</div>"
                   "<div class=box>Our standing offer to everybody</div>")


def test_page_is_read_through_the_pattern():
    import json
    held = wrappers.infer([story(n, n + 1) for n in range(6)])
    assert not held["article"]
    assert wrappers.Wrapper(json.dumps(held)).text(story(9)) == "Teaser 9\n\nLong paragraph 9 0 of the story\n\nLong paragraph 9 1 of the story"
    hows = [(path[-1], how) for path, _, how in wrappers.matched(held["pattern"], story(9)) if "footer" not in path]
    assert ("p", "slot") in hows and ("h3", "slot") in hows and ("div.box", "literal") in hows and not any(how == "none" for _, how in hows)
    # an element that no sample page has: only what holds it is read without the pattern
    odd = story(9).replace("<p>Long paragraph 9 1", "<h5>New</h5><p>Long paragraph 9 1")
    hows = {path[-1]: how for path, _, how in wrappers.matched(held["pattern"], odd)}
    assert hows["h5"] == "none" and hows["h3"] == "slot" and hows["div.box"] == "literal"
    assert wrappers.Wrapper(json.dumps(held)).text(odd) == "Teaser 9\n\nLong paragraph 9 0 of the story\n\nNew\n\nLong paragraph 9 1 of the story"


def test_driver_pages_match_their_patterns(spark):
    hosts = {}
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        hosts.setdefault(r.url.split("/")[2], []).append(r.html)
    for pages in hosts.values():
        pattern = wrappers.infer(pages[:wrappers.SAMPLE_PAGES])["pattern"]
        assert all(how != "none" for p in pages[:wrappers.SAMPLE_PAGES] for _, _, how in wrappers.matched(pattern, p))


def test_sample_holds_different_pages(spark):
    rows = [(20 * n + i, "http://copies.example.org/x", story(n)) for n in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in wrappers.extract_text(df).collect()} == {f"Teaser {n}\n\nLong paragraph {n} 0 of the story\n\nLong paragraph {n} 1 of the story" for n in range(6)}


def test_names_around_and_within_the_article_do_not_drop_it():
    inner = ('<h2 id="related-work">Related</h2><section id="search"><p>Searching</p></section><div class="section-header">Part</div>'
             '<div class="menu-planning"><p>Meals</p></div><div class="share">Share this</div>')
    want = "Related\n\nSearching\n\nPart\n\nMeals"
    plain = wrappers.Wrapper(None)
    for name in ('class="has-sidebar"', 'class="no-sidebar"', 'id="search-page"'):
        assert plain.text(f"<body><div {name}><article>{inner}</article><div id=comments>reader says</div></div></body>") == want
        assert plain.text(f"<body><div {name}><h1>Head</h1><p>Body</p><div class='site-menu'>x</div></div></body>") == "Head\n\nBody"
    # what is beside a plain article is still left out, an article element or not
    assert plain.text(f"<div id=main><article>{inner}</article></div><div class='comment-list'><article>reader says</article></div>") == want


def test_region_holds_all_slots():
    import json

    def made(n):
        return page(n, f"<div class='wrap has-sidebar'><div class=col><p>{('word %d ' % n) * 40}</p></div><div class=end><p>Closing words {n}</p></div></div>")
    held = wrappers.infer([made(n) for n in range(6)])
    assert held["region"][-1] == "div.wrap.has-sidebar"
    assert wrappers.Wrapper(json.dumps(held)).text(made(7)) == ("word 7 " * 40).strip() + "\n\nClosing words 7"


def test_every_page_counts_for_a_host(spark):
    # the box says something else on 4 pages of 120: a few pages of the host may not show it
    rows = [(n, "http://many.example.org/x", story(n).replace("Our standing offer", f"Offer {n} of today") if n % 30 == 7 else story(n)) for n in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {n: f"Teaser {n}\n\nLong paragraph {n} 0 of the story\n\nLong paragraph {n} 1 of the story\n\n{f'Offer {n} of today' if n % 30 == 7 else 'Our standing offer'} to everybody"
            for n in range(120)}
    for at_once in (64, 5):                              # two, and four levels of groups
        assert {r.page_id: r.text for r in wrappers.extract_text(df, at_once).collect()} == want


def test_stored_patterns_are_restored():
    pattern = wrappers.merged([wrappers.read(story(n, n + 1)) for n in range(6)])
    again = wrappers.restored(wrappers.stored(pattern))
    assert again == pattern and wrappers.packed(again) == wrappers.packed(pattern)


def test_pages_that_name_themselves_share_a_pattern():
    pages = [story(n).replace("<body>", f"<body class='single postid-{5000 + n}'>") for n in range(40)]
    assert len(wrappers.infer(pages)["expression"]) == len(wrappers.infer(pages[:8])["expression"])


def test_wide_sequences_are_matched_whole():
    # 1,600 unlike elements each: more cells than a table of both sides may have had
    part = lambda n, i: f"<h2 class=k{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}>part {i} of {n}</h2>"
    pages = ["<div class=col>" + "".join(part(n, i) for i in range(1600) if i % 7 != n) + "</div>" for n in range(3)]
    pattern = wrappers.packed(wrappers.merged([wrappers.read(page) for page in pages]))
    for page in pages:
        found = list(wrappers.matched(pattern, page))
        assert len(found) > 1300 and all(how in ("slot", "fixed") for _, _, how in found)


@pytest.mark.parametrize("bits", [0, 64, 1 << 26])
def test_matching_and_alignment_against_regular_expressions_and_tables(monkeypatch, bits):
    import random

    monkeypatch.setattr(wrappers, "ROW_BITS", bits)
    draw = random.Random(7)
    seen = 0
    for _ in range(2000):
        pattern, nodes = [], []
        for _ in range(draw.randint(0, 6)):
            optional, repeated = draw.random() < 0.5, draw.random() < 0.5
            if draw.random() < 0.4:
                pattern.append(["#", draw.choice([None, "x", "y"]), optional, True])
                turns = [("#", [pattern[-1][1] or draw.choice("xyz")])]
            else:
                pattern.append(["<>", [[draw.choice("ab"), None] for _ in range(draw.randint(1, 3))], repeated, optional])
                turns = [(s, []) for s, _ in pattern[-1][1]] * (draw.randint(1, 3) if repeated else 1)
            nodes += turns if not optional or draw.random() < 0.5 else []
        if draw.random() < 0.3:
            draw.shuffle(nodes)
        written = "".join(("[xyz]" if p[1] is None else p[1]) + "?" * p[2] if p[0] == "#" else
                          "(" + "".join(s for s, _ in p[1]) + ")" + {(True, True): "*", (True, False): "+", (False, True): "?", (False, False): ""}[p[2], p[3]]
                          for p in pattern)
        good = re.fullmatch(written, "".join(x[1][0] if x[0] == "#" else x[0] for x in nodes)) is not None
        fit = wrappers._fit(pattern, nodes)
        assert (fit is not None) == good and (fit is None or len(fit) == len(nodes))
        seen += good
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = wrappers._longest(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and z < w for (x, z), (y, w) in zip(pairs, pairs[1:]))
    assert seen > 500


def test_wide_alignment_is_longest():
    # the first element stands at the end of the other side: taken first it would leave nothing for the others
    keys = [f"k{i}" for i in range(1500)]
    assert len(wrappers._longest(keys, ["z", *keys[1:], keys[0]])) == 1499
