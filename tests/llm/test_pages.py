from __future__ import annotations

import random

from corpusmill.llm import pages
from corpusmill.llm.pages import CONTENT, NO_TEXT, OTHER, TEASER

SCHEMA = "page_id long, url string, html string"


def texts(source):
    p = pages.parse(source)
    return list(zip(p.lines, p.kinds))


def test_lines_and_kinds():
    assert texts("<p>a  <b>b</b>\n c&amp;d&nbsp;e<br>f") == [("a b c&d e", OTHER), ("f", OTHER)]
    assert texts("<nav><ul><li>x<li>y</ul></nav><div>t</div><!-- c --><script>var a='<p>';</script><style>p{}</style>") == [("x", NO_TEXT), ("y", NO_TEXT), ("t", OTHER)]
    assert texts("<article><h1>T</h1><p><b>one<br><p>two</article><footer>f</footer>") == [("T", CONTENT), ("one", CONTENT), ("two", CONTENT), ("f", NO_TEXT)]
    assert texts("<main><div class='user-comments'><p>c</div><p>t</main>") == [("c", NO_TEXT), ("t", CONTENT)]
    assert texts("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by</p></header>x</article>") == [("Site", NO_TEXT), ("T", CONTENT), ("by", NO_TEXT), ("x", CONTENT)]
    assert texts("<div id='cookie-notice'>n</div><form>q<input></form><aside>s</aside><div role=banner>r</div><div style='display: none'>h</div>t") == [("n", NO_TEXT), ("q", NO_TEXT), ("s", NO_TEXT), ("r", NO_TEXT), ("h", NO_TEXT), ("t", OTHER)]
    assert texts("<body class='has-sidebar'><p>t") == [("t", OTHER)]
    assert texts("a < b <p title='x > y'>c</p><p") == [("a < b", OTHER), ("c", OTHER)]
    for broken in ("", "<", "</", "<p <b>x", "<a href=\"x>y", "<!--", "<script>", "&#xFFFFFFF;&bad;", "</p></b>x<b></i>", "<" * 3000, "<div>" * 500 + "x"):
        pages.parse(broken)


def kept(source):
    return pages.main_text(pages.parse(source), None)[0]


def test_wrappers_that_hold_the_article_stay():
    assert kept('<div class="layout with-sidebar"><article><p>A text.</article></div>') == "A text."
    assert kept('<div class="page has-header"><p>A text.</div>') == "A text."
    assert kept('<form id="aspnetForm"><div class="search">find</div><article>A text.</article></form>') == "A text."
    assert kept('<article><p>one<p class="legal">two<div class="comments">three</div></article>') == "one two"
    assert kept('<article>A text.</article><div class="sidebar"><article>Teaser.</article></div>') == "A text."
    assert kept('<div class="cookie-notice">We use them.</div><div class="main-menu">x</div><p>This is the text of the page.') == "This is the text of the page."


def test_an_article_element_counts_if_it_holds_most_of_the_text():
    long = "This is the main text of the page, and it goes on for a while."
    assert kept(f'<div class="content"><p>{long}</div><article class="card"><a href="/t">Teaser</a></article>') == long
    assert kept(f'<div id="story"><p>{long}</p><p>More of it.</p></div><section><article><a>Other story</a></article><article><a>Third</a></article></section>') == long + " More of it."
    assert kept(f"<p>By the way<article><h1>T</h1><p>{long}</article><p>Also read") == "T " + long
    assert kept('<article><p>Intro.</p><div class="notice-of-appeal"><p>REAL</p></div><div class="legal-analysis related"><p>And this.</p></div></article>') == "Intro. REAL And this."
    assert texts("<article><p><a>x</a> <a>y</a><p>z <a>w</a></article>") == [("x y", TEASER), ("z w", CONTENT)]


def plain_copy(a, b):
    own = [x for x, k in zip(a.lines, a.kinds) if k != NO_TEXT]
    own = [x for x in own if len(x.split(" ")) >= 8] or own
    return 2 * sum(len(x) for x in own if (x in [y for y, k in zip(b.lines, b.kinds) if k != NO_TEXT])) > sum(len(x) for x in own)


def plain_shared(a, b):
    """Places in `a` of a longest common subsequence, by the whole table."""
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            d[i][j] = d[i + 1][j + 1] + 1 if a[i] == b[j] else max(d[i + 1][j], d[i][j + 1])
    i = j = 0
    out = set()
    while i < n and j < m:
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif d[i + 1][j] >= d[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_texts(rows):
    """All pages of a site at once, without blocks; lines of these sites are unlike enough for one longest common subsequence."""
    order = sorted(range(len(rows)), key=lambda i: pages.sort_key(rows[i][1], rows[i][0]))
    found = [pages.parse(rows[i][2] or "") for i in order]
    keys = [pages.url_key(rows[i][1]) for i in order]

    def side(step):
        out = {}
        for i in range(len(order)) if step < 0 else range(len(order) - 1, -1, -1):
            k = i + step
            while k is not None and 0 <= k < len(order) and keys[k][0] == keys[i][0] and plain_copy(found[i], found[k]):
                k = out[k]
            out[i] = k if k is not None and 0 <= k < len(order) and keys[k][0] == keys[i][0] else None
        return out

    low, high = side(-1), side(1)
    texts = {}
    for i, page in enumerate(found):
        near = [k for k in (low[i], high[i]) if k is not None]
        gone = set()
        if near:
            common = lambda k: next((n for n, (x, y) in enumerate(zip(keys[i][1], keys[k][1])) if x != y), min(len(keys[i][1]), len(keys[k][1])))
            partner = sorted(near, key=lambda k: (-common(k), k))[0]
            gone = plain_shared(page.lines, found[partner].lines)
            more = [partner]
            beside = [low[i], high[i], low.get(low[i]), high.get(high[i])]
            for k in (*beside, low.get(beside[2]), high.get(beside[3])):
                if len(more) < 3 and k is not None and k not in (i, partner) and not plain_copy(page, found[k]) and not any(plain_copy(found[k], found[p]) or plain_copy(found[p], found[k]) for p in more):
                    more.append(k)
            inside = [n for n, k in enumerate(page.kinds) if k in (CONTENT, TEASER)]
            seen = {n: sum(n in plain_shared(page.lines, found[k].lines) for k in more[1:]) for n in inside}
            rim = set()
            for some in (inside, inside[::-1]):
                for n in some:
                    if n not in gone or seen[n] < 2:
                        break
                    rim.add(n)
            gone -= set(inside) - rim
        left = [(x, k) for n, (x, k) in enumerate(zip(page.lines, page.kinds)) if n not in gone and k != NO_TEXT]
        of = {True: sum(len(x) for x, k in left if k != OTHER), False: sum(len(x) for x, k in left if k == OTHER)}
        texts[rows[order[i]][0]] = " ".join(x for x, k in left if (k != OTHER if of[True] > of[False] else k != TEASER))
    return texts


def mixed_site():
    """Several hosts; menus, boxes and license lines; runs of copies; passages that two articles share; pages without articles."""
    rng = random.Random(12)
    line = lambda n=12: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(9999)) for _ in range(n))
    rows = []
    for host in range(3):
        passage, body = line(20), ""
        for i in range(60):
            if not 20 <= i < 40 or host == 1:
                body = "".join(f"<p>{line()}</p>" for _ in range(rng.randrange(1, 5))) + (f"<p>{passage}</p>" if i % 9 < 2 else "")
            inner = f"<div>Shared head of {host}</div>{body}<p>Licensed by host {host}, all of it</p>"
            inner = f"<article>{inner}</article>" if i % 4 else inner
            rows.append((len(rows), f"http://h{host}/p/{i // 10}/{i:03d}", f"<ul><li>Home {host}<li>News {host}</ul><nav>{line(2)}</nav>{inner}<div>Foot of {host}</div>"))
    return rows


def test_against_plain_differencing_whatever_the_blocks(spark):
    rows = mixed_site()
    want = plain_texts(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for size, parts in ((1 << 30, "4"), (6000, "4"), (2500, "64")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r.page_id: r.text for r in pages.main_texts(docs.repartition(int(parts)), block_bytes=size).collect()} == want, (size, parts)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_block_of_copies_finds_partners_outside(spark):
    (_, same), *others = site("x.org", 30, seed=3)
    rows = [(i, f"http://x.org/a/{i:04d}", same if 5 <= i < 25 else others[i][1] if i < 29 else others[0][1]) for i in range(30)]
    whole = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("Home" not in t and "rights" not in t for t in whole.values())
    for size in (900, 2000, 4000):
        assert {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA), block_bytes=size).collect()} == whole


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        found = pages.common_lines(a, b, rng.choice([1, 10, 1 << 26]))
        assert len(found) == len(set(found)) == brute_lcs(a, b)
        it = iter(b)
        assert all(any(x == a[i] for x in it) for i in found)


def site(host, n, article=False, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choice('alpha beta gamma delta epsilon zeta'.split()) + str(rng.randrange(99)) for _ in range(12))}</p>" for _ in range(4))
        body = f"<article>{body}</article>" if article else body
        out.append((f"http://{host}/a/{i:04d}", f"<div>Home of {host}</div><div>Contact</div>{body}<div>All rights, {host}</div>"))
    return out


def test_shared_lines_go_and_blocks_do_not_matter(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(site("x.org", 300) + site("y.org", 1, seed=5) + site("z.org", 40, True, 6))]
    got = {r.page_id: r for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = " ".join(x.split("</p>")[0] for x in h.split("<p>")[1:])
        assert got[i].text == (body if i != 300 else "Home of y.org Contact " + body + " All rights, y.org"), i
        assert got[i].n_chars == len(got[i].text) and (got[i].n_shared >= 3) == (i != 300) == got[i].paired
    one = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA), block_bytes=5000).collect()}
    assert one == {i: r.text for i, r in got.items()}


def test_shared_lines_inside_articles_go(spark):
    rows = [(i, u, h.replace("<article>", "<article><div class='box'>Read our terms</div>").replace("</article>", "<p class='x1'>Join us today</p></article>")) for i, (u, h) in enumerate(site("x.org", 30, True))]
    rows.append((99, rows[4][1] + "?copy", rows[4][2]))
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, _, h in rows:
        assert got[i] == " ".join(x.split("</p>")[0] for x in h.split("<p>")[1:5]), i


def test_copies_keep_their_text(spark):
    (url, h), *others = site("x.org", 20)
    rows = [(i, f"http://x.org/a/0000?copy={i}", h) for i in range(3)] + [(10 + i, u, x) for i, (u, x) in enumerate(others)]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    body = " ".join(x.split("</p>")[0] for x in h.split("<p>")[1:])
    assert got[0] == got[1] == got[2] == body


def test_long_runs_of_copies_and_short_articles(spark):
    """A run of copies longer than any window, and pages whose menus are longer than their articles."""
    menu = "".join(f"<li>Menu entry {k} of the site</li>" for k in range(60))
    rows = [(i, f"http://x.org/b/{i:04d}", f"<ul>{menu}</ul><p>{'The only sentence of this text says nothing new' if 10 <= i < 60 else 'Another text of number ' + 'abcdefghij'[i % 10] * 3 + ' and a few words more'}</p>") for i in range(70)]
    got = {r.page_id: r for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA), block_bytes=1 << 30).collect()}
    for i, _, h in rows:
        assert got[i].paired and got[i].text == h.split("<p>")[1].split("</p>")[0], i
    low, high = pages.sides([pages.parse(h) for _, _, h in rows], ["x"] * 70)
    assert {pages.partner_of(k, low, high, [u for _, u, _ in rows]) for k in range(10, 60)} == {9}


def test_odd_rows(spark):
    rows = [(1, None, None), (None, None, "<p>x"), (2, "http://h/a", ""), (2, "http://h/a", "<p>t"), (2, "http://h/a", "<p>t"), (3, "no url", "<p>" + "w " * 50_000), (4, "http://h/b", None), (5, "//H/c?d#e", "plain")]
    docs = spark.createDataFrame([(*r, "k", 9) for r in rows], SCHEMA + ", lines string, block int")
    got = pages.main_texts(docs).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (1, 4)} == {""}
    assert next(r for r in got if r.page_id == 3).n_chars == 99_999
    assert pages.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0
