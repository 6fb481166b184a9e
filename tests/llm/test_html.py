"""HTML extraction: what the wrapper decides, tree matching against brute force, hostile pages."""

import random
import time

import pytest

from logmill.llm import html_extraction as hx


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")


def test_chrome_without_semantic_tags_is_template(spark):
    """No article, no telling class: what pages of the host share goes, what varies stays, on every layout of the host."""
    top = "<div class=x1><div>The Daily</div><div><a href=/>Home</a> <a href=/w>World</a></div></div>"
    foot = "<div class=low><p>All rights reserved</p></div>"
    plain = top + "<div class=mid><h2>Head {0}</h2><p>First {0}</p><p>Second {0}</p></div>" + foot
    gallery = top + "<table><tr><td>Pictures</td></tr></table><section><h3>Gallery {0}</h3><ul><li>pic {0}a</li><li>pic {0}b</li></ul></section>" + foot
    rare = plain.replace("<div class=mid>", "<blockquote>Sale until Sunday</blockquote><div class=mid>")  # on few pages of the host
    rows = [(i, f"http://host/{i}", (rare if i % 5 == 0 else gallery if i % 3 == 0 else plain).format(i), "c") for i in range(30)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    for i in range(30):
        assert got[i] == (f"Gallery {i}\npic {i}a\npic {i}b" if i % 3 == 0 and i % 5 else f"Head {i}\nFirst {i}\nSecond {i}")
    alone = {i: hx.main_text(h, None, []) for i, _, h, _ in rows}
    assert all(alone[i] != got[i] and "All rights reserved" in alone[i] for i in got)  # without the wrapper nothing goes


def test_one_constant_among_like_siblings(spark):
    """Of siblings that nothing tells apart, those that 5 pages and more share are template by themselves."""
    rows = [(i, "http://h/", f"<div>Our promise</div><div>story {i}</div><div>Call us</div>", "") for i in range(8)]
    rows += [(100 + i, "http://few/", f"<div>Our promise</div><div>story {i}</div>", "") for i in range(3)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got == {i: f"story {i}" for i in range(8)} | {100 + i: f"Our promise\nstory {i}" for i in range(3)}


def test_text_outside_the_article_stays(spark):
    """Headline, lead and further sections may stand outside <article> or <main>."""
    page = "<nav>menu {0}</nav><header>Site</header><h1>Head {0}</h1><div class=lead>Lead {0}</div><article><header>By {0}</header><p>Body {0}</p></article><section>More {0}</section><aside>Side {0}</aside><footer>End {0}</footer>"
    rows = [(i, "http://h/", page.format(i), None) for i in range(4)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Head {i}\nLead {i}\nBy {i}\nBody {i}\nMore {i}" for i in range(4)}


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'class="content has-sidebar"', 'data-id="search-1"', 'id="post-market-share-report"', "title='a hidden comment'", 'data-x="nav" class=story', "class=shared-history", "id=ad-hoc-committee", "class='cookie-recipe'", "class=sharecroppers"])
def test_hints_are_whole_names(attributes):
    assert hx.main_text(f"<div {attributes}><p>story</div>", None, []) == "story"


@pytest.mark.parametrize("attributes", ["class=ad", "class='x cookie-banner y'", "id=reader_comments", "class=related-posts", "class=site-nav", "role=navigation", "class=social-share", "hidden"])
def test_hints_of_noise(attributes):
    assert hx.main_text(f"<div {attributes}><p>noise {{0}}</div><p>story", None, []) == "story"


def test_blocks_and_references():
    assert hx.main_text("a &lt; b&nbsp;&amp; c<br>d<p>x<b>y</b>z\n w<p>&#233;<div>q</div>r", None, []) == "a < b & c d\nxyz w\né\nq\nr"
    assert hx.main_text("<p>1 < 2 and <3</p><!-- no --><?x y?><!doctype z><p>ok", None, []) == "1 < 2 and <3\nok"
    assert hx.main_text('<p title="a > b">in</p><p title=5">out</p><a href="open>x</a><p>y', None, []) == "in\nout\nx\ny"
    assert hx.main_text("<script>var t='</p>';</script><style>p{}</style><p>t</p><textarea>no</textarea>", None, []) == "t"
    assert hx.main_text("<article><p>a<article><p>b</p></article><div class=comments><p>c</div></article>", None, []) == "a\nb"
    assert hx.main_text(None, None, []) == hx.main_text("", None, []) == hx.main_text("<nav>x", None, []) == ""


def brute(a, i, b, j):
    """Nodes that match, by the definition."""
    if a.keys[i] != b.keys[j]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), (w + best(xs[1:], ys[1:])) if (w := brute(a, xs[0], b, ys[0])) else 0)

    return 1 + best(a.children[i], b.children[j])


def test_matching_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        trees = []
        for _ in range(2):
            n = r.randrange(1, 11)
            parents = [-1]
            for i in range(1, n):  # preorder: a parent is the node before or one of its ancestors
                p = i - 1
                while p > 0 and r.random() < 0.5:
                    p = parents[p]
                parents.append(p)
            trees.append(hx.Tree(["r", *(r.choice("ab") for _ in range(n - 1))], parents))
        a, b = trees
        to = hx.match(a, b)
        assert len(to) == brute(a, 0, b, 0)
        assert all(a.keys[i] == b.keys[j] and (not i or to[a.parents[i]] == b.parents[j]) for i, j in to.items())
        assert sorted(to.items()) == sorted(zip(sorted(to), sorted(to.values()), strict=True))  # order kept
        w = hx.merged(b, a)
        assert len(hx.match(a, w)) == len(a.keys) and len(hx.match(b, w)) == len(b.keys) and len(w.keys) == len(b.keys) + len(a.keys) - len(to)


def test_matching_of_many_siblings_is_exact(spark):
    """Beyond any number of siblings as many nodes match as by the definition, and the text is the same."""

    def two_levels(rows):
        keys, parents = ["r"], [-1]
        for key, below in rows:
            at = len(keys)
            keys += [key, *below]
            parents += [0] + [at] * len(below)
        return hx.Tree(keys, parents)

    def definition(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x, (k, u) in enumerate(a):
            for y, (q, v) in enumerate(b):
                best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + (1 + (u == v != "") if k == q else 0))
        return 1 + best[-1][-1]

    r = random.Random(5)
    for n in (20, 64, 65, 90, 300):
        a, b = ([(r.choice("pqrs"), r.choice(["", "a", "b", "c"])) for _ in range(n)] for _ in range(2))
        b[n // 2 :] = [*a[n // 2 : -1], ("z", "")]
        to = hx.match(two_levels(a), two_levels(b))
        assert len(to) == definition(a, b)
        assert sorted(to.items()) == sorted(zip(sorted(to), sorted(to.values()), strict=True))
    rows = []
    for host, n in (("small", 30), ("large", 100)):  # sections of a kind: one more in front moves them all
        body = "".join(f"<section><h2>Fixed {k}</h2><{'ul' if k % 2 else 'dl'}></{'ul' if k % 2 else 'dl'}></section>" for k in range(n))
        rows += [(i, f"http://{host}/", (f"<section><h3>New {i}</h3></section>" if i % 3 == 0 else "") + body + f"<section><h4>Story {i}</h4></section><hr><h{2 + i % 2}>x{i}</h{2 + i % 2}>", "") for i in range(12)]
    got = {(r.url, r.page_id): r.text for r in hx.extract(pages(spark, rows)).collect()}
    for i in range(12):
        assert got["http://small/", i] == got["http://large/", i] == (f"New {i}\n" if i % 3 == 0 else "") + f"Story {i}\nx{i}"


HOSTILE = {
    "quotes": '<a "' * 250_000, "tags": "<a " * 300_000 + '"', "values": "<p a=" + '"' * 300_001, "less": "<" * 400_000, "spaces": "<a " + " " * 400_000 + '"',
    "siblings": "<div>x</div><p>y</p>" * 10_000, "deep": "<div>" * 20_000 + "deep", "unclosed": "<div>" * 20_000 + "</p></i>" * 20_000 + "x", "paragraphs": "<p><b>" * 40_000,
    "classes": "".join(f"<p class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>x" for i in range(8000)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    a, b = hx.Page(HOSTILE[name]).tree(), hx.Page(HOSTILE[name] + "<h2>z</h2>").tree()
    assert len(hx.match(a, hx.merged(a, b))) == len(a.keys)
    hx.main_text(HOSTILE[name], hx.merged(a, b).dump(), [1])
    assert time.process_time() - began < 30


def test_chrome_below_deep_nesting(spark):
    page = "<div>" * 400 + "<nav>menu {0}</nav><p>Same</p><h2>a {0}</h2><h3>b {0}</h3>" + "</div>" * 400
    got = {r.page_id: r.text for r in hx.extract(pages(spark, [(i, "http://d/", page.format(i), "") for i in range(3)])).collect()}
    assert got == {i: f"a {i}\nb {i}" for i in range(3)}


def test_wrappers_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(hx, "WRAPPER_BYTES", 0)
    rows = [(i, f"http://{i % 2}/", f"<p>Same</p><h2>a {i}</h2>", "") for i in range(8)] + [(8, None, None, None), (8, None, None, None)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in hx.extract(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, f"http://{i % 2}/", f"a {i}", 3) for i in range(8)] + [(8, None, "", 0)] * 2, key=str)
