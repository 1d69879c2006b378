import itertools
import random

from kiln.llm.html_extract import Page, Tree, _match, constants, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="ad">Buy {n}</div><div id="cookie-notice">We use cookies</div>{main}<aside>Side {n}</aside>
<form><input><button>Go</button></form><section class="comments"><article class="comment"><p>First! {n}</article></section>
<footer>&copy; host {n}</footer></body></html>"""


def page(n, main):
    return PAGE.format(n=n, main=main)


def test_article_is_extracted():
    html = page(3, "<article><h1>Head&amp;line</h1><p><b>Bold<br><p>Second &lt;para&gt;&nbsp; with\n\tspace</p>"
                   "<p>One<i>word</i>s</p><script>no()</script><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>")
    assert Page(html).text([]) == "Head&line Bold Second <para> with space Onewords x y 1 2"


def test_broken_and_empty():
    assert Page(None).text([]) == "" and Page("").text([]) == ""
    assert Page("<article><p>open <b>bold <p>next</b> tail").text([]) == "open bold next tail"
    assert Page("a < b <i>c</i> & d <unclosed").text([]) == "a < b c & d <unclosed"
    assert Page("<p>a<!-- x <p> --><p>b<!-- open").text([]) == "a b"
    assert Page("<div " + 'x="' * 20000).text([]) is not None
    assert Page("<p>" * 300 + "deep").text([]) == "deep"


def brute_match(a, b):
    """Simple tree matching by trying every order-keeping choice of kids."""
    if a.tag != b.tag:
        return 0
    best = 0
    n = min(len(a.kids), len(b.kids))
    for k in range(n + 1):
        for x in itertools.combinations(range(len(a.kids)), k):
            for y in itertools.combinations(range(len(b.kids)), k):
                parts = [brute_match(a.kids[i], b.kids[j]) for i, j in zip(x, y)]
                if all(parts):
                    best = max(best, sum(parts))
    return 1 + (a.text == b.text) + best


def test_matching_against_brute_force():
    rng = random.Random(2)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return Tree(rng.choice("ab"), rng.choice("xyz"), kids, 0)

    for _ in range(60):
        a, b = tree(2), tree(2)
        a.tag = b.tag = "r"
        assert _match(a, b, {}) == brute_match(a, b)


def rows_without_article():
    out = []
    for n in range(12):
        body = (f"<div class=top><p>Welcome to the site of all things</p></div><div><h2>Story {n}</h2><p>Unique words {n} "
                f"{'tell ' * (n + 3)}</p><p>More {n * 7} of it</p></div><div><p>All rights are ours for ever</p></div>")
        out.append((n, f"http://Host.example/{n}", page(n, body)))
    return out


def test_template_is_dropped_without_article(spark):
    rows = rows_without_article() + [(50, None, None), (51, "http://alone.example/", page(1, "<div><p>Only page</div>")),
                                     (None, "http://x.example", "<p>no id</p>"), (3, *rows_without_article()[3][1:]),
                                     (60, "http://host.example/copy", rows_without_article()[5][2])]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id bigint, url string, html string, host string, h int")
    got = {}
    for r in extract_pages(df).collect():
        got.setdefault(r["id"], []).append(r["text"])
    for n in range(12):
        want = f"Story {n} Unique words {n} {'tell ' * (n + 3)}".strip() + f" More {n * 7} of it"
        assert set(got[n]) == {want}
    assert len(got[3]) == 2 and got[60] == got[5]
    assert got[50] == [""] and got[51] == ["Only page"] and got[None] == ["no id"]


def test_template_inside_an_article_loses_its_menus():
    """Constant blocks of links within article or main are menus; constant prose and a page's own links are not."""
    for tag in ("article", "main"):
        def of(n, tag=tag):
            return Page(page(n, f"<{tag}><ul><li><a href=/a>Latest news</a><li><a href=/b>All of it</a></ul><h1>Head {n}</h1>"
                                f"<p>Free licence for all</p><p>Words {n} {'tell ' * (n + 3)}</p><p><a href=/{n}>See {n}</a></p></{tag}>"))
        want = f"Head 4 Free licence for all Words 4 {'tell ' * 7}".strip() + " See 4"
        assert of(4).text([of(1), of(2), of(3)]) == want
        assert of(4).text([]) == "Latest news All of it " + want


def test_deep_pages():
    """Elements nested or left open 5,000 deep are pages like others."""
    for html in ("<div>" * 5_000 + "deep", "<div>" * 5_000 + "deep" + "</div>" * 5_000, "<p>" + "<font>" * 5_000 + "deep",
                 "<article>" + "<a name=x>" * 5_000 + "deep", "<main>" + "<ul><li>" * 5_000 + "deep"):
        page_, other = Page(html), Page(html.replace("deep", "other"))
        assert page_.text([other, Page(html)]) in ("deep", "")
        assert Page(html).text([]) == "deep"


def test_wide_pages_align_in_time():
    """Long runs of equal siblings at both ends cost no table of all pairs."""
    rows = "".join(f"<div><p>row {i}</p></div>" for i in range(20_000))
    a, b = Page(rows + "<div><p>mine</p></div>" + rows), Page(rows + "<div><p>theirs</p></div><div><p>x</p></div>" + rows)
    same = constants(a.outline, b.outline)
    text = {id(x.node): x.text for x in a.blocks}
    assert [t for n, t in text.items() if n not in same] == ["mine"] and len(same) == 40_000


def test_equal_ends_do_not_change_the_matching():
    """Trees that share beginnings and ends match as by brute force."""
    rng = random.Random(6)

    def tree(depth):
        return Tree(rng.choice("ab"), rng.choice("xy"), [tree(depth - 1) for _ in range(rng.randint(0, 2))] if depth else [], 0)

    for _ in range(60):
        head, tail = [tree(1) for _ in range(rng.randint(0, 2))], [tree(1) for _ in range(rng.randint(0, 2))]
        a, b = (Tree("r", "", head + [tree(1) for _ in range(rng.randint(0, 2))] + tail, 0) for _ in range(2))
        assert _match(a, b, {}) == brute_match(a, b)


def test_hot_host_is_salted(spark):
    rows = [(k, "http://hot.example/p", page(k, f"<article><p>Text {k}</article>")) for k in range(1200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted((r["id"], r["text"]) for r in extract_pages(df).collect()) == [(k, f"Text {k}") for k in range(1200)]


def test_empty(spark):
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
