import json
import random
import time
import zlib
from hashlib import blake2b

from pyspark.sql import functions as F

from hookloom.llm import html
from tests.llm.edges import no_pages, pages, rows_of


def page(i):
    return f"""<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style></head><body class="has-sidebar">
<div id="top-menu"><a href="/">Home</a></div><div class="wrap"><div class="cookie-notice">We use cookies</div>
<div class="content"><h1>Title {i}</h1><p>First text {i} &amp; more &lt;{i * 7}&gt;&nbsp;end.<script>var t="</p>";</script>
<div class="advert">Buy!</div><p>Second <b>text</b><br>of {i}<ul><li>one {i}<li>two {i}</ul></div>
<div class="rail"><p>Read our letters every day, they are free and long and good for you</p></div></div>
<div id="comments"><p>Nice {i}</p></div><form><input><label>Mail</label></form><footer>foot</footer></body></html>"""


def want(i):
    return f"Title {i}\n\nFirst text {i} & more <{i * 7}> end.\n\nSecond text of {i}\n\none {i}\n\ntwo {i}"


ARTICLE = (
    "<nav>menu</nav><aside>side</aside><article><header><h1>Head</h1><span>by me</span></header>"
    "<p>a <i>b</i>\n c<p><b>d<br><p>e</p><div class='comments'><p>no</p></div><footer>x</footer></article><footer>f</footer>"
)


def test_texts(spark):
    own = [(f"http://site.org/{i}", page(i)) for i in range(8)]
    others = [("http://x.org/", ARTICLE), ("http://x.org/2", "plain words"), ("http://x.org/3", "<p>a<!-- b --> c<!-- d")]
    table = pages(spark, *own, *others)
    rows = html.html_report(table).collect()
    assert len(rows) == table.count() and rows[0].asDict().keys() >= {"page_id", "url", "text", "n_chars"}
    got = {r["page_id"]: r["text"] for r in rows}
    assert [got[i + 1] for i in range(8)] == [want(i) for i in range(8)]
    assert got[9] == "Head\n\na b c\n\nd\n\ne" and got[10] == "plain words" and got[11] == "a c"
    assert got[902] == "" and got[903] == "" and got[901] == "no address" and got[904] == "twice"
    assert got[905] == "word " * 99_999 + "word"
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_empty_table(spark):
    assert html.html_report(no_pages(spark)).collect() == []


def shape(tokens):
    return [(t[html.TEXT] == html.SLOT, t[html.OPTIONAL], t[html.REPEATED], t[html.PAGES]) for t in tokens]


def wrapper(*contents):
    whole = html.page_tokens(contents[0])
    for content in contents[1:]:
        whole = html.align(whole, html.page_tokens(content))
    return whole


def test_wrapper_aligns_optional_and_repeated_parts():
    a = "<body><h1>x</h1><p>a</p><p>b</p><div class='box'>k</div></body>"
    b = "<body><h1>y</h1><p>c</p><table><tr><td>1</td></tr></table><div class='box'>k</div></body>"
    whole = wrapper(a, b, a.replace(">x<", ">z<"))
    # A title slot, a repeated slot for paragraphs, an optional table and a constant box.
    assert shape(whole) == [(True, 0, 0, 3), (True, 0, 1, 3), (False, 1, 0, 1), (False, 0, 0, 3)]
    plan = html.wrapper_plan(whole, 3)
    body = html.read_page(a)[0][0].parent
    assert plan["main"] == body.path and [pages for _, _, pages in plan["fixed"]] == [3]


def lcs(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for at, y in enumerate(b):
            row.append(before[at] + 1 if x == y else max(before[at + 1], row[-1]))
    return row[-1]


def test_alignment_of_small_streams_matches_the_table():
    """Anchors are a longest common subsequence where tokens are unique; nothing is lost or put out of order."""
    draw = random.Random(4)
    for _ in range(300):
        a, b = (draw.sample(range(12), draw.randint(0, 9)) for _ in range(2))
        one, other = ([[x % 3, x, 1, 0, 0, 5, 0, 0, 9] for x in side] for side in (a, b))
        found = html._anchors(one, other)
        assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found)
        whole = html.align(one, other)
        constant = [t[html.TEXT] for t in whole if t[html.TEXT] != html.SLOT and t[html.PAGES] == 2]
        assert constant == [a[i] for i, _ in found]
        # Each path is as frequent as on either side, unless tokens that follow each other were folded.
        for path in range(3):
            count = sum(t[html.PATH] == path for t in whole)
            assert bool(count) == any(x % 3 == path for x in a + b)
        # Aligning a wrapper with what it was made of adds nothing but counts.
        again = html.align(whole, one)
        assert [t[html.PATH] for t in again] == [t[html.PATH] for t in whole] or len(again) <= len(whole) + len(one)


def unmarked(i):
    text = f"story {i} " * 20
    return (
        "<div><div><p>Weather today is fine in every town of the land and we say so at length on all pages, "
        f"again and again</p></div><div><p>{text}</p><p>{text}more</p></div></div>"
    )


def test_wrapper_finds_the_article_without_marks():
    plan = html.wrapper_plan(wrapper(*map(unmarked, range(5))), 5)
    own = f"{'story 3 ' * 20}".strip() + "\n\n" + f"{'story 3 ' * 20}more"
    assert html.main_text(unmarked(3), plan) == own
    short = "<div>" + unmarked(0).split("</div>")[0][5:] + "</div><div><p>a short story</p></div></div>"
    assert html.main_text(short).startswith("Weather") and html.main_text(short, plan) == "a short story"


def marked(i):
    return (
        f"<body><article><h1>Title {i}</h1><p>{f'words of {i} ' * 30}</p><p>Sign up for our paper letter</p>"
        f"<p>{f'more on {i} ' * 30}</p></article></body>"
    )


def test_wrapper_decides_inside_marked_articles():
    """What all pages share goes; not where it is much of the article, nor where pages are few."""
    plan = html.wrapper_plan(wrapper(*map(marked, range(6))), 6)
    with_plan, without = html.main_text(marked(2), plan), html.main_text(marked(2))
    assert "letter" in without and with_plan == without.replace("Sign up for our paper letter\n\n", "")
    few = html.wrapper_plan(wrapper(*map(marked, range(3))), 3)
    assert html.main_text(marked(2), few) == without
    short = [f"<article><h1>T {i}</h1><p>The same long notice on all of the pages here</p></article>" for i in range(6)]
    plan = html.wrapper_plan(wrapper(*short), 6)
    assert html.main_text(short[1], plan) == html.main_text(short[1])


def test_class_names_count_whole():
    long = "plain words of an article " * 10
    for name in ("layout with-sidebar", "has-sidebar content", "search-result", "social-science article-body", "ad-hoc-report"):
        assert html.main_text(f"<body><div class='{name}'><p>{long}</p></div></body>") == long.strip()
    for name in ("sidebar", "cookie-notice", "site-footer", "related-posts", "top-menu", "comment-list", "ad ad-slot", "shareButtons"):
        assert html.main_text(f"<body><div class='{name}'><p>{long}</p></div><p>own</p></body>") == "own"
    # Marked articles count, whatever holds them; their own header keeps the title.
    assert html.main_text(f"<div class='content-sidebar-wrap'><article><p>{long}</p></article></div>") == long.strip()
    page = f"<article><div class='entry-header'><h1>Head</h1><span>by me</span></div><p>{long}</p></article>"
    assert html.main_text(page) == f"Head\n\n{long.strip()}"


def test_texts_do_not_depend_on_the_order_of_pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", (marked, unmarked, page)[i % 3](i)) for i in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = rows_of(html.html_report(table.repartition(3)))
    assert first == rows_of(html.html_report(table.orderBy(F.desc("page_id")).repartition(7)))
    texts = {r[0]: r[2] for r in first}
    assert all("letter" not in text for text in texts.values())
    assert any("letter" in html.main_text(r[2]) for r in rows)


def test_awkward_markup_takes_linear_time():
    start = time.time()
    for piece in ('<a "', "<div>", "<!--", "<", "<p ", "<p class='", "<li>a", "</p>", "<script>", "<td>x"):
        content = piece * (200_000 // len(piece))
        for text in (content, content + ">"):
            html.main_text(text)
            tokens = html.page_tokens(text)
            html.align(tokens, html.page_tokens(text.replace("x", "y") + "<p>z"))
    assert time.time() - start < 60


def test_a_long_wrapper_keeps_texts_that_meet_their_like_later(spark):
    def page(name, own=""):
        return f"<body>{own}<section class='body'><p>Words of {name} alone.</p></section>"

    def mark(content):
        tokens = json.dumps(html.page_tokens(content), separators=(",", ":"))
        return int.from_bytes(blake2b(tokens.encode(), digest_size=8).digest(), signed=True)

    shared = "<section class='tail'><div>Read in all places</div></section>"
    paths = "".join(f"<div class='k{''.join(chr(97 + int(d)) for d in str(i))}'>line {i}</div>" for i in range(4200))
    # The long page comes first, and no other has its parts.
    long = min((page(name, paths) for name in "defg"), key=mark)
    first = mark(long)
    short = [content for i in range(200) if mark(content := page(f"a{i}") + shared) > first][:3]
    assert len(short) == 3
    table = spark.createDataFrame([("h", content) for content in [*short, long]], "host string, html string")
    plan = json.loads(html.infer_wrappers(table).first()["plan"])
    assert zlib.crc32(b"Read in all places") in {text: pages for _, text, pages in plan["fixed"] if pages == 3}
