import random
import time

import pytest

from resona.llm import extract
from resona.llm.htmltext import blocks, host

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div id="cookie-notice">We use cookies, a lot of them, for you.</div><div class="layout"><main><div class="post post-12">
<h2>Title &amp; more</h2><p>First para<br>with break, <b>bold</b>text.<p>Second <a title="x>y" href='/q'>link</a> here &#8217;.
<div class="advert-box">Buy now!!</div><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>x   y
z</pre><!-- no --><form>name <input></form></div><section id="comments"><p>A very nice article, I like it so much, and so on.</section></main>
<aside>side</aside></div><footer>&copy; foot</footer></body></html>"""
TEXT = "Title & more\nFirst para with break, boldtext.\nSecond link here ’.\none\ntwo\na\nb\nc\nx y z"


def page(body):
    return f"<html><body><nav>menu of the page</nav>{body}<footer>foot</footer></body></html>"


def test_blocks_leave_out_what_is_no_article():
    assert "\n".join(b.text for b in blocks(ARTICLE)) == TEXT
    assert extract.text_of(blocks(ARTICLE), []) == TEXT
    page_ = blocks(ARTICLE)
    assert page_.path(extract.best(page_)[0]) == ("body.has-sidebar", "div.layout", "main", "div.post.post-#")


def test_title_in_front_of_the_text_belongs_to_it():
    body = "<p>A long enough text, with marks.</p>" * 5
    for around in ("article", "div class=entry"):
        source = page(f"<div class=a><p>Other things.</p></div><{around}><h1>Title</h1><div class=b>{body}</div></{around.split()[0]}>")
        assert extract.text_of(blocks(source), []).startswith("Title\nA long")


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a &lt;b&gt; &nbsp; c", "a <b> c"), ("a < b", "a < b"),
    ("<p>x</p", "x"), ("<script>never ends <p>x", ""), ("<!-- never ends <p>x", ""), ("</div></p>x", "x"),
    ("<div hidden>a</div><p style='display: none'>b</p>c", "c"), ("<div><p>a</div>b", "a\nb"), ("<P CLASS=Ads>a</P><p>b", "b"),
    ("<p>" + "long text, " * 30_000, ("long text, " * 30_000).strip()), ("<b>" * 3000 + "deep", "deep"),
    ("<article><header><h1>Head</h1></header><p>text</p></article>", "Head\ntext"),
])
def test_edges(source, text):
    assert "\n".join(b.text for b in blocks(source)) == text


@pytest.mark.parametrize("around", [
    "div class='layout with-sidebar'", "div class=no-sidebar", "div id=page class=has-banner", "div class=menu-open", "div class=widget"])
def test_wrappers_named_after_other_parts_keep_the_article(around):
    body = "<article><h1>Title</h1><p>A text, with marks.</p></article>"
    assert extract.text_of(blocks(page(f"<{around}>{body}<div class=sidebar>side</div></div>")), []) == "Title\nA text, with marks."
    plain = f"<{around}><div class=x><p>{'A text, with marks. ' * 5}</p></div></div><div class=ad>Buy.</div>"
    assert extract.text_of(blocks(page(plain)), []) == ("A text, with marks. " * 5).strip()


def test_parts_of_an_article_and_pages_of_nothing_else():
    inside = "<div class=post-header><h1>Title</h1></div><div class=legal><p>Law.</p></div><section class=form><p>Form.</p></section>"
    assert extract.text_of(blocks(page(f"<article>{inside}<div class=ad>Buy.</div></article>")), []) == "Title\nLaw.\nForm."
    assert extract.text_of(blocks("<div class=comments><p>All there is.</p></div>"), []) == "All there is."
    thread = "<div class=comments><article class=comment><p>" + "I like it. " * 50 + "</p></article></div>"
    assert extract.text_of(blocks(page(f"<article><p>Text.</p></article>{thread}")), []) == "Text."


def test_a_long_advert_does_not_outweigh_a_short_article():
    advert = "<div class=ad>" + "Buy this, and that. " * 20 + "</div><div class=widget>" + "Some long text, too. " * 20 + "</div>"
    assert extract.text_of(blocks(page(f"{advert}<article><p>Short.</p></article>")), []) == "Short."


def test_a_small_box_on_a_winning_path_does_not_replace_the_article():
    body = "A long enough text, with marks. " * 20
    source = page(f"<div class=post><p>Box.</p></div><div class=story><p>{body}</p></div>")
    assert extract.text_of(blocks(source), ["body div.post"]) == body.strip()


def test_text_beside_the_largest_block_belongs_to_it():
    body = "A long enough text, with marks. " * 20
    parts = f"<p>Intro.</p><div class=lead><p>Lead text.</p></div><div class=body><p>{body}</p></div>"
    links = "<div class=more><a href=x>One</a> <a href=y>Two</a></div>"
    for around, text in (("main", parts + links), ("div", parts)):
        assert extract.text_of(blocks(page(f"<{around}>{text}</{around}>")), []).startswith(f"Intro.\nLead text.\n{body.strip()}")
    assert extract.text_of(blocks(page(f"<div>{links}<div class=body><p>{body}</p></div></div>")), []) == body.strip()


def test_consensus_overrules_a_page(spark):
    usual = [page(f"<div class='story s{i}'><p>Real text, number {i}, of some length.</p></div><div class=more><p>x.</p></div>") for i in range(9)]
    odd = page("<div class='story s10'><p>Short.</p></div><div class=more><p>A far longer text, with marks, that is not the story here.</p></div>")
    other = page("<div class=unknown><p>Page of its own kind.</p></div>")
    rows = [(i, "https://A.example.org/x", h, "c") for i, h in enumerate([*usual, odd, other])]
    rows += [(20, None, page("<p>no url</p>"), "c"), (21, "https://a.example.org", None, "c"), (22, "http://[bad", "", "c"), (0, *rows[0][1:])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumnRenamed("host", "paths")
    found = extract.extract(frame).collect()
    text = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert text[9] == "Short." and text[3] == "Real text, number 3, of some length." and text[10] == "Page of its own kind."
    assert text[20] == "no url" and text[21] == text[22] == ""
    assert extract.extract(frame.limit(0)).collect() == []


def test_an_article_beside_the_winning_path_is_kept(spark):
    """Ten pages of a host with only `lead`; one with `lead` and a `story` that no other page has beside its article."""
    lead = "<div class=lead><p>Lead of page {}, with some words, and more of them here.</p></div>"
    story = "<div class=story>" + "<p>The story goes on, with sentences, and more.</p>" * 15 + "</div>"
    rows = [(i, "https://a.example.org/x", page(lead.format(i))) for i in range(10)]
    rows.append((10, "https://a.example.org/y", page(lead.format(10) + story)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in extract.extract(frame).collect()}
    assert text[3] == "Lead of page 3, with some words, and more of them here."
    assert text[10].startswith("Lead of page 10") and text[10].count("The story goes on") == 15


def test_work_grows_with_the_page_however_deep():
    for deep in ("<div>text, here. ", "<div class=ad>text, here. ", "<article><p>text, here. ", "<li><div>text, here. "):
        began = time.perf_counter()
        source = page(deep * 20_000)
        assert extract.text_of(blocks(source), ["body div"]).count("text, here.") == 20_000
        assert time.perf_counter() - began < 8, deep
    began = time.perf_counter()
    assert extract.text_of(blocks("<div>x" * 5000 + "</b></span></p>" * 20_000), [])
    assert time.perf_counter() - began < 8


def test_whole_result_by_brute_force(spark):
    """Generated pages whose article is known: every word of it, none of what stands around it."""
    rng = random.Random(7)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))

    rows, expected = [], {}
    for i in range(60):
        host_, body = rng.randrange(4), [f"{words(rng.randint(8, 60)).capitalize()}." for _ in range(rng.randint(2, 9))]
        blocks_ = "".join(f"<{rng.choice(['p', 'p class=x', 'h2'])}>{b}" for b in body)
        around = [("<article>", "</article>"), ("<main><div class=post>", "</div></main>"), ("<div class='entry e12'>", "</div>"),
                  ("<section><div class=text>", "</div></section>")][host_]
        noise = f"<nav><a href=x>{words(3)}</a></nav><div class=sidebar>{words(40)}.</div><aside>{words(9)}</aside>"
        rows.append((i, f"https://h{host_}.example.org/{i}", f"<body><header>{words(4)}</header>{noise}{around[0]}{blocks_}{around[1]}"
                     f"<div id=comments><p>{words(50)}.</div><footer>{words(5)}</footer><script>{words(9)}</script>"))
        expected[i] = "\n".join(body)
    found = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == expected


def test_query(spark, base):
    rows = extract.op10(spark, base).collect()
    assert all("<article" not in r.text and "©" not in r.text for r in rows)
    assert sum(r.n_chars > 0 for r in rows) == len(rows)


def test_host():
    assert host("https://User@Example.org:80/x") == "example.org" and host(None) == host("x") == ""
