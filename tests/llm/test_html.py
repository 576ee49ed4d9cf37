"""Templates of hosts made for the tests: what is kept is known."""

import random

import pytest

pytest.importorskip("tallyframe.llm.queries")
from tallyframe.llm import html_extract  # noqa: E402

SHAPE = "page_id long, url string, html string, main string, fixed string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def extract(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SHAPE)
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def test_template_alone_separates_unnamed_slots(spark):
    r, rows, want = random.Random(1), [], {}
    for i in range(30):
        body = [words(r, 12) for _ in range(r.randint(1, 5))]
        html = "<html><body><div><div>Home of all things</div><div>One Two Three</div></div>"
        html += "<div><div>" + "".join(f"<p>{p}</p>" for p in body) + "</div><div>All texts may be read by all</div></div><div>Made by us in the year</div></body></html>"
        rows.append((i, f"http://plain.example/{i}", html))
        want[i] = "\n".join(body)
    assert extract(spark, rows) == want


def test_fixed_text_inside_articles_goes(spark):
    r, rows, want = random.Random(2), [], {}
    for i in range(20):
        a, b = words(r, 20), words(r, 20)
        rows.append((i, f"http://n.example/{i}", f"<body><nav>menu</nav><article id='post-{i}' class='post-{i}'><h1>Title {i}</h1><p>{a}</p><section>Send this text to all you know</section><p>{b}</p></article></body>"))
        want[i] = f"Title {i}\n{a}\n{b}"
    # a page of the host without an article is read by its own tags
    rows.append((99, "http://n.example/x", "<body><nav>menu</nav><div>only this</div></body>"))
    assert extract(spark, rows) == want | {99: "only this"}


def test_a_host_of_copies_keeps_its_text(spark):
    page = "<body><article><h1>Same</h1><p>text on all pages</p></article><footer>f</footer></body>"
    assert set(extract(spark, [(i, f"http://c.example/{i % 4}", page) for i in range(9)]).values()) == {"Same\ntext on all pages"}


def test_repeated_rows_do_not_cancel_out(spark):
    r = random.Random(3)
    rows = [(i, "http://r.example/", f"<body><div>Fixed words here</div><div><p>{words(r, 9)}</p><p>{words(r, 9)}</p></div></body>") for i in range(8)]
    once, twice = extract(spark, rows), extract(spark, rows + rows)
    assert once == twice and all("Fixed" not in t and t.count("\n") == 1 for t in once.values())


def test_classes_nest(spark):
    rows = [("h", str(i), f"<html><body><main><p>{i} a</p></main><ul>" + "<li>x</li>" * (i % 3) + "</ul></body></html>") for i in range(9)]
    got = {r.path: r for r in html_extract.templates(spark.createDataFrame(rows, "host string, page string, html string")).collect()}
    assert got["/html"]["class"] == got["/html/body/main/p"]["class"] == "/html" and got["/html"].valid
    assert got["/html/body/ul/li"]["class"] == "/html/body/ul/li" and not got["/html/body/ul/li"].valid
    assert {p for p, r in got.items() if r.keep} == {"/html/body/main", "/html/body/main/p"} and got["/html"].main == "/html/body/main"


def test_odd_pages(spark):
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    rows = [(1, None, None), (2, "u", ""), (3, "http://b.example/", "plain <i>text</i>"), (4, "http://b.example/", "a < b &amp; c <p"), (5, "x", deep), (None, "http://z.example", "<p>no id")]
    got = extract(spark, rows)
    assert got == {1: "", 2: "", 3: "plain text", 4: "a < b & c <p", 5: "deep", None: "no id"}
    assert extract(spark, []) == {}
