import random
import re

from pyspark.sql import functions as F

from tarnmill.llm import html_text
from tarnmill.llm.html_text import extract_text, main_text
from tarnmill.llm.queries import op10_html_text

SF = "/root/testdata/sf0.01"


def test_pages_of_the_table(spark):
    """The articles of these pages are headings and paragraphs, which a plain cut finds as well."""
    import html

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)\b[^>]*>", body)]
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    rows = op10_html_text(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_rules():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav>menu</nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; more</h1></header>
    <p>One <b>bold<br>line<p>Two&nbsp;two<ul><li>a<li>b</ul><aside>side</aside><div class="ad">buy</div><script>var x="</p>";</script>
    <table><tr><td>x<td>y</table><form>f</form><!-- c --><p>3 < 4 &lt;i&gt;</p><section id="comments">mine</section></article></main><footer>foot</footer></body>"""
    assert main_text(page) == "Head & more\n\nOne bold line\n\nTwo two\n\na\n\nb\n\nx\n\ny\n\n3 < 4 <i>"
    assert main_text("") == "" and main_text("plain") == "plain" and main_text("<p>a<") == "a<" and main_text("<p>a<b") == "a"
    assert main_text("<div>" * 5000 + "deep") == "deep" and main_text("<p x='" + "y" * 10) == ""


def test_templates_go_articles_stay(spark, monkeypatch):
    same = "<p>The same paragraph on every page</p>"
    rows = [(k, f"http://a.example/{k}", f"<body><div><span>Welcome to our site</span></div><div><p>Text number {k}</p></div>") for k in range(12)]
    rows += [(100 + k, f"http://b.example/{k}", f"<body><article>{same}<ul><li><a href=/>more</a></ul><p>own {k}</p></article>") for k in range(12)]
    rows += [(200, "http://c.example/", "<body><div><span>Welcome to our site</span></div>"), (300, None, None), (301, "::bad//[", ""), (301, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("h")).withColumn("key", F.lit("k"))
    for limit in (10**6, 0):
        monkeypatch.setattr(html_text, "BROADCAST_HASHES", limit)
        got = {r.page_id: r.text for r in extract_text(df).collect()}
        assert got[3] == "Text number 3" and got[104] == "The same paragraph on every page\n\nown 4"
        assert got[200] == "Welcome to our site" and got[300] == got[301] == ""


def test_empty(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rules_of_names_and_left_out_tags():
    assert main_text("<html><head><title>T</title><body><p>hi there</p></body></html>") == "hi there"
    assert main_text("<title>T</title><meta charset=utf-8><p>hi") == "hi"
    page = "<article><h1 class=banner>a</h1><div class='share-price'>5</div><div class='share-buttons'>x</div><p id=ads>b</p></article>"
    assert main_text(page + "<article class=comment>no</article>") == "a\n\n5\n\nb"
    assert main_text("<div class='comment-list'><article>c</article></div><main>m</main>") == "m"


def test_templates_are_the_only_cue(spark):
    """No tag, role or class tells the template's parts: only that they recur on pages with other articles."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(6):
        frame, inner, notice = text(8), text(6), text(5)
        for k in range(5 + 3 * h):
            blocks = [text(rng.randrange(8, 30)) for _ in range(rng.randrange(2, 5))]
            own = f"<section><div>{text(3)}</div></section>"
            body = "".join(f"<p>{b}</p>" for b in blocks)
            if h % 2:
                page = f"<div><p>{frame}</p></div><article>{body}<section><div>{inner}</div></section>{own}</article><p>{notice}</p>"
            else:
                page = f"<div><p>{frame}</p><div>{inner}</div></div>{body}{own}<div>{notice}</div>"
            rows.append((len(rows), f"https://h{h}.example/{k}", page))
            want[len(rows) - 1] = "\n\n".join([*blocks, re.search(r"<section><div>([^<]*)</div></section>(?!<section)", page[page.index(own) :])[1]])
    copies = "<article><p>one two three four five six seven</p><div><b>eight</b></div></article>"
    rows += [(1000 + k, "https://copies.example/", copies) for k in range(30)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in want} == want
    assert all(got[1000 + k] == "one two three four five six seven\n\neight" for k in range(30))


def test_clashing_columns_and_a_bound_on_pages(spark, monkeypatch):
    rows = [(k, f"http://a.example/{k}", f"<div><i>frame of the site</i></div><p>text {k}</p>{'<div>a quarter</div>' if k % 4 == 0 else ''}") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("_host", "_key", "_templates", "row", "article"):
        df = df.withColumn(name, F.lit(name))
    for limit in (10**6, 0):
        monkeypatch.setattr(html_text, "BROADCAST_HASHES", limit)
        for r in extract_text(df).collect():
            assert r.text == f"text {r.page_id}" and (r._host, r._key, r._templates, r.row, r.article) == ("_host", "_key", "_templates", "row", "article")


def _site(body, n=9, host="plain.example"):
    return [(k, f"https://{host}/{k}", body(k)) for k in range(n)]


def test_own_text_without_an_article_stays(spark, monkeypatch):
    """Inline words, paragraphs, cells and blocks amid the text recur on every page; only the frame goes."""
    body = lambda k: (
        f"<div>Menu of the site</div><div class=text><p>Page {k} has its own words. <b>Note</b> that it matters {k}.</p><p>Yes.</p><table><tr><td>Price</td><td>{k} coins</td></tr></table>"
        f"<p>More of page {k}.</p><div>As ever.</div><p>End of page {k}.</p></div><div>All rights are ours</div>"
    )
    df = spark.createDataFrame(_site(body), "page_id long, url string, html string")
    for limit in (10**6, 0):
        monkeypatch.setattr(html_text, "BROADCAST_HASHES", limit)
        for r in extract_text(df.union(df)).collect():
            k = r.page_id
            assert r.text == f"Page {k} has its own words. Note that it matters {k}.\n\nYes.\n\nPrice\n\n{k} coins\n\nMore of page {k}.\n\nAs ever.\n\nEnd of page {k}."


def test_hidden_parts_and_telling_names():
    page = "<article><p>a</p><div style='DISPLAY:NONE'>x</div><p class=ad>x</p><p class='cookie-notice'>x</p><div class='user-comments'>x</div><section id=respond>x</section><p class=intro>b</p></article>"
    assert main_text(page) == "a\n\nb"
    assert main_text("<div><p>a</p></div><div class='site-footer'>x</div><span aria-hidden=TRUE>x</span>") == "a"


def test_long_page_in_proportion(spark):
    body = "".join(f"<div><p>block {k}</p></div>" for k in range(30_000))
    rows = [(k, f"https://long.example/{k}", f"<div>frame</div>{body}<p>{k}</p>") for k in range(2)]
    assert all(len(r.text.split("\n\n")) == 30_002 for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
