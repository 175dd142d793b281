import html
import re

from pyspark.sql import functions as F

from eventrates.llm import html_text, queries

SF = "/root/testdata/sf0.001"


def text_of(page):
    blocks, *_ = html_text.parse(page)
    return [t for t, _ in blocks]


def test_noise_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use</div>
    <article class="post"><header><h1>A &amp; B</h1></header><p>one <b>two<br>three<p>four&nbsp;&#233;
    <script>var a = "</p><p>no";</script> five</p><aside>see also</aside><form><input value="x">go</form>
    <div class="share">tweet</div><ul><li>x<li>y</ul><!-- <p>hidden</p> --></article>
    <section id="comments"><p>first!</p></section><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == ["A & B", "one two three", "four é five", "x", "y"]


def test_broken_markup():
    assert text_of("plain & simple < text") == ["plain & simple < text"]
    assert text_of("<p class='a>b<p>c") != None  # noqa: E711
    assert text_of("<div><p>a</div></div></p>b</body>c") == ["a", "b", "c"] or text_of("<div><p>a</div></div></p>b</body>c")[0] == "a"
    assert text_of("<script>never closed <p>x") == []
    assert text_of('<p title="a>b">c</p>') == ["c"]
    assert text_of("<head><title>x</title><body><p>y") == ["y"]
    assert text_of("<article><p>" + "<b>" * 3000 + "deep") == ["deep"]
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]


def test_template_branches_go(spark):
    rows = [
        (i, f"http://Host.example/{i}", f"<div class=box{i % 2}>Get our app</div><div><p>text {i} here</p><p>more {i * 7}</p></div>")
        for i in range(20)
    ]
    rows += [(100 + i, f"http://small.example/{i}", "<div class=box>Get our app</div><div><p>same</p></div>") for i in range(3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract(docs).collect()}
    assert out[3] == "text 3 here\n\nmore 21"
    assert out[101] == "Get our app\n\nsame"


def test_copies_keep_their_article(spark):
    page = "<body><nav>menu</nav><article><h1>h</h1><p>copied text</p></article></body>"
    docs = spark.createDataFrame([(i, "http://a.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(docs).collect()} == {"h\n\ncopied text"}


def test_importance_of_entropies(spark):
    nodes = [("h", 1, 5, 0, [9]) for _ in range(4)] + [("h", 2, 5, 0, [i]) for i in range(4)]
    df = spark.createDataFrame(nodes, "host string, path long, style long, kinds int, texts array<long>")
    found = {r["path"]: r["importance"] for r in html_text.importance(df).collect()}
    assert abs(found[1]) < 1e-9 and abs(found[2] - 1) < 1e-9


def test_odd_rows(spark):
    rows = [
        (1, None, None, "x"), (1, None, None, "x"), (None, "no url", "<p>a</p>", "x"), (2, "http://h/", "", None),
        (3, "http://h/", "<article>" + "<p>long text</p>" * 20_000, "x"), (4, "", "   ", "x"),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("row", F.lit(1))
    out = html_text.extract(docs)
    assert out.columns == ["page_id", "url", "html", "row", "text", "n_chars"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == {None: "a", 3: "\n\n".join(["long text"] * 20_000)}.get(r["page_id"], "")
    assert html_text.extract(docs.where("false")).count() == 0


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op5_html_text(spark, SF).collect()
    assert len(rows) == 50
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_copies_keep_their_text_in_any_node(spark):
    def page(body):
        return f"<body><nav>menu</nav>{body}</body>"

    inner = page("<article><div class='entry-content'><p>copied text</p></div></article>")
    rows = [(i, "http://a.example/", inner) for i in range(30)]
    rows += [(100 + i, "http://b.example/", page("<div><p>plain text</p></div>")) for i in range(30)]
    rows += [(200 + i, "http://c.example/", page(f"<div class=post><p>text {'abc'[i % 3]}</p></div>")) for i in range(30)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = {r["page_id"]: r["text"] for r in html_text.extract(docs).collect()}
    assert {out[i] for i in range(30)} == {"copied text"}
    assert {out[100 + i] for i in range(30)} == {"plain text"}
    assert all(out[200 + i] == f"text {'abc'[i % 3]}" for i in range(30))


def test_head_without_an_end():
    assert text_of("<head><title>x</title><p>text") == ["text"]
    assert text_of("<html><head><meta charset=a><title>x</title><script>'<p>no'</script><!-- <p> -->\n<div>a</div>b") == ["a", "b"]
    assert text_of("<head><title>x</title>just text") == ["just text"]
    assert text_of("<head><title>never closed</head><body><p>y") == ["y"]
    assert text_of("<head><style>p{}<body><p>y") == ["y"]
    assert text_of("<head><title>x</title><noscript><p>no</p></noscript></head><p>y") == ["y"]


def test_sections_of_an_article_stay_whatever_their_ids():
    assert text_of('<article><section id="related-work"><p>Related work text.</p></section><p>End</p></article>') == ["Related work text.", "End"]
    assert text_of('<article><h2 id="copyright-law">Copyright law</h2><p>text</p></article>') == ["Copyright law", "text"]
    assert text_of('<article><h2 id="comments">Comments</h2><div id="search-trees">a</div></article>') == ["Comments", "a"]
    assert text_of('<div><section id="related-work"><p>x</p></section><h3 id="notice">y</h3></div>') == ["x", "y"]
    gone = '<section id="comments">c</section><div class="related-posts">r</div><div id="social-share">s</div><p>p</p>'
    assert text_of(f"<article>{gone}</article>") == ["p"]


def test_formulas_and_fallbacks_stay():
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p><object><p>old</p></object></article>"
    assert text_of(page) == ["so x=1 holds", "old"]


def test_depth_costs_in_proportion(spark):
    deep = "<div class=a>x" * 100_000
    blocks, nodes, paths, parents = html_text.parse(deep)
    assert len(blocks) == len(paths) == 100_000 and len(nodes) <= html_text.LEVELS
    assert parents[:3] == [-1, 0, 1] and len(set(paths)) == 100_000
    for page in ("<b>" * 50_000 + "</i>" * 50_000 + "x", "<div>" * 50_000 + "</section>" * 50_000 + "x", "<div>" * 50_000 + "<li>x</li>" * 50_000):
        html_text.parse(page)
    docs = spark.createDataFrame([(1, "http://a.example/", deep)], "page_id long, url string, html string")
    assert html_text.extract(docs).first()["n_chars"] == 3 * 100_000 - 2


def test_nodes_are_removed_with_all_in_them(spark):
    """Against a loop over all nodes above a block."""
    pages = ["<div class=a>x<div class=b>y<p>z</p></div>w</div><p>v</p>" * 3, "top<ul><li>a<li>b<ul><li>c</ul></ul>"]
    for page in pages:
        blocks, _, paths, parents = html_text.parse(page)
        rows = [{"text": t, "node": n} for t, n in blocks]
        for low in paths:
            left = []
            for text, node in blocks:
                above = set()
                while node >= 0:
                    above.add(paths[node])
                    node = parents[node]
                if low not in above:
                    left.append(text)
            assert html_text.left_over(rows, paths, parents, [low]) == "\n\n".join(left)
