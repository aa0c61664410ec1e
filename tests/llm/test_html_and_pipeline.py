"""Page extraction by hand and by brute-force cuts; the pipeline's stages."""

import html
import random
import re
import time
from itertools import product

from tessera.llm.html_extract import WEIGHTS, extract, extract_main_text, fit, min_cut

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all right now.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph of the <a href=y>article</a>,
with enough words to count.<p>Second &lt;one&gt;.</p><div class="ad">Buy this now.</div><ul><li>Item one</li><li>Item two</li></ul></article>
<aside>Related: something else that is long enough to look like text.</aside><form><p>Subscribe now to our letter.</p></form>
<section id="comments"><p>I liked this article a lot and want to say so here.</p></section><footer>&copy; nobody</footer><script>var p = "<p>no</p>"</script></body></html>"""


def test_extract_by_hand():
    assert extract(PAGE) == "Title & more\nFirst paragraph of the article, with enough words to count.\nSecond <one>.\nItem one\nItem two"
    assert extract(None) == extract("") == extract("<script>x</script>") == extract("<!-- only") == ""


def test_extract_reads_past_self_closed_tags():
    first, second = "The first paragraph of this article has words enough.", "The second paragraph of this article has words enough."
    for tag in ('<svg class="i"/>', "<svg a='/>' href=/b/c />", "<math/>", "<svg><path d='x'/><text>no</text></svg>", '<script src="a"/>var no</script>'):
        assert extract(f"<article><p>{first}</p>{tag}<p>{second}</p></article>") == f"{first}\n{second}"
    assert extract(f"<article><p>{first} Here <math><mi>x</mi></math> is one.</p><object data=y><p>{second}</p></object></article>") == f"{first} Here x is one.\n{second}"


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(w for w in want if w)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_extract_reads_past_custom_elements_and_stray_quotes():
    first, second = "The first paragraph of this article has words enough.", "The second paragraph of this article has words enough."
    for tag in ("<svg-icon name='a'></svg-icon>", "<video-player src=x>", "<title-card></title-card>", "<script-tag/>", "<p title=\"a>b\"></p>", "<p data-x='>' \"></p>"):
        assert extract(f"<article><p>{first}</p>{tag}<p>{second}</p></article>") == f"{first}\n{second}"


def test_extract_time_is_linear_in_junk():
    start = time.perf_counter()
    for junk in ("<a " + '"' * 100_000 + "<b", '<a ="' * 50_000, "<a ='" * 50_000 + '<a ="', "<svg " * 50_000, "<a " * 100_000, "<script " * 50_000):
        extract(junk)
    blocks = "".join(f"<div class='{'nav' if i % 7 == 0 else 'x'}'><p>{'word ' * (i % 15)}end.</p></div>" for i in range(50_000))
    assert extract(blocks)
    assert time.perf_counter() - start < 60


def unmarked_page(rng, number):
    """(html, content lines) of a page that names nothing: short lines among its paragraphs, and whole sentences among its links."""
    words = lambda n: " ".join(rng.choice("river stone market light garden winter letter harbour number quiet morning table".split()) for _ in range(n))
    lines = [f"{number} {k} " + (words(rng.randint(2, 4)) if rng.random() < 0.3 else words(rng.randint(12, 40)) + ".") for k in range(rng.randint(6, 12))]
    links = lambda: "".join(f"<div><a href=x>{words(2)}</a></div>" if rng.random() < 0.8 else f"<div>{words(12)}.</div>" for _ in range(rng.randint(8, 14)))
    flat = lambda rows: "<div>" + re.sub(r"</?div>", lambda m: {"<div>": "<p>", "</div>": "</p>"}[m[0]], rows) + "</div>"
    return f"<body><div>{flat(links())}</div><div>{''.join(f'<p>{x}</p>' for x in lines)}</div><div>{flat(links())}</div></body>", lines


def test_the_cut_mends_what_blocks_alone_get_wrong():
    """On pages without article elements or marks, short lines of the text stay and sentences among links go."""
    rng, cut_wrong, alone_wrong, total = random.Random(4), 0, 0, 0
    for number in range(60):
        page, lines = unmarked_page(rng, number)
        want = set(lines)
        total += len(want)
        for cut in (True, False):
            wrong = len(want ^ set(extract(page, cut=cut).split("\n")))
            cut_wrong, alone_wrong = cut_wrong + wrong * cut, alone_wrong + wrong * (not cut)
    assert alone_wrong > 0.2 * total and cut_wrong < alone_wrong / 2


def test_weights_are_fitted_and_an_article_element_is_no_switch(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = fit(pages)
    assert weights != WEIGHTS and len(weights) == len(WEIGHTS) and weights == fit(pages)
    assert fit(pages.where("false")) == WEIGHTS == fit(spark.createDataFrame([("<p>no article</p>",), (None,)], "html string"))
    for r in pages.collect():
        bare = re.sub(r"</?article>", "", r["html"])
        assert extract(bare, weights) == extract(r["html"], weights)  # the same text where no element says what the article is
    beside = "<article><p>Only these few words here.</p></article><div><p>" + "A long unmarked paragraph that stands outside it. " * 8 + "</p></div>"
    assert "Only these few words here." in extract(beside, weights)


def test_min_cut_like_brute_force():
    random.seed(1)
    for _ in range(200):
        n = random.randint(1, 7)
        terminals = [(random.randint(0, 9), random.randint(0, 9)) for _ in range(n)]
        edges = [(random.randrange(n), random.randrange(n), random.randint(0, 5)) for _ in range(n)]

        def cost(side, terminals=terminals, edges=edges):
            return sum(t[0] if s else t[1] for s, t in zip(side, terminals, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(min_cut(terminals, edges)) == min(cost(s) for s in product((False, True), repeat=n))


def test_odd_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 50000), (4, "x", "<div" * 5000), (5, "y", "<" * 20000), (6, "z", "<b>" * 3000 + "deep text that has quite a few words in it.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(df.where("false")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    from tessera.llm.minhash import near_duplicates
    from tessera.llm.workspace import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for name, step in c.STAGES[:-1]:
        out = stage(step(spark, at, sf_dir), "test")
        assert out.columns == c.COLUMNS
        if name != "mixing":
            assert out.exceptAll(at.select(*c.COLUMNS)).count() == 0
        if name == "minhash_near_dedup":
            assert near_duplicates(out).where("not kept").count() == 0
        at = out
    last = c.STAGES[-1][1](spark, at, sf_dir)
    assert last.count() == at.count()


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    import corpus_pipeline as c

    from tessera.llm.workspace import stage

    for table in (odd_docs, no_docs):
        at = table.select(*c.COLUMNS)
        for _, step in c.STAGES:
            at = stage(step(spark, at, sf_dir), "test")
        at.count()


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark, sf_dir):
    import corpus_pipeline as c

    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("c")), (None, text("d")), (None, text("d")), (None, text("e")), (None, text("a")), (3, text("f")), (4, text("f") + " end"), (5, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    got = c.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r["text"] or "" for r in got) == sorted(["", "", "", *map(text, "abcdef")])
    assert {r["doc_id"] for r in got if r["text"] == text("f")} == {3}
