import numpy as np
import pytest

from veritab.llm import html_extract as H
from veritab.llm import url_filter as U
from veritab.llm.queries import ORACLE


def main_text(page):
    return "\n".join(t for k, t in H.blocks_of(page) if k >= H.MAIN_TEXT)


def test_article_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p>One&nbsp;two\n three<br>four<b>five</b> &lt;p&gt; a < b<p>Next
    <div class="share-buttons">Share</div><aside>Side</aside><form>Send</form><ul><li>x<li>y</ul><blockquote>q</blockquote>
    <section id="comments"><article class="comment"><p>reader</p></article></section><noscript>no</noscript></article>
    <div class='cookie-notice'>We</div><footer>&copy; f</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne two three fourfive <p> a < b\nNext\nx\ny\nq"
    assert H.blocks_of(None) == [] and H.blocks_of("") == [] and H.blocks_of("<article></article>") == []
    assert main_text("<main><p>unclosed <b>bold<p>next") == "unclosed bold\nnext"
    assert main_text('<div role="main"><p title="a>b">t</p></div>') == "t"
    assert [k for k, _ in H.blocks_of("<body>text<p>more")] == [H.OPEN, H.OPEN]


def test_wrappers_keep_their_article():
    assert main_text('<div class="layout with-sidebar"><article><p>text</p></article><div class="sidebar">side</div></div>') == "text"
    assert main_text('<div class="page no-comments"><main><p>text</p></main></div>') == "text"
    assert main_text('<div class="widget"><div><article class="teaser"><p>text</p></article></div></div>') == "text"
    assert main_text('<article><section class="related-work"><p>about others</p></section><div class="related-posts promo">x</div></article>') == "about others"
    assert main_text('<div id="comments"><article><p>reader</p></article></div><article><p>text</p></article>') == "text"
    assert main_text("<nav><article>menu</article></nav>") == ""


def test_boxes_give_back_their_article():
    assert main_text('<form id="aspnetForm"><input name="v"><div>menu</div><article><p>kept</p></article><p>more</p></form>') == "kept"
    assert main_text('<div class="wrapper page-comments"><article><p>kept</p></article></div>') == "kept"
    assert main_text('<div role="form"><div class="newsletter"><main><p>kept</p></main></div></div>') == "kept"
    assert main_text('<footer><form><article>no</article></form></footer><form><nav><article>no</article></nav></form>') == ""
    assert main_text('<article><p>text</p><form><label>Name</label><p>send</p><button>Go</button></form></article>') == "text"


def test_inline_elements_cut_no_block():
    page = """<article><p>Energy <math><mi>E</mi><annotation>tex</annotation></math> is <label>kept</label> here</p><p>a <script>var x = "<p>";</script>b<svg><path/></svg> c <noscript>no</noscript>d</p>
    <p>x <span hidden>secret</span><span class="ad">BUY</span> y <select><option>1</option></select>z</p><div class="teaser"><p>lead</p></div><p>press <button>this</button> key</p><button>Share</button></article>"""
    assert main_text(page) == "Energy E is kept here\na b c d\nx y z\nlead\npress this key"
    assert H.blocks_of('<div>open <span class="ad">BUY</span> text</div>') == [(H.OPEN, "open text"), (H.DOUBTFUL, "BUY")]


def test_odd_markup_takes_no_text_of_an_article():
    """Comments that end at once or by --!>, empty tags inside drawings, names of code in code, names that tell what readers may do."""
    assert main_text("<article><p>one</p><!--><p>two</p><!---><p>three</p><!-- no --!><p>four</p><!----><p>five</p><!-- no > -- no --><p>six</p></article>") == "one\ntwo\nthree\nfour\nfive\nsix"
    assert main_text("<article><p>a <svg><title/><style/><script /><path d='x'/></svg> b</p><p>c <svg><title>no</title></svg></p></article>") == "a b\nc"
    assert main_text("<article><pre><code>x = 1 <span class='hljs-comment'># one</span>\n<span class='token comment'># two</span> <b hidden>no</b></code></pre><p class='notice'>no</p></article>") == "x = 1 # one # two"
    assert main_text("<div class='layout comments-open'><article><p>kept</p><p class='comments-closed'>no</p></article></div>") == "kept"
    assert main_text("<div class='comments comments-open'><article>no</article></div><div id='comment-list'><article>no</article></div><script/>no</script>") == ""


def test_built_pages(spark):
    """Pages put together from known blocks; what is expected is what was put in, not what any parser says."""
    import html
    import random

    rng = random.Random(8)
    words = ["alpha", "beta", "gamma & delta", "<tag>", "größe", "x", "the", "of", "“quoted”"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(1, n)))
    noise = [
        "<nav><ul><li><a href='/'>{}</a></li></ul></nav>", "<aside><p>{}</p></aside>", "<div class='share-buttons'>{}</div>", "<script>if (a < b) {{ '{}' }}</script>", "<!-- <p>{}</p> -->",
        "<form><label>{}</label><input><button>go</button></form>", "<section id='comments'><article class='comment'><p>{}</p></article></section>", "<div hidden>{}</div>", "<style>p {{ }} /* {} */</style>", "<div role='alert'>{}</div>",
    ]
    inline = ["<b>{}</b>", "<em class='x'>{}</em>", "<a href=\"/a>b\">{}</a>", "<math><mi>{}</mi></math>", "{}<script>no()</script>", "{}<span style='display: none'>no</span>"]
    wrap = ["<div>{}</div>", "<form id='main'>{}</form>", "<div class='layout with-sidebar'>{}</div>", "<div class='page-comments wrapper'>{}</div>", "<body class='home'>{}</body>"]
    rows, want = [], {}
    for k in range(120):
        blocks, body = [], []
        for _ in range(rng.randrange(1, 8)):
            pieces = [text(6) for _ in range(rng.randrange(1, 5))]
            blocks.append(" ".join(pieces))
            marked = [rng.choice([*inline, "{}", "{}"]).format(html.escape(p)) for p in pieces]
            tag = rng.choice(["p", "h2", "li", "blockquote", "div"])
            body.append(f"<{tag}>" + rng.choice([" ", "\n  ", "<br>"]).join(marked) + f"</{tag}>")
            if rng.random() < 0.5:
                body.append(rng.choice(noise).format(html.escape(text(9))))
        page = f"<article>{''.join(body)}</article>"
        for w in rng.sample(wrap, rng.randrange(0, 4)):
            page = w.format(page + rng.choice(noise).format("around"))
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<html><head><title>t</title></head>{page}<footer>foot</footer></html>"))
        want[k] = "\n".join(blocks)
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(4)
    for n in [1, 2, 9, 60, 300]:
        text = rng.integers(0, 3, n)
        order, levels = H.suffix_array(text)
        whole = [text[i:].tolist() for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: whole[i])
        share = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        i, j = rng.integers(0, n, 50), rng.integers(0, n, 50)
        i, j = i[i != j], j[i != j]
        assert H.common_prefixes(levels, i, j).tolist() == [share(whole[a], whole[b]) for a, b in zip(i, j, strict=True)]


def test_repeats_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        streams = [rng.integers(1, 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(12)]
        pages = np.sort(rng.integers(0, 5, 12))
        row = np.repeat(np.arange(12), [len(s) for s in streams])
        w, n = H.repeats(np.concatenate(streams), row, pages)
        want = {}
        for s, p in zip(streams, pages.tolist(), strict=True):
            size = min(len(s), H.LEAST)
            for i in range(len(s) - size + 1):
                want.setdefault(tuple(s[i : i + size].tolist()), set()).add(p)
        named = {int(H.windows_of(np.array(k, np.uint64), np.zeros(len(k), int))[2][0]): len(v) for k, v in want.items()}
        assert dict(zip(w.tolist(), n.tolist(), strict=True)) == named
    assert H.repeats(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))[0].size == 0


def brute_texts(rows, inside=False):
    """(page_id, text) by plain loops over tuples of tokens; rows: (page_id, url, html)."""
    host = lambda url: (url or "").partition("://")[2].partition("/")[0].lower()
    windows = lambda t: [(i, tuple(t[i : i + H.LEAST])) for i in range(max(1, len(t) - H.LEAST + 1))]
    seen = {}
    for _, url, html in rows:
        for kind, text in H.blocks_of(html):
            if kind < H.MAIN_TEXT:
                for _, w in windows(text.split(" ")):
                    seen.setdefault((host(url), w), set()).add(html)
    out = []
    for page, url, html in rows:
        blocks = H.blocks_of(html)
        main = [b for b in blocks if b[0] >= H.MAIN_TEXT]
        texts = []
        for kind, text in main or [b for b in blocks if b[0] == H.OPEN]:
            tokens = text.split(" ")
            gone = set()
            for i, w in windows(tokens):
                if len(seen.get((host(url), w), ())) >= H.PAGES and (not main or (inside and kind != H.HEADING and len(w) == H.LEAST)):
                    gone |= set(range(i, i + len(w)))
            run = []
            for i, t in enumerate([*tokens, None]):
                if i in gone or t is None:
                    texts += [" ".join(run)] if run else []
                    run = []
                else:
                    run.append(t)
        out.append((page, "\n".join(texts)))
    return out


@pytest.mark.parametrize("small", [H.SMALL, 0])
def test_repetition_decides(spark, monkeypatch, small):
    """Text that other pages of the host repeat goes from open pages and, where asked, from articles; copies stay."""
    monkeypatch.setattr(H, "SMALL", small)
    shared = "Welcome to this very fine site of many words"
    rows = [(i, f"http://h.org/{i}", f"<body><p>{shared}</p><p>Text number {i} is unlike every other text on it {i * i}</p><p>Menu</p></body>") for i in range(5)]
    rows += [(10, "http://other.org/1", f"<p>{shared}</p>"), (11, "http://h.org/a", f"<article><h1>{shared} x</h1><p>Own words. {shared} More own words.</p><p>Menu</p></article>"), (12, None, None), (13, "x", ""), (0, rows[0][1], rows[0][2])]
    rows += [(20 + i, f"http://copy.org/{i}", "<p>a page that is a copy of all the others here</p>") for i in range(4)]
    # An article that many pages hold stays; a notice that stands outside articles too goes from it, also in a very long text.
    notice = "we use cookies on all of our fine pages as you may know by now"
    rows += [(30 + i, f"http://n.org/{i}", f"<div>{notice} {i}</div><article><p>this article is on all of the pages of its host and stays whole</p></article>") for i in range(4)]
    rows += [(40, "http://n.org/long", f"<article><p>{'word ' * 300_000}</p><p>before {notice} after</p></article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    found = {(r.page_id, r.text, r.n_covered > 0) for r in H.extract(pages, inside_articles=True).collect()}
    assert sorted((p, t) for p, t, _ in found) == sorted(set(brute_texts(rows, True)))
    want = {i: f"Text number {i} is unlike every other text on it {i * i}" for i in range(5)} | {10: shared, 11: f"{shared} x\nOwn words.\nMore own words.\nMenu", 12: "", 13: ""}
    want |= {20 + i: "a page that is a copy of all the others here" for i in range(4)} | {30 + i: "this article is on all of the pages of its host and stays whole" for i in range(4)}
    got = {p: t for p, t, _ in found}
    assert {p: t for p, t in got.items() if p < 40} == want and got[40].endswith("word\nbefore\nafter")
    assert {p for p, _, covered in found if covered} == {0, 1, 2, 3, 4, 11, 40}
    by_default = {r.page_id: (r.text, r.n_covered) for r in H.extract(pages).collect()}
    assert {p: t for p, (t, _) in by_default.items()} == dict(brute_texts(rows)) and {p for p, (_, n) in by_default.items() if n} == {0, 1, 2, 3, 4}
    assert H.extract(pages.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    from veritab.llm import queries

    path = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    got = queries.op2_html_extract(spark, path).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(brute_texts(rows))
    assert all(r.n_chars == len(r.text) for r in got)


def test_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://x.example.com/de/1#t", "x.example.com", "/de/1", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("http://b.net", "b.net", "", None, "allow"), ("http://c.net?/x", "c.net", "", None, "allow"),
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("x://h/É?", "h", "/É", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [u[1:] for u in urls]
    assert U.judge(pages.limit(0)).count() == 0


LINKED = [
    ("http://farm.io/a", "bad.net worse.net"), ("http://bad.net/x", ""), ("http://bad.net?x", ""), ("http://worse.net/x", ""), ("http://far.io/", "FARM.io"),
    ("http://good.org/fr/x", "nice.io good.org"), ("http://nice.io/", ""),
    # Trust outweighs distrust; a blocked host with many hosts linking to it; a mixed host.
    ("http://both.io/", "bad2.net"), ("http://good2.org/fr/x", "both.io"), ("http://bad2.net/x", ""), *[(f"http://many{i}.io/", "hub.net") for i in range(9)], ("http://hub.net/x", ""),
    ("http://mixed.example.com/de/1", ""), ("http://mixed.example.com/en/1", ""), ("http://big.example.com/de/1", ""), *[("http://big.example.com/en/1", "")] * 5, ("http://loop.io/", "bad3.net loop2.io"), ("http://loop2.io/", "loop.io"), ("http://bad3.net/", "loop.io"), (None, "bad.net"), ("http://none.io/", None),
]
BLOCKED = {"farm.io", "bad.net", "worse.net", "far.io", "bad2.net", "hub.net", "mixed.example.com", "loop.io", "loop2.io", "bad3.net"}


def brute_scores(links, seeds, against):
    """Scores of each host by a plain loop; links: (src, dst) -> pages."""
    score = dict(seeds)
    edges = {(d, s): n for (s, d), n in links.items()} if against else links
    total = {}
    for (a, _), n in edges.items():
        total[a] = total.get(a, 0) + n
    for _ in range(200):
        score = {h: s + 0.85 * sum(n / total[a] * score[a] for (a, b), n in edges.items() if b == h) for h, s in seeds.items()}
    return score


def test_distrust_flows_back_and_trust_forward(spark, tmp_path):
    """The registered parameters; the method changes verdicts that no rule gives."""
    link = lambda hosts: "".join(f"<a href={q}{x}//{h}/p{q}>x</a>" for h, q, x in zip(hosts.split(), "'\"'\"", ["https:", "", "http:"]))  # noqa: E731, B905
    rows = [(i, url, None if hosts is None else link(hosts)) for i, (url, hosts) in enumerate(LINKED)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in U.judge(pages).collect()}
    for _, (host, rule, verdict) in got.items():
        if rule is None:
            assert verdict == ("block" if host in BLOCKED else "allow"), host
    assert sum(v == "block" and r is None for _, r, v in got.values()) == 6

    hosts = {h for h, _, _ in got.values() if h}
    links = {}
    for _, url, html in rows:
        for dst in {x.lower() for x in __import__("re").findall("//([a-zA-Z0-9.]+)/p", html or "")}:
            src = (url or "").partition("://")[2].partition("/")[0].partition("?")[0]
            if src and src != dst:
                links[src, dst] = links.get((src, dst), 0) + 1
    share = lambda h, v: sum(1.0 for g in got.values() if g[0] == h and g[1] and g[2] == v) / sum(g[0] == h for g in got.values())
    table = spark.createDataFrame([(h, share(h, "allow"), share(h, "block")) for h in hosts], "host string, trust double, distrust double")
    scores = U.propagate(table, spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src string, dst string, pages long")).collect()
    for against, verdict in ((True, "block"), (False, "allow")):
        want = brute_scores(links, {h: share(h, verdict) for h in hosts}, against)
        assert {r.host: round(r.distrust if against else r.trust, 2) for r in scores} == {h: round(x, 2) for h, x in want.items()}

    import duckdb

    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    sql = con.execute(ORACLE["op3_url_filter"]).df()
    assert {r.page_id: (r.host, r.rule if isinstance(r.rule, str) else None, r.verdict) for r in sql.itertuples()} == got
