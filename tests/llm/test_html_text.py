from collections import Counter, defaultdict

from loomgraph.llm import html_text as H

NAV = '<nav class="m"><ul><li><a href="/a">Home</a><li>About</ul></nav>'


def page(i, foot="Foot", host_nav=NAV):
    return f"<html><head><title>t{i}</title><style>p{{}}</style></head><body>{host_nav}<!-- {i} --><script>if(a<b)'</p>'</script><article><h1>Title {i}</h1><p>Body {i} <b>bold</b> &amp; more<p>Second {i}</article><footer>{foot}</footer>"


def rows():
    out = [(i, f"http://www.a.org/{i}", page(i)) for i in range(8)]
    out += [(100 + i, f"https://b.org:80/x?{i}", page(i)) for i in range(3)]
    out += [(200 + i, "http://c.org/same", page(77, "Only")) for i in range(9)]
    return out


def test_parse_malformed():
    t, _ = H.text_of(H.parse("a<div>b<p>c<div>d</div>e</section></p>f<li>g<br>h&lt;<script>x<"), set())
    assert t == "a\nb\nc\nd\ne\nf\ng\nh<"
    assert H.text_of(H.parse("<div><p>one<div>x</div>two</p>three</div>four</br>five"), set())[0] == "one\nx\ntwo\nthree\nfour\nfive"
    assert H.text_of(H.parse("<b>" * 20_000 + "</i>" * 20_000 + "x"), set())[0] == "x"
    deep = "<div>" * 50_000 + "x"
    root = H.parse(deep)
    assert len(H.digest(root)) == 50_000 and H.text_of(root, set())[0] == "x"


def test_templates_go(spark):
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows(), "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title 3\nBody 3 bold & more\nSecond 3" and got[3].removed == 2 and got[3].host == "a.org"
    assert got[101].removed == 0 and "Home" in got[101].text and "Foot" in got[101].text
    assert got[203].removed == 0  # copies are one page, so nothing recurs


def brute(table):
    host = lambda u: u.split("://")[1].split("/")[0].split(":")[0].removeprefix("www.")
    pages, seen = defaultdict(set), defaultdict(set)
    for _, u, h in table:
        root = H.parse(h)
        blocks = H.digest(root)
        pages[host(u)].add(root.hash)
        for x in blocks:
            seen[host(u), x.hash].add(root.hash)
    out = Counter()
    for i, u, h in table:
        root = H.parse(h)
        H.digest(root)
        gone = {k for (w, k), v in seen.items() if w == host(u) and len(v) >= H.MIN_PAGES and len(v) >= H.MIN_SHARE * len(pages[w])}
        out[i, H.text_of(root, gone)] += 1
    return out


def test_table_against_brute_force(spark, sf, monkeypatch):
    p = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").where("page_id < 900")
    table = [(r.page_id, r.url, r.html) for r in p.collect()]
    want = brute(table)
    assert Counter((r.page_id, (r.text, r.removed)) for r in H.extract(p).collect()) == want
    assert sum(n for _, (_, n) in want) > 0
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert Counter((r.page_id, (r.text, r.removed)) for r in H.extract(p).collect()) == want


def test_edge_rows(spark):
    data = [(1, None, page(1)), (2, "no address", page(2)), (3, "http://a.org", None), (4, "http://a.org", ""), (None, "http://a.org", "plain"), (5, "http://a.org", "<p>" + "long " * 200_000), (6, "http://A.org/x", page(6)), (6, "http://A.org/x", page(6))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as host", "'t' as text", "3 as row", "4 as key")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[3].text is None and got[3].removed == 0 and got[4].text == "" and got[None].text == "plain" and len(got[5].text) > 900_000 and got[1].host == got[2].host == ""
    assert H.extract(df).count() == 8
    assert H.extract(df.limit(0)).collect() == []


def test_templates_of_large_hosts_and_inline_elements_go(spark):
    def big(i):
        foot = "<footer>Section</footer>" if i < 6 else ""
        return f'<p>Body <a href="/t"><b>bold</b></a> {i}</p><site-bar>Bar</site-bar><a href="/s">Share</a>{foot}'

    df = spark.createDataFrame([(i, f"http://d.org/{i}", big(i)) for i in range(700)], "page_id long, url string, html string")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert all((r.text, r.removed) == (f"Body bold {i}", 3 if i < 6 else 2) for i, r in got.items())
