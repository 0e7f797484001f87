"""Extraction against pages whose main text is known."""

import random

from tarmac.llm import html_extract as h


def page(i, paras, extra=""):
    return (f'<!DOCTYPE html><html><head><title>T{i}</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body>'
            f'<header><a href="/">Site &amp; Co</a></header><nav><ul><li>Home</li><li>About {i}</li></ul></nav><div class="cookie-notice">We use cookies</div>'
            f'<div class="wrap"><div id="content">{paras}</div><aside>Read also {i}</aside><div class="boiler">Same words everywhere</div></div>{extra}'
            f'<section id="comments"><p>First! {i}</p></section><footer>&copy; {i}</footer></body></html>')


def corpus(n=12):
    rnd = random.Random(4)
    out = []
    for i in range(n):
        p = [" ".join(rnd.choice(["alpha", "beta", "gamma", f"d{i}"]) for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(1, 6))]
        out.append((i, f"http://Ex.org:80/{i}", page(i, "".join(f"<p>{x}\n </p>" for x in p)), "\n".join(p)))
    return out


def test_known_pages(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:3] + (1,) for r in rows], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert {i: r.text for i, r in got.items()} == {r[0]: r[3] for r in rows}
    assert all(r.n_chars == len(r.text) and r.url == f"http://Ex.org:80/{i}" for i, r in got.items())


def test_template_text_goes_without_any_name(spark):
    # Nothing marks the article or the boilerplate here: only the repetition over pages does.
    rows = [(i, "https://a.b/x", f"<body><div><div>Welcome to the site</div><div><p>Story {i} tells {i * 7}</p></div><div>Bye now</div></div></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {i: f"Story {i} tells {i * 7}" for i in range(6)}
    nested = h.template(h.classes(df.selectExpr("'a.b' AS host", "html"))).collect()
    assert nested and all(r.support == 6 for r in nested)


def test_classes_nest_or_are_not_valid(spark):
    rows = [("h", 1, 10, 6, 5, 0.0), ("h", 2, 10, 6, 5, 9.0), ("h", 3, 20, 6, 4, 2.0), ("h", 4, 20, 6, 4, 5.0), ("h", 5, 30, 6, 3, 4.0), ("h", 6, 30, 6, 3, 12.0), ("h", 7, 40, 6, 3, 3.0), ("h", 8, 40, 6, 3, 3.5)]
    found = spark.createDataFrame([(host, 1, *r) for host, *r in rows], "host string, layout long, key long, class_id long, support long, tokens long, place double")
    assert {r.class_id: r.parent for r in h.template(found).collect()} == {10: None, 20: 10, 40: 20}


def article(i, n=4):
    rnd = random.Random(i)
    return [" ".join(rnd.choice(["river", "stone", "cloud", "light", f"x{i}"]) for _ in range(25)) for _ in range(n)]


def frame_of(spark, pages):
    return spark.createDataFrame([(i, f"http://near.org/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")


def texts(df):
    return [r.text for r in sorted(h.extract(df).collect(), key=lambda r: r.page_id)]


def test_near_copies_keep_their_article(spark):
    same = "".join(f"<p>{x}</p>" for x in article(1))
    for around in ("<script>var a={i}</script><article>{same}</article>", "<article>{same}</article><p>{i}</p>", "<div>Hello visitor {i}, log in</div><div>{same}</div><div>Page {i} of 8</div>"):
        pages = ["<body>" + around.format(i=i, same=same) + "</body>" for i in range(8)]
        assert texts(frame_of(spark, pages)) == ["\n".join(article(1))] * 8


def test_boilerplate_in_an_article_goes_where_the_article_varies(spark):
    pages = ["<body><article>" + "".join(f"<p>{x}</p>" for x in article(i)) + "<p>Write to the editors of this paper</p><p>All rights</p><p>Read on</p></article></body>" for i in range(8)]
    assert texts(frame_of(spark, pages)) == ["\n".join(article(i)) for i in range(8)]


def test_varying_boilerplate_without_any_name(spark):
    pages = [f"<body><div>Hello visitor {i}, log in</div><div>" + "".join(f"<p>{x}</p>" for x in article(i)) + f"</div><div>Page {i} of 8</div><div>Fine site</div></body>" for i in range(8)]
    assert texts(frame_of(spark, pages)) == ["\n".join(article(i)) for i in range(8)]


def test_two_layouts_of_a_host(spark):
    one = lambda i: f"<body><div class='a'>Old shop front</div><div class='b'><p>{article(i)[0]}</p></div><div class='c'>Bye for now</div></body>"
    two = lambda i: f"<body><table><tr><td>New shop front</td></tr></table><div class='x'><p>{article(i)[0]}</p></div><ul><li>Call us</li><li>Find us</li></ul></body>"
    assert texts(frame_of(spark, [(one if i % 2 else two)(i) for i in range(12)])) == [article(i)[0] for i in range(12)]


def test_edges(spark):
    long = "<article>" + "<p>word &lt;x&gt; &#233;</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "http://", "plain &amp; text"), (3, "http://", "plain &amp; text"), (None, "http://h/", long),
            (5, "http://h/", "<p><b>One<br><p>Two  <i>and</i>\nmore</p><script>x"), (6, "http://h/", "a < b <p class=>c</p> <!-- no"), (7, "http://h/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.text if r.page_id else r.n_chars) for r in h.extract(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "plain & text"), (3, "plain & text"), (None, 20_000 * 11 - 1), (5, "One\nTwo and more"), (6, "a < b\nc"), (7, "deep")], key=str)
    assert h.extract(df.where("false")).count() == 0


def test_join_in_place_of_broadcast(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    before = sorted(h.extract(df).collect(), key=str)
    monkeypatch.setattr(h, "TEMPLATE_ROWS", 0)
    assert sorted(h.extract(df).collect(), key=str) == before


def test_article_wins_and_its_header_stays():
    text = h.main_text("<body><div>Menu</div><article><header><h1>Title</h1></header><p>Body</p><form>Your mail<input></form><div class='comments'>x</div></article><p>Other</p></body>")
    assert text == "Title\nBody"
