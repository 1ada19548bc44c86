from credence.llm.pages import Page, extract, main_text, subtrees, templates

ARTICLE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div><article><h1>T &amp; U</h1><p><b>Bold  text<br><p>Next &eacute;\n line.</p><aside>side</aside><section class="comments"><p>First!</p></section></article><footer>&copy; x</footer></body></html>'


def test_article():
    assert main_text(ARTICLE) == "T & U\nBold text\nNext é line."
    assert main_text(ARTICLE[: ARTICLE.index("</p><aside")]) == "T & U\nBold text\nNext é line."


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("a < b &amp") == "a < b &"
    assert main_text("<p>one</div></p></p>two") == "one\ntwo"
    assert main_text('<p title="a>b">x</p>') == "x"
    assert main_text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"


def test_templates_go_and_copies_stay(spark):
    page = lambda i, body: (i, f"http://h.org/{i}", f'<html><body><div class="top"><p>Always the same words</p></div><div><p>{body}</p><p>More of page {body} that is its own.</p></div></body></html>')
    art = lambda i: (i, f"http://h.org/{i}", "<body><article><p>Copied paragraph.</p><p>And its end.</p></article></body>")
    rows = [page(i, f"Text {i} is here") for i in range(6)] + [art(i) for i in range(10, 14)] + [(20, None, "<p>No host</p>"), (21, "http://h.org/z", None), (0, "http://h.org/0", None), (None, "::bad::", "<p>x</p>")]
    got = {(r["page_id"], r["url"]): r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) - 1 or len(got) == len({(r[0], r[1]) for r in rows})
    assert got[3, "http://h.org/3"] == "Text 3 is here\nMore of page Text 3 is here that is its own."
    assert got[11, "http://h.org/11"] == "Copied paragraph.\nAnd its end."
    assert got[20, None] == "No host" and got[21, "http://h.org/z"] == ""
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


WORDS = "amber birch cedar delta ember fjord grove heron islet jolly koala lemon mango north ocean pearl quill raven stone tiger".split()


def _words(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1)) % len(WORDS)] for i in range(n)).capitalize() + f" {seed}."


def test_neutral_names_and_no_article_element(spark):
    """Boilerplate that no markup tells: only counting finds it. One host large, one small, the same rule."""
    top, side = '<div class="x1"><ul><li>First place</li><li>Second place</li></ul></div>', '<div class="x2"><span>Anything that we say here stands on all pages of the site.</span></div>'

    def page(host, i):
        body = f"<div class='c'><h2>{_words(i, 4)}</h2><p>{_words(i + 1000, 20)}</p>" + (side if i % 2 else "") + f"<p>{_words(i + 2000, 15)}</p></div>"
        return i, f"http://{host}/{i}", f"<html><body>{top}{body}<div class='x3'>Made by <a href='/'>us</a></div></body></html>"

    rows = [page("big.org", i) for i in range(120)] + [page("small.org", i) for i in range(200, 207)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, r in got.items():
        assert r["text"] == "\n".join([_words(i, 4), _words(i + 1000, 20), _words(i + 2000, 15)]) and r["n_template_chars"] > 30 and r["n_markup_chars"] == 0


def test_templates_inside_articles_but_no_copied_text(spark):
    box = '<div class="k"><p>Read our other pieces on this, they are worth your time.</p></div>'
    own = [(i, f"http://h.org/{i}", f"<body><article><p>{_words(i, 12)}</p>{box}<p>{_words(i + 50, 12)}</p><p>The same closing words stand under all of them.</p></article></body>") for i in range(6)]
    copies = [(i, f"http://h.org/{i}", f"<body><div>{i}</div><article><p>Start.</p><div class='k2'><p>A long part of a text that was copied five times over.</p></div><p>End.</p></article></body>") for i in range(10, 15)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(own + copies, "page_id long, url string, html string")).collect()}
    assert got[3] == "\n".join([_words(3, 12), _words(53, 12), "The same closing words stand under all of them."])
    assert got[12] == "Start.\nA long part of a text that was copied five times over.\nEnd."


def test_beyond_the_broadcast_bound(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div class='m'>Menu of the site</div><div><p>{_words(i, 20)}</p></div></body>") for i in range(12)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    some = {tuple(r) for r in extract(docs).collect()}
    assert some == {tuple(r) for r in extract(docs, most=0).collect()} and all(r[2].count("Menu") == 0 for r in some)


def test_counts_against_brute_force(spark):
    """Which subtrees are template, by looking at all pages of each host."""
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<body><div class='a'>Menu {i % 4}</div><nav><p>All the time the very same long words in here</p></nav><div><div>b{i // 6}</div><p>{_words(i, 9)}</p></div></body>") for i in range(36)]
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen: dict[tuple, dict] = {}
    for _, url, html in rows:
        p = Page(html, host=url.split("/")[2])
        for h, strict, around in dict.fromkeys(p.found):
            at = seen.setdefault((h, strict), {})
            key = around if strict else p.text()
            at[key] = at.get(key, 0) + 1
    want = {h for (h, strict), c in seen.items() if len(c) >= 3 and (not strict or 2 * max(c.values()) <= sum(c.values()))}
    assert {r["hash"] for r in templates(subtrees(docs)).collect()} == want and len(want) > 6


def test_an_apostrophe_outside_a_value_quotes_nothing():
    assert main_text("<article><p>one</p><p class=it's>two</p><p>three</p></article>") == "one\ntwo\nthree"
    assert main_text("<p don't>a</p><p id = 'x>y'>b</p>") == "a\nb"


def test_edges(spark):
    docs = spark.createDataFrame([(1, "http://a.org/1", "<p>" + "word " * 100_000 + "</p>", "x", "y"), (1, "http://a.org/1", None, "x", "y"), (None, None, "<p>t", None, None)], "page_id long, url string, html string, host string, hash string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in extract(docs).collect())
    assert got == [("1", 0), ("1", 499_999), ("None", 1)]


def test_hashes_follow_content():
    a, b = Page("<div>same words</div><div>one</div>"), Page("<div>same words</div><div>two</div>")
    assert a.found[0] == b.found[0] and a.found[1] != b.found[1]
    assert a.found[0] != Page("<div>same words</div><div>one</div>", host="other").found[0]
