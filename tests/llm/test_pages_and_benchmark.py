"""HTML extraction and decontamination against plain versions."""

import random

from graphloom.llm import decontamination, html_extraction


def test_common_lines():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(15))] for _ in "ab")
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        found = html_extraction.common_lines(a, b)
        rest = iter(b)
        assert len(found) == d[-1][-1] and all(a[i] in rest for i in found)


PAGE = "<html><head><title>t</title></head><body><nav><a>Home</a></nav>{}<script>x</script><div class='ad'>Buy<b>!</b></div><!-- c --></body></html>"


def test_extraction(spark):
    wrap = "<div>Our site</div><p>{}</p><p>{}</p><div>Read more</div>"
    rows = [
        (1, "http://h/a/1", PAGE.format("<article><h1>T &amp; U</h1><p>One\n two<br>three<p>End</article><footer>f</footer>")),
        (2, "http://h/b/1", PAGE.format(wrap.format("alpha beta", "gamma delta epsilon"))),
        (3, "http://h/b/2", PAGE.format(wrap.format("something else", "quite other words"))),
        (4, "http://other/b/2", PAGE.format(wrap.format("alone", "here"))),
        (5, None, None),
        (None, "http://h/z", ""),
        (6, "http://h/c/1", PAGE.format("<nav>unclosed <article>kept</article>")),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    for size in (1 << 20, 100):
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(df, range_bytes=size).collect()}
        assert got == {1: "T & U One two three End", 2: "alpha beta gamma delta epsilon", 3: "something else quite other words", 4: "Our site alone here Read more", 5: "", None: "", 6: "kept"}
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_differencing_decides_where_markup_is_silent(spark):
    menu = "".join(f"<div>entry {i} of the menu</div>" for i in range(30))
    page = lambda own: f"<html><body>{menu}<p>{own}</p><div>all rights reserved</div></body></html>"
    voices = "<article><p>the story</p></article><section class='comments'><article><p>reader says hi</p></article></section>"
    rows = [(i, f"http://big/news/{i}", page(f"own words {i}")) for i in range(5)]
    rows += [(10, "http://two/a", page("first")), (11, "http://two/b", page("second")), (12, "http://one/a", "<p>alone</p>"), (13, "http://v/a", voices)]
    rows += [(20, "http://same/a", page("told twice")), (21, "http://same/b", page("told twice"))]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    for size in (1 << 20, 100):
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(df, range_bytes=size).collect()}
        assert {i: got[i] for i in range(5)} == {i: f"own words {i}" for i in range(5)}
        assert (got[10], got[11], got[12], got[13]) == ("first", "second", "alone", "the story")
        assert got[20] == got[21] and got[20].endswith("told twice all rights reserved")


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(5, 30)))) for i in range(12)] + [(90, None), (91, " ")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rnd.randrange(40))]
        if rnd.random() < 0.6:
            t = list(items[rnd.randrange(12)][1].upper())
            for _ in range(rnd.randrange(12)):
                t[rnd.randrange(len(t))] = rnd.choice(["", "z", "  "])
            text.insert(rnd.randrange(len(text) + 1), "".join(t))
        docs.append((i, " ".join(text)))
    docs += [(70, None), (71, ""), (None, items[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, q in items[:12]:
            q, k = decontamination.normal(q), len(decontamination.normal(q)) // 16
            e = least_distance(q, decontamination.normal(t))
            if e <= k:
                want.add((d, i, e))
    for block in (8 << 20, 200):
        assert {tuple(r)[:3] for r in decontamination.matches(df, bench, block_bytes=block).collect()} == want
    bad = {d for d, _, _ in want}
    assert {r["doc_id"] for r in decontamination.clean(df, bench).collect()} == {d for d, _ in docs if d not in bad}
