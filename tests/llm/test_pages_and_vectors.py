"""Pages and vectors against brute force, and on edge cases."""

import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions.tables import table
from starloom.llm import templates, voronoi, warc

PAGES = "page_id long, url string, html string"


def article(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_small_table_is_extracted_exactly(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {x.page_id: (x.text, x.n_chars) for x in templates.extract_main_text(pages).collect()}
    want = {p.page_id: (article(p.html), len(article(p.html))) for p in pages.collect()}
    assert got == want


def site(i, r):
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    body = [say(30) for _ in range(r.randint(1, 4))]
    page = (
        f"<html><head><title>{say(3)}</title></head><body><header><h2>Site name</h2></header><div class='top-menu'><a href=/>Home</a> <a href=/x>More</a></div>"
        f"<div id=wrap><div class='post-body'><h1>Title {i}</h1>" + "".join(f"<p>{b} &amp; <em>more</em></p>" for b in body) + "<p>Read our fixed closing words every time.</p></div>"
        f"<div class='sidebar'>{say(9)}</div><div id='comments'><p>{say(12)}</p></div><form><label>{say(2)}</label></form></div><div class='cookie-notice'>We use cookies</div><footer>{say(4)}</footer></body></html>"
    )
    return page, "\n".join([f"Title {i}", *(f"{b} & more" for b in body)])


def test_other_sites_and_their_fixed_words(spark):
    r = random.Random(1)
    made = [site(i, r) for i in range(30)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, (p, _) in enumerate(made)], PAGES)
    got = {x.page_id: x.text for x in templates.extract_main_text(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(made)}


def test_copies_of_one_article_keep_it(spark):
    r = random.Random(5)
    closing = "\nRead our fixed closing words every time."
    one, text = site(0, r)
    lone = [site(i, r) for i in range(1, 9)]
    rows = [(i, "http://equal.example/", one) for i in range(8)]  # equal pages only
    rows += [(100 + i, "http://copies.example/", one) for i in range(90)] + [(200 + i, "http://copies.example/", p) for i, (p, _) in enumerate(lone)]
    rows += [(300 + i, "http://crawls.example/", one.replace("<footer>", f"<footer>seen {i} ")) for i in range(9)]  # all but a counter outside
    got = {x.page_id: x.text for x in templates.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(8)} == {got[300 + i] for i in range(9)} == {text + closing}
    assert {got[100 + i] for i in range(90)} == {text} and [got[200 + i] for i in range(8)] == [t for _, t in lone]


def test_equal_vectors_form_one_class(spark):
    r = random.Random(2)
    pages = spark.createDataFrame([(i, "http://a.example/", site(i, r)[0]) for i in range(12)], PAGES).withColumn("host", templates.host_of("url"))
    v = {x.token: x for x in templates.token_vectors(pages).collect()}
    root, body = v["<>html"], v["<>html>body>div>div.post-body"]
    assert (root.vector, root.pages, root.occurrences) == (body.vector, 12, 12)
    assert v["<>html>body>div>div.post-body>p"].vector != root.vector
    t = templates.host_templates(pages).first()
    assert t.article == ">html>body>div>div.post-body" and len(t.fixed) >= 1


def test_page_edge_cases(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://x.example/", "plain words"), (4, "http://x.example/", "<p>a&nbsp;b<p>c<script>if (a<b) '</p>'</script> d<!-- x --><p class='ad'>no</p>"), (4, "http://x.example/", "<article>cut <b>shor"), (None, "http://x.example/", "<main><ul><li>one<li>two</ul></main><aside>z</aside>"), (5, "u", "x" * 300000)]
    got = [(x.page_id, x.text) for x in templates.extract_main_text(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS text")).collect()]
    assert sorted(got, key=repr) == sorted([(1, ""), (2, ""), (3, "plain words"), (4, "a b\nc d"), (4, "cut shor"), (None, "one\ntwo"), (5, "x" * 300000)], key=repr)
    assert templates.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


# --- op9 -------------------------------------------------------------------------------------------


def brute(rows, k=20):
    q = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, a in q:
        if i % 20 == 0:
            s = sorted((-int(a @ b), j) for j, b in q if j != i and len(a) == len(b))[:k]
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    return out


def vectors(spark, rows):
    return voronoi.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS cell"))


@pytest.mark.parametrize("pivots", [1, 5])
def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark, pivots):
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] + 0.1 * r.normal(size=8)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # one very common vector
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (920, [float("nan")] * 8), (940, []), (960, [1.0, 2.0]), (961, [2.0, 1.0]), (None, [1.0] * 8)]
    got = {tuple(x) for x in voronoi.top_k(vectors(spark, rows), 20, pivots=pivots, sample=200, block=128).collect()}
    assert got == brute(rows)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert {tuple(x) for x in voronoi.top_k(vectors(spark, rows)).collect()} == brute(rows)
    assert voronoi.top_k(vectors(spark, [])).count() == 0 and voronoi.top_k(vectors(spark, [(1, [1.0])])).count() == 0


def test_bounds_prune_separate_clusters(spark):
    """Data that can't reach a group's threshold are not copied to it, and the result is whole all the same."""
    r = np.random.default_rng(4)
    far = np.eye(8) * 40
    rows = [(i, [float(x) for x in far[i % 4] + r.normal(size=8)]) for i in range(800)]
    assert {tuple(x) for x in voronoi.top_k(vectors(spark, rows), pivots=8, sample=400).collect()} == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    r = np.random.default_rng(6)
    rows = [(i // 2, [float(x) for x in r.normal(size=6)]) for i in range(240)] + [(40, [3.0] * 6), (40, [3.0] * 6)]
    want = []
    q = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    for n, (i, a) in enumerate(q):
        if i % 20 == 0:
            s = sorted((-int(a @ b), j) for m, (j, b) in enumerate(q) if m != n)[:20]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    got = [tuple(x) for x in voronoi.top_k(vectors(spark, rows).repartition(3), pivots=4, sample=60, block=50).collect()]
    assert sorted(got) == sorted(want)


# --- op10 ------------------------------------------------------------------------------------------


def trap(page_id):
    """A page that quotes a whole record, and the magic."""
    return "before\n" + warc.record(page_id, "http://x/", b"inner", "0" * 64, 5, "response", None).decode() + "WARC/1.1\r\nContent-Length: 7\r\n\r\nafter" + "z" * 500


@pytest.mark.parametrize("chunk", [300, 5000, 1 << 20])
def test_archives_round_trip_and_magic_inside_payloads_is_rejected(spark, chunk):
    rows = [(i, f"http://h.example/{i}", "<p>page</p>" * (i % 40)) for i in range(300)] + [(1000 + i, "http://h.example/trap", trap(i)) for i in range(20)]
    rows += [(2000, None, None), (2001, "bad url\r\nX: y", ""), (2002, "u", "é" * 200), (2003, "u", "é" * 200), (2004, "u", "é" * 40000), (5, "u", "é" * 200), (None, "u", "q" * 150)]
    first = {}
    for i, _, h in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        n = sum((x[2] or "") == (h or "") for x in rows)
        revisit = len(b) >= 100 and n > 1 and first[h] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS first", "2 AS path").repartition(3)
    got = [tuple(x) for x in warc.warc_round_trip(pages, chunk).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages_no_records(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


# --- op4: layouts and names ------------------------------------------------------------------------


def extracted(spark, rows):
    return {x.page_id: x.text for x in templates.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_wrappers_named_like_surroundings_keep_the_article(spark):
    r = random.Random(7)
    say = lambda k: " ".join("".join(r.choice("hijklmn") for _ in range(5)) for _ in range(k))
    rows, want = [], {}
    for name in ("layout no-sidebar", "has-sidebar", "ad-free", "menu-open", "comment-enabled", "widget-area", "[&>p]:mt-2", "50%>x"):
        for n in (1, 2, 3, 6):
            for i in range(n):
                blocks = [f"Heading {say(2)}", *(say(25) for _ in range(1 + i % 3))]
                body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
                want[len(rows)] = "\n".join(blocks)
                rows.append((len(rows), f"http://w{len(want) - i}.example/", f'<html><body><nav><a href="/">Home</a></nav><div class="{name}"><div class="post">{body}</div></div><footer>{say(3)}</footer></body></html>'))
    assert extracted(spark, rows) == want


LAYOUTS = {
    "table": "<html><body><table><tr><td class='left'><a href=/a>One</a><a href=/b>Two</a></td><td class='text'>{}</td></tr></table></body></html>",
    "form": "<html><body><form id='aspnetForm'><div class='menu'><a href=/>Start</a></div><div class='content'>{}</div><div class='comments'><p>A reader says {}.</p></div></form></body></html>",
    "article": "<html><body><header><h2>Site</h2></header><main><article>{}<aside>An aside {}</aside></article><section class='related'><p>More to read {}</p></section></main></body></html>",
}


def test_more_layouts(spark):
    r = random.Random(8)
    say = lambda k: " ".join("".join(r.choice("opqrstu") for _ in range(5)) for _ in range(k))
    rows, want = [], {}
    for layout, page in LAYOUTS.items():
        for i in range(9):
            blocks = [say(3), *(say(30) for _ in range(1 if layout == "table" else 1 + i % 3))]
            want[len(rows)] = "\n".join(blocks)
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            rows.append((len(rows), f"http://{layout}.example/", page.format(body, say(2), say(2))))
    assert extracted(spark, rows) == want


def test_deep_pages_and_a_paragraph_that_most_articles_share(spark):
    deep = "<html><body>" + "<div>" * 5000 + "<p>at the bottom</p>" + "</div>" * 5000 + "</body></html>"
    assert extracted(spark, [(i, "http://deep.example/", deep.replace("bottom", f"bottom {i}")) for i in range(3)]) == {i: f"at the bottom {i}" for i in range(3)}
    r = random.Random(9)
    made = [site(i, r) for i in range(10)]
    rows = [(i, "http://most.example/", p if i else p.replace("<p>Read our fixed closing words every time.</p>", "")) for i, (p, _) in enumerate(made)]
    got = extracted(spark, rows)
    assert got == {i: t + ("\nRead our fixed closing words every time." if i else "") for i, (_, t) in enumerate(made)}


def test_pages_of_menus_alone_are_empty_and_doubts_never_empty_a_page(spark):
    assert extracted(spark, [(1, "http://m.example/", "<nav>Home</nav><footer>x</footer>"), (2, "http://n.example/", "<div class='sidebar'><p>all there is</p></div>")]) == {1: "", 2: "all there is"}


# --- op10: damage ----------------------------------------------------------------------------------


def archives(spark, n=60, url="http://h.example/"):
    pages = spark.createDataFrame([(i, f"{url}{i}", f"<p>page {i}</p>" * 40) for i in range(n)], PAGES).coalesce(1)
    return warc.write_warc(warc.mark_revisits(pages).coalesce(1))


def damaged(spark, files, change):
    """The manifest of a changed copy of its one archive."""
    row = files.collect()[0]
    path = row.path.removeprefix("file://")
    with open(path, "rb") as f:
        data = bytearray(f.read())
    data = change(data)
    with open(path + ".bad", "wb") as f:
        f.write(data)
    return spark.createDataFrame([(row.path + ".bad", len(data), row.n_records)], files.schema)


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_damaged_archives_are_errors(spark, chunk):
    files = archives(spark)
    assert warc.read_warc(files, chunk).count() == 60

    def lose_magic(data, at):
        data[at : at + 4] = b"XXXX"
        return data

    magic = lambda data, k: [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", data)][k]
    for change in (lambda d: lose_magic(d, magic(d, 0)), lambda d: lose_magic(d, magic(d, 20)), lambda d: lose_magic(d, magic(d, 59)), lambda d: d[:-100], lambda d: d[: magic(d, 40)]):
        with pytest.raises(ValueError):
            warc.read_warc(damaged(spark, files, change), chunk).count()


def test_long_addresses_are_whole_and_many_tasks_read(spark):
    files = archives(spark, 30, "http://h.example/" + "a" * 100_000)
    with open(files.first().path.removeprefix("file://"), "rb") as f:
        assert f.read().count(b"a" * 100_000) == 30
    read = warc.read_warc(files, 50_000)
    assert read.count() == 30 and read.rdd.getNumPartitions() > 4
    assert read.select(F.spark_partition_id()).distinct().count() > 2


def test_the_repository_pages_at_the_next_size(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {x.page_id: x.text for x in templates.extract_main_text(pages).collect()}
    assert got == {p.page_id: article(p.html) for p in pages.collect()}


def test_slugs_and_formulas_stay_in_the_article(spark):
    """Words of surroundings in ids and classes of an article's own parts; whole names of surroundings still go."""
    parts = [
        '<h2 id="related-work">Related work</h2><p>Others did this.</p>', '<h2 id="chocolate-chip-cookies">Cookies with chips</h2><p>Bake them.</p>', '<section class="social-impact"><p>It changed much.</p></section>',
        '<p>Euler: <math><mi>e</mi><mo>=</mo><mn>2.718</mn><annotation>e=2.718</annotation></math> holds.</p>', '<h3 id="comments">On comments</h3>', '<p id="notice">A plain word.</p>', '<section id="menu-of-the-day"><p>Soup.</p></section>',
    ]
    gone = ['<div class="related-posts"><p>Gone one</p></div>', '<ul class="share-buttons"><li>Gone two</li></ul>', '<section id="comments"><p>Gone three</p></section>', '<p class="advert">Gone four</p>', '<div class="cookie-notice"><p>Gone five</p></div>']
    want = "Related work\nOthers did this.\nCookies with chips\nBake them.\nIt changed much.\nEuler: e=2.718 holds.\nOn comments\nA plain word.\nSoup."
    for outer in ("article", "main", 'div class="post-body"'):
        body = f"<{outer}>{''.join(parts)}{''.join(gone)}</{outer.split()[0]}>"
        page = f'<html><body><nav>Menu</nav>{body}<div class="acme-sidebar"><p>Gone six</p></div><footer>Foot</footer></body></html>'
        if outer.startswith("div"):  # the slot of a host's pages
            other = [page.replace("Others did this.", f"Others did this {w}.").replace("Soup", f"Soup {w}").replace("Gone one", f"Gone {w}") for w in ("here", "there", "then")]
            rows = [(0, "http://s.example/", page), *((i, "http://s.example/", x) for i, x in enumerate(other, 1))]
            got = {x.page_id: x.text for x in templates.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
            assert "Related work" in got[0] and "It changed much." in got[0] and "Soup." in got[0] and "Gone" not in got[0]
        else:
            assert templates.main_text(page, None, frozenset()) == want


def test_tags_that_never_end_take_linear_time():
    import time

    begin = time.time()
    assert templates.main_text("<p>Kept words.</p>" + "<a " * 350_000, None, frozenset()) == "Kept words."
    for page in ("<a " * 350_000 + ">", "<a '" * 250_000 + "<p>x</p>", "<!-- " * 200_000, "<p>x" + "</b" * 300_000):
        templates.main_text(page, None, frozenset())
    assert time.time() - begin < 60


def test_an_archive_is_read_once(spark):
    """Chunks are read as wholes: the bytes and requests of a reader that counts them."""
    from starloom.llm import files

    r = random.Random(2)
    rows = [(i, f"http://h.example/{i}", "".join(r.choice("abcdefgh <>") for _ in range(r.choice([0, 50, 3000, 3000, 9000, 200_000 if i % 50 == 0 else 10])))) for i in range(400)]
    pages = spark.createDataFrame(rows, PAGES)
    archives = warc.write_warc(warc.mark_revisits(pages.coalesce(1))).collect()

    class Counted:
        def __init__(self, f):
            self.f, self.bytes, self.calls = f, 0, 0

        def read_at(self, n, at):
            data = self.f.read_at(n, at)
            self.bytes, self.calls = self.bytes + len(data), self.calls + 1
            return data

    chunk, total, read, calls, found = 1 << 19, 0, 0, 0, {}
    for a in archives:
        entries = [x.offset for x in warc.verified_entries(spark.createDataFrame([tuple(a)], "path string, n_bytes long, n_records long"), chunk, 2).collect()]
        with files.open_random(a.path) as f:
            counted = Counted(f)
            for at in entries:
                hi = min((at // chunk + 1) * chunk, a.n_bytes)
                found |= {x["page_id"]: (x["payload_bytes"], x["payload_digest"]) for x in warc.read_records(counted, a.path, at, hi, a.n_bytes)}
        total, read, calls = total + a.n_bytes, read + counted.bytes, calls + counted.calls
    assert found == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in rows}
    assert read <= 1.2 * total + len(archives) * 2 * warc.HEADER and calls <= 4 * len(archives) + 3 * (total // chunk + 1)
