import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.html_extract import extract_text, lcs_shared, nearest_paths, page_lines


def lcs_length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    shared = lcs_shared(np.array(a, np.int64), np.array(b, np.int64))
    kept = [x for x, s in zip(a, shared) if s]
    assert len(kept) == lcs_length(a, b) == lcs_length(kept, b)


def texts(page, kinds=(0, 1)):
    return [t for t, k in page_lines(page) if k in kinds]


def test_lines():
    page = '<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><!-- c --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;four</article><aside>side</aside><form><input>q</form><section id="comments">hey</section><footer>f'
    assert texts(page, (1,)) == ["A & B", "one two", "three four"] and texts(page, (0,)) == []
    assert texts("<div class=\"load\">kept</div>") == ["kept"]
    assert texts("<div class='cookie-banner'>x</div>y<p>z") == ["y", "z"]
    assert texts("</div></p>a < b &lt;i&gt;<unclosed") == ["a < b <i><unclosed"]
    assert texts("") == [] and texts("<p>" * 5000 + "deep") == ["deep"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<article><div class=share><p>x</article>y") == []
    assert texts("<article><header><h1>Title</h1></header><p>a</article><header>site</header>", (1,)) == ["Title", "a"]
    assert texts('<div class="related-work">kept</div><div class="site-header adSlot">x</div><p>1 <math><mi>x</mi></math>') == ["kept", "1 x"]


PAGES = [
    (1, "http://h.com/a/1", "<p>Site name</p><p>first text</p><p>Imprint</p>", "u"),
    (2, "http://h.com/a/2", "<p>Site name</p><p>second text</p><p>Imprint</p>", "u"),
    (3, "http://h.com/b/1", "<p>Site name</p><p>third text</p>", "u"),
    (4, "http://alone.com/x", "<p>Site name</p><p>all of it</p>", "u"),
    (5, None, "<p>null url</p>", "u"),
    (6, "http://h.com/a/1", None, "u"),
    (7, "http://k.com/1", "<article><p>copy</p></article>", "u"),
    (8, "http://k.com/2", "<article><p>copy</p></article>", "u"),
    (None, "http://k.com/3", "", "u"),
    (1, "http://h.com/a/1", "<p>Site name</p><p>first text</p><p>Imprint</p>", "u"),
    (9, "http://big.com/1", "<p>" + "word " * 50_000 + "</p>", "u"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_shared_lines_go_and_articles_stay(spark):
    got = extract_text(frame(spark, PAGES)).collect()
    assert len(got) == len(PAGES) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {(r.page_id, r.url): r.text for r in got if r.page_id != 6}
    assert by[2, "http://h.com/a/2"] == "second text"
    assert by[1, "http://h.com/a/1"] == "first text" and by[3, "http://h.com/b/1"] == "third text"
    assert by[4, "http://alone.com/x"] == "Site name\nall of it" and by[5, None] == "null url"
    assert by[7, "http://k.com/1"] == by[8, "http://k.com/2"] == "copy" and by[None, "http://k.com/3"] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(frame(spark, [])).collect() == []


def brute(rows):
    """The whole operator over one host, page by page."""
    pages = {path: page_lines(page) for path, page in rows}
    paths, out = sorted(pages), {}
    for i, path in enumerate(paths):
        near = max([q for q in (paths[max(0, i - 1)], paths[min(i + 1, len(paths) - 1)]) if q != path], key=lambda q: len(os.path.commonprefix([path, q])), default=None)
        mine, theirs = pages[path], [t for t, _ in pages[near]] if near else []
        n = [[0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
        for a in range(len(mine)):
            for b in range(len(theirs)):
                n[a + 1][b + 1] = n[a][b] + 1 if mine[a][0] == theirs[b] else max(n[a][b + 1], n[a + 1][b])
        a, b, shared = len(mine), len(theirs), set()
        while a and b:
            if mine[a - 1][0] == theirs[b - 1]:
                a, b = a - 1, b - 1
                shared.add(a)
            elif n[a - 1][b] >= n[a][b - 1]:
                a -= 1
            else:
                b -= 1
        seen = [k for k, (_, kind) in enumerate(mine) if kind != 2]
        article = [k for k in seen if mine[k][1] == 1]
        if all(k in shared for k in seen):
            shared = set()
        same = 2 * len([k for k in article if k in shared]) >= max(1, len(article))
        often = lambda t: sum(any(x == t for x, _ in lines) for lines in pages.values()) >= max(3, len(pages) // 2 + 1)
        out[path] = "\n".join(mine[k][0] for k in seen if k not in shared or mine[k][1] == 1 and (same or not often(mine[k][0])))
    return out


def site(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        section = int(rng.integers(4))
        top = ["Site name"] + (["Section %d" % section] if rng.random() < 0.8 else [])
        body = [f"own line {i} {j}" for j in range(int(rng.integers(0, 6)))]
        if rng.random() < 0.7:
            body.insert(int(rng.integers(len(body) + 1)), "Share this with all your friends")
        if rng.random() < 0.2:
            body.append("A saying that many articles quote.")
        if rng.random() < 0.3:
            body.append(f"passage of two pages {i // 2}")
        if i % 10 == 1:
            body = [f"own line {i - 1} {j}" for j in range(4)]  # nearly the neighbour's article
        wrap = rng.random() < 0.7
        page = "".join(f"<p>{x}</p>" for x in top) + ("<article>" if wrap else "") + "".join(f"<p>{x}</p>" for x in body) + ("</article>" if wrap else "") + f"<footer>unlike any other {i}</footer><p>Imprint</p>"
        rows.append((f"/{'abcd'[section]}/{int(rng.integers(1000)):03}-{i:02}", page))
    return rows


def test_whole_operator_against_brute_force(spark):
    rows = site(1)
    got = extract_text(frame(spark, [(i, "http://host.net" + path, page, "x") for i, (path, page) in enumerate(rows)]))
    want = brute(rows)
    got = {r.url[len("http://host.net") :]: r.text for r in got.collect()}
    assert got == want
    # the comparison is what takes these lines away: they stand in no element that would tell
    declared = {path: "\n".join(t for t, kind in page_lines(page) if kind != 2) for path, page in rows}
    assert sum("Imprint" in t for t in declared.values()) == 60 and sum("Imprint" in t for t in got.values()) < 6
    assert sum("many articles quote" in t for t in got.values()) > 3
    assert sum("Share this" in t for t in got.values()) < sum("Share this" in t for t in declared.values())


def test_nearest_paths(spark):
    paths = [f"/wiki/{i:03}" for i in range(300)] + ["/a/1", "/a/12", "/a/2", "/b", "/longer/path/1", "/longer/path/2", "/longer/z"]
    df = spark.createDataFrame([("h", p) for p in paths] + [("other", "/a/1"), ("h", "/b")], "host string, path string")
    got = {r.path: r.near_path for r in nearest_paths(df).filter("host = 'h'").collect()}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for p in paths:
        assert common(p, got[p]) == max(common(p, q) for q in paths if q != p)
    assert nearest_paths(df).filter("host = 'other'").count() == 0
