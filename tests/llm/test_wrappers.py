import html
import random
import re

from tierfold.llm import wrappers
from tierfold.llm.wrappers import Node, Parsed, blocks, dumps, fold, induced, loads, match, merge, slots, tree_of

DDL = "page_id long, url string, html string, text string, host string"


def page(i, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style><script>var x="</p>";</script></head>
<body class="page"><header class="site"><a href="/">Site &amp; name</a></header><nav><ul><li><a>Home</a><li><a>News {i}</a></ul></nav>
<div class="cookie-notice">We use cookies {i}</div><!-- ad --><div class="ad">Buy {i}</div>
<article><header><h1>Title&nbsp;{i}</h1><p class="byline">By someone</p></header>{body}<aside>Related {i}</aside>
<form><label>Your name</label><input></form><section id="comments"><p>Reader says {i}</p></section></article>
<div class="sidebar widget"><p>Popular {i}</p></div>{extra}<footer>&copy; host {i}</footer>"""


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


def test_article_alone(spark):
    body = "<p><b>First &lt;one&gt;\n  two<br><p>Second<p>Third <i>in</i>line &#233;&eacute;<ul><li>a<li>b</ul><script>no()</script>tail"
    got = extracted(spark, [(i, f"http://h.example/{i}", page(i, body)) for i in range(4)])
    assert got[2] == "Title 2\nFirst <one> two\nSecond\nThird inline éé\na\nb\ntail"


def test_template_by_alignment(spark):
    """Pages without telling elements: what is the same on all pages of the host is template."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(word() for _ in range(12)) for _ in range(rng.randrange(2, 5))]
        links = "".join(f"<div class=z1><a href=/{k}>{word()}</a></div>" for k in range(5))
        rows.append((i, f"http://Plain.example:80/{i}", f"<div class=q7><p>All rights reserved by the plain house</p></div>{links}<div class=k2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class=q8>Imprint and terms of the house</div>"))
        want[i] = "\n".join(paragraphs)
    # The same words on a host where they are no template stay.
    rows.append((100, "http://other.example/", "<p>All rights reserved by the plain house</p>"))
    want[100] = "All rights reserved by the plain house"
    assert extracted(spark, rows) == want


def test_copies_are_no_template(spark):
    text = [f"sentence {k} of a copied page" for k in range(5)]
    body = "".join(f"<p>{t}</p>" for t in text)
    rows = [(i, f"http://c.example/{i}", f"<p>own {i}</p>{body}") for i in range(40)] + [(i, f"http://c.example/{i}", body) for i in range(40, 80)]
    got = extracted(spark, rows)
    assert got[3] == "\n".join(["own 3", *text]) and got[50] == "\n".join(text)


def test_odd_rows(spark):
    long = "<article>" + "<p>word " * 20_000 + "</article>"
    rows = [(1, None, None), (2, "http://a/", ""), (3, "nonsense", "plain text only"), (4, "http://a/", long), (4, "http://a/", long), (5, "http://a/", "<p unclosed 'quote <b>x"), (6, "http://a/", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "http://a/", "<p>x</p>"), (7, "http://a/", "a < b <script>gone forever")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)
    got = {}
    for r in wrappers.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["plain text only"] and got[6] == ["deep"] and got[None] == ["x"]
    assert len(got[4]) == 2 and got[4][0].count("word") == 20_000 and got[7] == ["a < b"]
    assert wrappers.extract(spark.createDataFrame([], DDL)).count() == 0


def test_test_pages_as_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for r in df.collect():
        inside = re.search("<article>(.*?)(?:</article>|<footer|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br|article)>", inside)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def brute_match(a, b):
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        here = brute_match(x[0], y[0])
        # A list node may stay for the next sibling.
        return max(best(x[1:], y), best(x, y[1:]), here + best(x[1:], y[1:]), here + best(x, y[1:]) if here and x[0].many else 0)

    return 1 + best(a.children, b.children)


def random_tree(rng, depth, lists=True):
    return Node(rng.choice("abc"), [random_tree(rng, depth - 1, lists) for _ in range(rng.randrange(0, 4))] if depth else [], lists and rng.random() < 0.3)


def test_tree_matching_as_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (Node("r", [random_tree(rng, 2) for _ in range(3)]) for _ in range(2))
        assert match(a, b, {}) == brute_match(a, b)


def test_slots_are_a_best_matching():
    """Pairs keep order and labels, and there are as many as brute force finds."""
    rng = random.Random(3)
    for _ in range(60):
        a, b = (Node("r", [random_tree(rng, 1, False) for _ in range(3)]) for _ in range(2))
        got, labels = slots(a, b), [x.label for x in a.leaves()]
        assert [labels[k] for k in got if k >= 0] == [y.label for k, y in zip(got, b.leaves()) if k >= 0]
        on = [k for k in got if k >= 0]
        assert on == sorted(on)


def tree(html):
    return fold(tree_of(blocks(html)))


def test_siblings_stay_apart():
    """Two siblings of one label are two slots where they look different, and one list where they look alike."""
    one = tree("<body><div><a>x</a></div><div><p>t</p><p>u</p></div>")
    assert [(c.label, c.many) for c in one.children[0].children] == [("div", False), ("div", False)]
    three = tree("<body>" + "<div><p>t</p></div>" * 3)
    assert [(c.label, c.many) for c in three.children[0].children] == [("div", True)]


def test_prose_is_one_list():
    page = tree("<body><h1>t</h1>" + "<h2>a</h2><p>b</p><p>c</p><ul><li>d</li></ul>" * 30)
    assert [c.label for c in page.children[0].children] == ["h1", "*"] and len(page.leaves()) == 4
    assert sorted(k for x in page.leaves() for k in x.at) == list(range(121))


def test_alignment_with_optional_nodes():
    """What only some pages have goes in between; the rest keeps its slots."""
    plain, more = "<body><div>a</div><table><tr><td>x</table><div><p>c</p></div>", "<body><div>a</div><div><ul><li>n</ul></div><table><tr><td>x</table><div>e</div><div><p>c</p></div>"
    w = loads(induced([(dumps(tree(plain)), 3), (dumps(tree(more)), 2)]))
    a, b = slots(w, tree(plain)), slots(w, tree(more))
    assert sorted(set(a)) == a and sorted(set(b)) == b and set(a) < set(b) and len(b) == len(w.leaves())
    assert [x.n for x in w.leaves()] == [5, 2, 5, 2, 5]


def test_rare_nodes_leave_the_wrapper():
    common, rare = tree("<body><p>a</p>"), tree("<body><p>a</p><pre>b</pre>")
    assert len(loads(induced([(dumps(common), 40), (dumps(rare), 1)])).leaves()) == 1
    assert len(loads(induced([(dumps(common), 10), (dumps(rare), 1)])).leaves()) == 2


def test_wrapper_in_groups_as_at_once(spark):
    """Groups and rounds give a wrapper with the same leaves as one alignment."""
    pages = [f"<body><div>a</div>{'<ul><li>n</ul>' * (i % 2)}<table><tr><td>x</table>{'<pre>e</pre>' * (i % 3)}<div><p>c</p></div>{'<dl><dd>q</dl>' * (i % 5 > 1)}" for i in range(40)]
    shapes = sorted({dumps(tree(p)) for p in pages})
    rows = spark.createDataFrame([(h, s, 1) for h in ("h", "g") for s in shapes], "host string, shape string, n long")
    got = {r.host: r.wrapper for r in wrappers.wrappers_of(rows, 3).collect()}
    once = loads(induced([(s, 1) for s in shapes]))
    assert got["h"] == got["g"] and loads(got["h"]).n == once.n == len(shapes)
    assert [(x.label, x.n) for x in loads(got["h"]).leaves()] == [(x.label, x.n) for x in once.leaves()]


def test_merging_keeps_all_nodes():
    rng = random.Random(5)
    for _ in range(30):
        trees = [Node("", [random_tree(rng, 2, False) for _ in range(3)]) for _ in range(4)]
        w = Node("", n=0)
        for t in trees:
            merge(w, loads(dumps(t)))
        assert w.n == 4
        for t in trees:
            assert match(w, t, {}) >= 1 and all(x.n <= 4 for x in w.leaves())


WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def untagged(rng, i, n_links, n_text):
    """Links and content are divs without names, links first; some pages have a further div of links before or after."""
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    links = "".join(f"<p><a href=/{k}>{say(3)}</a></p>" for k in range(n_links))
    text = [say(rng.randrange(8, 15)) for _ in range(n_text)]
    page = f"<body><div>The weekly paper of the town</div><div>{links}</div>{('<div><ul><li><a>' + say(2) + '</a></ul></div>') * (i % 2)}<div>{''.join(f'<p>{t}</p>' for t in text)}<p>Share this text with others</p></div><div>All rights reserved, {i % 2 and 'printed' or 'made'} in town</div>"
    return page, text


def test_alignment_decides_without_telling_names(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(24):
        html_, text = untagged(rng, i, 4, 3 + i % 3)
        rows.append((i, f"http://plain.example/{i}", html_))
        want[i] = "\n".join(text + [f"All rights reserved, {i % 2 and 'printed' or 'made'} in town"])
    assert extracted(spark, rows) == want
    # By label paths alone, links and content are one slot, and the links stay.
    model = {r.host: r for r in wrappers.induce(spark.createDataFrame([("plain.example", r[2]) for r in rows], "host string, html string")).collect()}["plain.example"]
    w = loads(model.wrapper)

    def by_path(node, path=()):
        return [(*path, node.label)] if not node.children else [p for c in node.children for p in by_path(c, (*path, node.label))]

    paths = [tuple(x.replace("#a", "#") for x in p) for p in by_path(w)]
    assert len(set(paths)) < len(paths)
    linked = {paths[k] for k in model.links}
    assert linked & {p for k, p in enumerate(paths) if k not in model.links}


def test_small_hosts_as_brute_force(spark):
    """Every block of every page against a direct reading of the rules, with slots from pairwise brute-force matching to the host's first page."""
    rng = random.Random(9)
    rows, pages = [], {}
    for h in range(6):
        for i in range(3 + h):
            say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
            parts = [("h4", "Notes of the house" if rng.random() < 0.9 else say(3)), ("pre", say(30)), ("dd", "Printed in town"), ("blockquote", say(20))]
            key = len(rows)
            rows.append((key, f"http://h{h}.example/{i}", "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts)))
            pages.setdefault(h, []).append((key, parts))
    got = extracted(spark, rows)
    for found in pages.values():
        n = len(found)
        const = {(k, parts[k][1]) for _, parts in found for k in range(4) if sum(p[k] == parts[k] for _, p in found) >= max(3, 0.8 * n)}
        for key, parts in found:
            assert got[key] == "\n".join(x for k, (_, x) in enumerate(parts) if (k, x) not in const)


def test_packed_pages_as_broadcast(spark):
    """Beyond the bound of the broadcast the same rows come from packed pages, a hot host in salts."""
    rng = random.Random(10)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example/{i}", untagged(rng, i, 3, 3)[0]) for i in range(60)] + [(99, None, None), (98, "http://hot.example/", page(1, "<p>x"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)
    as_rows = lambda d: sorted(map(tuple, d.collect()))
    assert as_rows(wrappers.extract(df)) == as_rows(wrappers.extract(df, bound=0))


def test_page_packs_and_unpacks():
    p = Parsed.of("<body><article><p>one <a>two</a><p>\udc80three")
    assert Parsed.unpack(p.pack()) == p


def test_blocks_know_their_place():
    found = blocks("<main><h1>T</h1><table><tr><td>1<td>2<tr><td>3</table></main><p>after")
    assert [(b.text, b.inside) for b in found] == [("T", True), ("1", True), ("2", True), ("3", True), ("after", False)]


def test_class_words_do_not_hide_the_content():
    text = lambda html: [b.text for b in blocks(html) if not b.skipped]
    article = "<article><h1>Title</h1><p>The main text of the page.</p></article>"
    for around in ("<div class='content has-sidebar'>{}</div>", "<div class='page no-comments'>{}</div>", "<div class='elementor-widget'>{}</div>", "<form action=/>{}</form>", "<div class=widget><form>{}</form></div>"):
        assert text(around.format(article)) == ["Title", "The main text of the page."]
        assert text(around.format("<p>The main text of a page without article.</p>")) == ["The main text of a page without article."]
    assert text(f"<div class=has-sidebar>{article}<div class=sidebar><p>Popular</p></div></div>") == ["Title", "The main text of the page."]
    # What a whole class name calls comments stays out, however long, and articles in it.
    comments = "<section id=comments>" + "<article class=comment><p>A reader says something at length here.</p></article>" * 9 + "</section>"
    assert text(article + comments) == text(f"<div class=has-comments>{article}{comments}</div>") == ["Title", "The main text of the page."]
    assert text(f"{article}<form><p>Your name</p></form><div class=ad>Buy</div>") == ["Title", "The main text of the page."]
    assert text("<article><h1>T</h1><div class='entry no-comments'><p>The main text of the page.</p></div></article>") == ["T", "The main text of the page."]


def test_template_of_small_hosts(spark):
    rows, want = [], {}
    for host, n in (("three.example", 3), ("five.example", 5), ("nineteen.example", 19)):
        for i in range(n):
            key = len(rows)
            own = [f"what page {i} of {host} alone tells, line {k} of it" for k in range(4)]
            rows.append((key, f"http://{host}/{i}", "<div class=q7><p>All rights reserved by the house</p></div><div class=k2>" + "".join(f"<p>{p}</p>" for p in own) + "</div><div class=q8>Imprint and terms</div>"))
            want[key] = "\n".join(own)
    assert extracted(spark, rows) == want
