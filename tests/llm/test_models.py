import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import language, quality, simhash
from tessella.llm.components import components
from tessella.llm.html_text import extract, main_text
from tessella.llm.pieces import Tokenizer, encode, encode_digests
from tessella.llm.url_filter import url_filter

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, id string, row int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 0, "w") for i, t in rows], DOCS)


# -- html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; &amp;amp;", "plain <b> &amp;"),
        ("<p>a<p>b  \n c", "a\nb c"),
        ("<script>var t='</p>';x</script><p>only</p>", "only"),
        ("<style>p{}</style><title>t</title><article><h1>T</h1><p>one<br>two</p></article>", "T\none two"),
        ("<body><nav><a href=x>m</a></nav><div class='ad'>buy</div><article><p><b>Head<br><p>Text, text.</article><footer>f</footer>", "Head\nText, text."),
        ("<div id='comments'><p>c</p></div><div><p>Long enough, with commas, to win the scores of this page.</p></div>", "Long enough, with commas, to win the scores of this page."),
        ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"),
        ("<article><p>one</p><!-- c <p>no</p> --><section><p>two</p></section><aside>no</aside><form><p>no</p></form></article>", "one\ntwo"),
        ("<p>1 < 2 and a<b</p>", "1 < 2 and a"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_main_text_links_lose_and_siblings_stay():
    link = "<li><a href='/x'>" + "word, " * 30 + "</a></li>"
    para = "<p>" + "some words, more words, " * 12 + "</p>"
    assert main_text(f"<div><ul>{link * 8}</ul></div><div>{para * 3}</div>").count("\n") == 2
    assert main_text("<div>" + "<div><p>a</p>" * 3000) == "\n".join("a" * 3000)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "q"), (1, "u", "<p>é</p>", "q"), (None, None, None, "q")], "page_id long, url string, html string, text string")
    got = sorted((r.id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert got == [(0, "", 0), (1, "é", 1), (1, "é", 1)] and extract(df.limit(0)).count() == 0


PARA = "Some words, more words and other things, told at length in one sentence. " * 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # names that mislead: the accused container holds the page
        (f'<div class="search-results-explained"><p>{PARA}</p><p>{PARA}</p></div><div><p>tiny</p></div>', PARA.strip() + "\n" + PARA.strip()),
        (f'<div class="layout has-sidebar"><div class="sidebar"><p>side, bar</p></div><div><p>{PARA}</p></div></div>', PARA.strip()),
        (f'<div id="search-page"><article><p>{PARA}</p></article></div>', PARA.strip()),
        (f'<div><h2 id="social-impact">Impact</h2><p>{PARA}</p></div>', "Impact\n" + PARA.strip()),
        (f'<article><p>{PARA}</p><p class="alert">kept</p></article>', PARA.strip() + "\nkept"),
        (f"<article><header><h1>Head</h1></header><p>{PARA}</p></article>", "Head\n" + PARA.strip()),
        # names that are right
        (f'<div class="notice"><p>We use cookies, as all do.</p></div><div><p>{PARA}</p></div>', PARA.strip()),
        (f'<div><p>{PARA}</p></div><div id="comments">' + f"<p>{PARA}</p>" * 5 + "</div>", PARA.strip()),
        (f'<article><p>{PARA}</p><p class="ad">buy</p><div class="ad"><p>buy</p></div></article>', PARA.strip()),
        (f'<header>top</header><div hidden><p>{PARA}</p></div><div><p>{PARA}</p></div>', PARA.strip()),
        ('<div class="ad"><p>only, an advert</p></div>', ""),
        (f'<main><div class="x"><p>{PARA}</p></div><div>' + "<a href='/x'>" + "link " * 90 + "</a></div></main>", PARA.strip()),
    ],
)
def test_class_words_accuse(html, text):
    assert main_text(html) == text


def brute_main_text(source):
    """The scoring alone, for well-formed pages of div, ul, li, p and a, by the definition."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.here = {"tag": "", "up": None, "kids": []}

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "up": self.here, "kids": []}
            self.here["kids"].append(node)
            self.here = node

        def handle_endtag(self, tag):
            self.here = self.here["up"]

        def handle_data(self, data):
            self.here["kids"].append(data)

    tree = Tree()
    tree.feed(source)
    paragraphs, order = {"p", "li"}, []

    def text(node, linked=False):
        """All characters below, and those in links."""
        if isinstance(node, str):
            return len(node), len(node) * linked
        both = [text(k, linked or node["tag"] == "a") for k in node["kids"]]
        return sum(a for a, _ in both), sum(b for _, b in both)

    def blocks(node):
        if node["tag"] in paragraphs:
            def words(n):
                return n if isinstance(n, str) else "".join(map(words, n["kids"]))

            yield node, words(node)
        else:
            for k in node["kids"]:
                if not isinstance(k, str):
                    yield from blocks(k)

    found = list(blocks(tree.root))
    points, nodes = {}, []

    def walk(node):
        nodes.append(node)
        for k in node["kids"]:
            if not isinstance(k, str):
                walk(k)

    walk(tree.root)
    for node, x in found:
        worth, up, level = 1 + x.count(",") + min(len(x) / 100, 3), node["up"], 0
        while up is not None:
            if up["tag"] != "a":
                points[id(up)] = points.get(id(up), 0) + worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = up["up"]

    def score(node):
        size, linked = text(node)
        return points.get(id(node), 0) * (1 - (linked / size if size else 0))

    best = max(nodes, key=score)  # the first of equals
    kept = [best]
    if best["up"] is not None:
        for k in best["up"]["kids"]:
            if not isinstance(k, str) and k is not best:
                size, linked = text(k)
                dense = linked / size if size else 1
                if (score(k) >= 0.2 * score(best) and dense < 0.5) or (k["tag"] in paragraphs and size > 80 and dense < 0.25):
                    kept.append(k)

    def inside(node):
        return any(node is k for k in kept) or (node["up"] is not None and inside(node["up"]))

    return "\n".join(x for node, x in found if x and inside(node)), order


def test_many_accused_elements():
    """Nested and side by side, in time that grows with the page."""
    deep = main_text("<div class='menu'>" * 3000 + f"<p>{PARA}</p>" + "</div>" * 3000)
    assert deep == PARA.strip()
    flat = main_text("".join(f"<div class='widget'><p>widget {k}, with some words, here</p></div>" for k in range(3000)) + f"<div><p>{PARA}</p></div>")
    assert len(flat) > 0


def test_scoring_is_brute_force():
    """Pages without article and main elements, where only the points decide."""
    r = random.Random(21)
    words = ["alpha", "beta,", "gamma", "delta,", "river"]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    def block():
        tag = r.choice(["p", "p", "p", "li"])
        inner = text(r.choice([1, 3, 10, 40, 90]))
        inner = f"<a>{inner}</a>" if r.random() < 0.3 else inner + (f" <a>{text(3)}</a>" if r.random() < 0.3 else "")
        return f"<{tag}>{inner}</{tag}>"

    def container(depth):
        kids = [container(depth - 1) if depth and r.random() < 0.45 else block() for _ in range(r.randint(1, 5))]
        tag = r.choice(["div", "div", "section", "ul"])
        return f"<{tag}>{''.join(kids)}</{tag}>"

    some = 0
    for _ in range(300):
        page = "".join(container(3) for _ in range(r.randint(1, 4)))
        want, _ = brute_main_text(page)
        assert main_text(page) == want
        some += want.count("<") == 0 and 0 < len(want) < len(brute_all(page))
    assert some > 100


def brute_all(page):
    import re

    return re.sub("<[^>]*>", "", page)


# -- quality and language


def test_quality_learns_layout(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "stone", "river"]
    rows = [(i, " ".join(r.choice(words) + ("$$$" if i % 3 == 0 else "") for _ in range(30))) for i in range(400)]
    d = frame(spark, [*rows, (900, None), (901, ""), (902, "x " * 50_000)])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.learn(d, labels)
    got = quality.score(d, w).join(labels.where("quality is not null"), F.col("id") == labels.doc_id).collect()
    assert all((x.score >= 0.5) == (x.quality == 1) for x in got)
    every = {x.id: x.score for x in quality.score(d, w).collect()}
    assert every[900] == every[901] and all(0 <= s <= 1 for s in every.values()) and len(every) == 403
    assert (quality.learn(d, labels) == w).all()  # the same again
    assert quality.learn(d, labels.limit(0)) is None and quality.score(d, None).first().score == 0.5
    assert quality.score(d.limit(0), w).count() == 0


def test_quality_never_learns_from_held_out_rows(spark):
    d = frame(spark, [(i, "word") for i in range(50)])
    from tessella.llm.shared import held_out

    out = [r[0] for r in d.where(held_out()).select("doc_id").collect()]
    assert out and quality.learn(d, spark.createDataFrame([(i, 1) for i in out], "doc_id long, quality int")) is None
    import zlib

    assert set(out) == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_features_are_whole_rows():
    texts = ["a b a", None, "", "!!! a", "a b a"]
    (_, cut, index, value), = quality.features(pa.array(texts))
    assert len(cut) == 6 and cut[1] == cut[2] == cut[3]
    one = lambda k: sorted(zip(index[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]], strict=True))
    assert one(0) == one(4) != one(3)


def test_language(spark):
    r = random.Random(2)
    parts = {"xx": ["zu", "ka", "mo"], "yy": ["en", "sch", "ung"]}
    text = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(40))
    rows = [(i, text(k), k) for i in range(120) for k in [list(parts)[i % 2]]] + [(500, text("xx"), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.learn(d)
    assert list(m) == ["xx", "yy"]
    got = {x.id: x for x in language.identify(d, m).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if k) and got[500].lang_pred == "xx"
    odd = frame(spark, [(1, None), (2, ""), (3, "12 !? 3"), (4, "ZUKAMO"), (5, "中文字"), (6, "a"), (7, "zuka " * 30_000), (8, "".join(chr(0x4E00 + k) for k in range(3000)))])
    found = {x.id: (x.lang_pred, x.score) for x in language.identify(odd, m).collect()}
    assert [found[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and found[4][0] == found[7][0] == "xx" and all(0 <= s <= 1 for _, s in found.values())
    kept = language.drop_rejected(odd, m)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect()) == [4, 5, 6, 7, 8]
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.learn(d.limit(0)) == {} and language.identify(odd.limit(0), m).count() == 0


def test_profiles_agree_with_and_without_kept_vectors():
    texts = ["hello world", "Ärger über Ä", "a", None, "12", "中文 and more", "hello hello", "x" * 5000]
    p, q, few = language.Profiles(), language.Profiles(), language.Profiles()
    q.KEPT = 0
    few.KEPT = 12
    together = p.of_all(texts)
    assert sorted(together) == [0, 1, 2, 5, 6, 7]
    for k, t in enumerate(texts):
        for other in (q.of(t), few.of(t), few.of_all(texts).get(k)):
            assert (other is None) == (k not in together) and (other is None or np.allclose(together[k], other))


def test_scripts_do_not_slow_each_other():
    import time

    r = random.Random(3)
    latin = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(150)) for _ in range(500)]
    other = ["".join(chr(0x4E00 + min(r.randrange(3000), r.randrange(3000))) for _ in range(300)), "".join(chr(r.randrange(0x400, 0x460)) for _ in range(900)), "".join(chr(0xAC00 + r.randrange(9000)) for _ in range(300))]

    def took(texts):
        p = language.Profiles()
        p.of_all(texts[:100])
        began = time.process_time()
        for at in range(0, len(texts), 100):
            p.of_all(texts[at : at + 100])
        return time.process_time() - began

    plain = min(took(latin) for _ in range(3))
    mixed = min(took([*other, *latin]) for _ in range(3))
    assert mixed < 1.3 * plain + 0.15
    p, q = language.Profiles(), language.Profiles()
    together = p.of_all([*other, *latin[:40]])
    assert all(np.allclose(together[k], q.of(t)) for k, t in enumerate([*other, *latin[:40]]))


def test_profiles_are_brute_force(spark):
    """Letters' vectors, turned by their place, multiplied and added up, one number after the other."""

    def vector(c):
        return language._random(np.array([ord(c)], np.uint32))[0].astype(int)

    def turned(v, n):
        return np.concatenate([v[len(v) - n :], v[: len(v) - n]]) if n else v

    def profile(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        letters = f" {' '.join(letters.split())} "
        out = np.zeros(language.SIZE, int)
        for k in range(len(letters) - 2):
            a, b, c = letters[k : k + 3]
            out += turned(vector(a), 2) * turned(vector(b), 1) * vector(c)
        return out

    unit = lambda x: x / np.linalg.norm(x)
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat", "en"), ("a cat, the hat!", "en"), ("die katze saß", "de"), ("der hut  ist 3", "de"), ("the the the", "en"), ("das ist", "de")] * 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from tessella.llm.shared import held_out

    out = {r[0] for r in d.where(held_out()).select("doc_id").collect()}
    assert out
    learnt = language.learn(d)
    want = {name: unit(sum(unit(profile(t)) for k, t, lang in rows if lang == name and k not in out)) for name in ("de", "en")}
    assert list(learnt) == ["de", "en"] and all(np.allclose(learnt[k], want[k], atol=1e-5) for k in want)
    tests = ["Cat the hat", "Katze ist", "ä1b"]
    got = {x.id: x for x in language.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), learnt).collect()}
    for k, t in enumerate(tests):
        cosines = {name: float(unit(profile(t)) @ want[name]) for name in want}
        best = max(cosines, key=cosines.get)
        assert got[k].lang_pred == best and abs(got[k].score - max(0.0, cosines[best])) < 1e-5


def test_quality_training_is_brute_force():
    """FTRL-proximal, number by number over dictionaries."""
    import math

    r = random.Random(12)
    examples = [(np.array(sorted(r.sample(range(8), r.randint(1, 5)))), None, r.randint(0, 1)) for _ in range(40)]
    examples = [(i, np.array([r.random() for _ in i], np.float32), y) for i, _, y in examples]
    alpha, beta, l1, l2, z, n = 0.3, 1.0, 0.05, 0.01, {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for index, value, label in examples:
            x = {**dict(zip(index.tolist(), map(float, value), strict=True)), "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    got = quality.train(examples, 3, 3, alpha, beta, l1, l2)
    assert np.allclose(got, [*(weight(k) for k in range(8)), weight("bias")]) and np.count_nonzero(got) > 3


def test_quality_scores_are_brute_force(spark):
    """A score is a logistic function of the dot product with a text's features, of which each kind weighs 1 in all."""
    texts = ["A word, a word!", None, "", "x 12 X1 yy YY Yy ...", "é é é"]
    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), w).orderBy("id").collect()]
    (_, cut, index, value), = quality.features(pa.array(texts))
    for k, s in enumerate(got):
        dot = sum(float(w[i]) * float(v) for i, v in zip(index[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]], strict=True))
        assert abs(s - 1 / (1 + np.exp(-(dot + float(w[-1]))))) < 1e-6
    kinds = [sum(value[cut[k] : cut[k + 1]]) for k in range(len(texts))]
    assert np.allclose(kinds, [4, 0, 0, 4, 4])


# -- urls


def test_url_rules(spark):
    urls = {
        1: ("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://b.net/", "b.net", "/", "net/", "block"),
        3: ("http://b.net", "b.net", "", None, None),
        4: ("https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        5: ("https://example.com/de/#a", "example.com", "/de/", "example.com/de/", "block"),
        6: ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
        7: (None, "", "", None, None),
        8: ("no scheme.net/", "", "", None, None),
        9: ("a://b://c.net/x", "b:", "//c.net/x", None, None),
        10: ("x://Ü.net?/a", "Ü.net", "", None, None),
        11: ("http://" + "a" * 50_000 + ".net/", "a" * 50_000 + ".net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([(i, v[0], "q") for i, v in urls.items()], "page_id long, url string, host string")
    got = {r.id: r for r in url_filter(df).collect()}
    for i, (_, host, path, rule, verdict) in urls.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter(df, rules=[]).collect()} == {"allow"}


def test_url_model_tells_hosts_apart(spark):
    rows = [(i, f"http://good{i}garden.org/fr/{i}") for i in range(40)] + [(100 + i, f"http://cheap{i}pills.net/") for i in range(40)]
    rows += [(200, "http://goodgarden.info/fr/"), (201, "http://cheappills.info/")]
    got = {r.id: r.verdict for r in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block"


# -- simhash


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = [None, "", " \t", "One", "a b c", "a b c d", "A  b\nc d e é", "x " * 9000, "\x0b\x0c a"]
    assert [int(x) for x in simhash.fingerprints_of(pa.array(texts))] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_join_is_brute_force(seed):
    r = np.random.default_rng(seed)
    centers = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = centers[r.integers(0, 12, 500)]
    for _ in range(int(3 + seed)):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    fps = np.unique(fps)
    want = brute_components([int(x) for x in fps])
    for small in (1, 64, 10**6):
        assert simhash.trie_join(fps, np.array([0, len(fps)]), small=small, slice_=4096).tolist() == want


@pytest.mark.parametrize(("hot", "dense"), [(200_000, 4_000), (5, 4_000), (200_000, 1)])
def test_near_dedup_is_brute_force(spark, hot, dense):
    r = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = [f"{i % 6}{x}" for x in base]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(200)] = "new"
        rows.append((i + 10, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "solo text"), (300, rows[0][1])]
    got = {x.id: x.component_id for x in simhash.near_dedup(frame(spark, rows), hot=hot, dense=dense).collect()}
    ids = sorted(i for i, _ in rows)
    comp = brute_components([brute_fingerprint(dict(rows)[i]) for i in ids])
    assert got == {i: ids[comp[k]] for k, i in enumerate(ids)}
    assert got[2] == 1


def test_near_dedup_nulls_and_filter(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, "other words are here now"), (None, "third words stand alone here")]
    got = simhash.near_dedup(frame(spark, rows)).collect()
    assert sorted((r.id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (7, 7), (7, 7), (8, 8)]
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept.collect()) == [(0, "third"), (7, "a b c"), (8, "other")]
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_components_of_nothing_and_odd_links(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (7, 6), (8, 7), (9, 8)], "a long, b long")
    assert {x.node: x.root for x in components(odd).collect()} == {5: 4, 7: 6, 8: 6, 9: 6}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 60: 40}


# -- pieces


def test_pieces_are_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    data = open(path, "rb").read()
    t = Tokenizer(data, remember=50)
    r = random.Random(6)
    alphabet = "abcdefghijklmno  \n\té▁ENTHRES你🙂.,<>0x1\x00ｶﾞ"
    texts = ["", " ", "   ", "Hello  world\n▁x é 你 <0x0A> <s> </s> \x00 a", "a" * 300, " " * 70 + "x", "\r\n a\r\n", "hello" * 400]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(400)]
    for x in texts:
        ids = sp.encode(x)
        assert t.encode(x) == ids and t.decode(ids) == sp.decode(ids)
        assert t.digest(x)[0] == len(ids)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 400), r.randrange(32_000)]) for _ in range(r.randint(1, 9))]
        assert t.decode(ids) == sp.decode(ids)
    long = ["".join(r.choice(alphabet) for _ in range(150_000)), "你好" * 60_000, "b" * 120_000, "word and word, " * 9000, "x\n" * 60_000]
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for tokenizer in (t, Tokenizer(data)):
        got = list(zip(*tokenizer.digests(pa.array([*texts, *long, None])), strict=True))
        for x, own in zip([*texts, *long, ""], got, strict=True):
            ids = sp.encode(x)
            assert own == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    rows = [(1, "Some text, é"), (2, None), (2, None), (None, "x")]
    got = encode_digests(frame(spark, rows), data).collect()
    own = next(x for x in got if x.id == 1)
    ids = sp.encode("Some text, é")
    assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    full = {x.id: (x.ids, x.decoded) for x in encode(frame(spark, rows), data).collect()}
    assert full[1] == (ids, "Some text, é") and full[2] == ([], "")
    assert encode(frame(spark, []), data).count() == 0


def test_pages_of_any_shape_take_linear_time():
    import time

    from tessella.llm.html_text import main_text

    shapes = {
        "tags without end": "<a " * 350_000, "quotes without end": "<a b=\"'" * 150_000, "quotes and an end": "<a b=\"'" * 150_000 + ">", "nested": "<div>" * 200_000 + "x",
        "nested with text": "<div>x, y" * 60_000, "quotations": "<blockquote>x" * 60_000, "inline": "<b>" * 80_000 + "<p>x</p>" * 60_000, "inline ends": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        "ends without begin": "<section>" * 60_000 + "</div>" * 100_000, "titles": "<title>" * 140_000, "ends without end": "<title></title " * 70_000, "an end in quotes": "<a" * 400_000 + ' " > "', "rulers": "<b>" * 80_000 + "<hr>" * 80_000,
    }
    for name, page in shapes.items():
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 8, name  # a quadratic reader takes minutes


def test_forms_that_hold_the_page_and_others():
    from tessella.llm.html_text import main_text

    said = [f"Paragraph {k} says something of some length, with commas, so that it counts as an article's." for k in range(8)]
    article = "".join(f"<p>{x}</p>" for x in said)
    search = "<form action=/s><p>Search this site for things</p><input><button>Go</button></form>"
    whole = f"<body><form id=aspnetForm method=post><input type=hidden value=x><div class=nav><a href=/>Home</a></div><div class=content>{article}</div>{search}<select><option>a</select></form></body>"
    assert main_text(whole) == "\n".join(said)
    assert main_text(f"<body>{search}<div>{article}</div><form><p>Sign up, it is free, for our letter</p><label>mail</label></form></body>") == "\n".join(said)
    assert main_text(f"<form><article>{article}</article></form>") == "\n".join(said)
    assert main_text("<body><form><p>User name</p><input><p>Password, please</p></form></body>") == ""
    inside = main_text(f"<article>{article}<fieldset><legend>Facts</legend><p>A fact, boxed, in the article itself.</p></fieldset></article>")
    assert inside.endswith("Facts\nA fact, boxed, in the article itself.")
    assert "boxed" not in main_text(f"<div>{article}</div><fieldset><p>A choice, boxed, outside.</p></fieldset>")


def test_odd_tags():
    from tessella.llm.html_text import main_text

    long = "Some words of an article, enough of them, to be kept as the text of this page. " * 2
    want = " ".join(long.split())
    for page in (f"<p title='it's>{long}</p>", f'<p a="x > y">{long}</p>', f"<p b='\">'>{long}</p>", f"<p\n\tclass=x/>{long}", f"<!-- <p>no</p> --><p>{long}<!--", f"<!doctype html><p>{long}<?php no ?></p>", f"<p>{long}</p><a href=\"x", f"<p>{long}</P >"):
        assert main_text(page).startswith(want), page
    assert main_text(f"<p>{long}a < b and <3</p>") == f"{want} a < b and <3"
    assert main_text(f"<p>{long}<![CDATA[x<y]]></p>") == f"{want} x<y"
