import random

import pytest
from plain import frame, vocabulary

from wakeline.llm import html_text, url_model
from wakeline.llm.queries import URL_RULES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies <div>a lot</div> of them</div>
<article><header><h1>A  title</h1></header><p>One &amp; two<br>three <b>bold<!-- <p>no</p> --></b></p>
<script>var x = "</p><p>bad";</script><aside>Side</aside><div class="ad">Buy <p>now</p></div>
<p>Caf&eacute;&nbsp;&#8364;5 <img alt="a>b"> end<section class="comments"><article class="comment">Great!</article></section>
<form><p>Mail</p></form></article><footer>(c)</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, None, None), (None, "odd", ""), (3, "http://a.org/2", "just text\n here"), (1, "http://a.org/1", PAGE)]
    df = frame(spark, rows, "page_id bigint, url string, html string")
    got = html_text.main_texts(df).collect()
    text = "A title\nOne & two three bold\nCafé €5 end"
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in got if r.page_id == 1) == [("1", "http://a.org/1", text, len(text))] * 2
    assert {r.page_id: r.text for r in got if r.page_id != 1} == {2: "", None: "", 3: "just text here"}
    assert html_text.main_texts(frame(spark, [], "page_id bigint, url string, html string")).count() == 0


def test_broken_markup():
    assert html_text.blocks("<nav><li>x<article><p>a<p>b") == [("a", True), ("b", True)]
    assert html_text.blocks("<div class=ad>x<div>y</div>z</div><p>c</div>d") == [("c", False), ("d", False)]
    assert html_text.blocks("<script>never closed <p>a</p>") == []
    assert html_text.blocks("a < b and <p>c > d</p>") == [("a < b and", False), ("c > d", False)]
    assert html_text.blocks("<ARTICLE><P CLASS='Lead'>x</P></ARTICLE>y") == [("x", True), ("y", False)]
    assert html_text.blocks("<p>cut off <a href=\"x") == [("cut off <a href=\"x", False)]


def test_host_boilerplate_goes(spark):
    rng = random.Random(1)
    vocab = vocabulary(3000, 1)
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    top, bottom = "Home News Sport Weather Shop About", "All rights reserved by the publisher of this site"
    rows, want = [], {}
    for i in range(40):
        own = [some(20), some(30)]
        host = "hot.org" if i % 4 else "small.net"
        rows.append((i, f"http://{host}/{i}", f"<div>{top}</div><div>{own[0]}</div><p>{own[1]}<div>{bottom}</div>"))
        want[i] = "\n".join(own)
    rows.append((99, "http://alone.com/", f"<div>{top}</div><p>{bottom}"))
    df = frame(spark, rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert {i: got[i] for i in want} == want
    assert got[99] == f"{top}\n{bottom}"


def test_notice_on_few_pages_of_a_hot_host_goes(spark):
    rng = random.Random(5)
    vocab = vocabulary(3000, 1)
    notice = "This page was moved here from the old site"
    rows, want = [], {}
    for i in range(60):
        own = " ".join(rng.choice(vocab) for _ in range(30))
        rows.append((i, f"http://hot.org/{i}", f"<div>{own}</div>" + (f"<p>{notice}</p>" if i % 20 == 0 else "")))
        want[i] = own
    df = frame(spark, rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_texts(df).collect()} == want


def test_article_text_stays(spark):
    rng = random.Random(6)
    vocab = vocabulary(3000, 1)
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    lines = lambda *blocks: "".join(f"<p>{b}</p>" for b in blocks)
    phrase, bar, told = "in the course of the last year", "Home News Sport Weather Shop About", some(40)
    copy, near, rows, want = some(50), [some(40) for _ in range(4)], [], {}

    def add(host, page, *text):
        rows.append((len(rows), f"http://{host}/{len(rows)}", page))
        want[len(rows) - 1] = "\n".join(text)

    for i in range(6):
        add("copies.org", lines(copy), copy)
        date = f"seen {i} times"
        add("near.org", lines(bar, *near, date), *near, date)
        sentence = f"{some(20)} {phrase} {some(20)}"
        add("phrases.org", lines(sentence), sentence)
        own = some(60)
        add("near.org", lines(bar, own), own)
    add("near.org", lines(bar), bar)
    for i in range(20):
        text = told if i < 18 else some(40)
        add("told.org", f"<article>{lines(text)}</article>", text)
    df = frame(spark, rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_texts(df).collect()} == want


STORY = "a long story that goes on for well more than a handful of words " * 6


@pytest.mark.parametrize(
    "page,text",
    [
        ('<main class="content with-sidebar"><p>{}</p></main>', "{}"),
        ('<article class="post share-enabled"><p>{}</p></article>', "{}"),
        ('<div class="wrapper has-sidebar"><p>{}</p><div class="sidebar">links</div></div>', "{}"),
        ('<article class="comments"><p>{}</p></article>', "{}"),
        ('<article><h2 id="notice">Notice</h2><p>{}</p></article>', "Notice\n{}"),
        ('<article><p>{}</p><div class="related-work">Earlier work</div></article>', "{}\nEarlier work"),
        ('<article>A teaser</article><div><p>{}</p></div>', "A teaser\n{}"),
        ('<div class="teaser"><article>One</article><article>{}</article></div><div class="ad">Buy</div>', "One\n{}"),
        ('<div class="notice"><p>{}</p></div>', "{}"),
        ('<div class="site-header">Menu</div><p>{}</p><div id="commentList">me too</div><p class="ad">Buy</p>', "{}"),
        ('<div class="cookie-notice"><article><p>{}</p></article></div>', "{}"),
        ("<p>{}</p>" * 3, "{}\n{}\n{}"),
    ],
)
def test_names_that_mislead(page, text):
    story = STORY.strip()
    assert "\n".join(html_text.page_blocks(page.replace("{}", STORY))[0]) == text.replace("{}", story)


def test_very_long_pages_and_deep_nesting(spark):
    long = "word " * 200_000
    rows = [(1, "http://a.org/", f"<article><p>{long}</p></article>"), (2, "http://a.org/", "<div>" * 5_000 + STORY), (3, None, "<" * 50_000)]
    got = {r.page_id: r.text for r in html_text.main_texts(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == long.strip() and got[2] == STORY.strip() and len(got) == 3


def test_whole_result_against_plain_counting(spark):
    """Blocks in, boilerplate out: recounted run by run over whole hosts."""
    rng = random.Random(12)
    vocab = vocabulary(2000, 4)
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bars = [some(n) for n in (3, 4, 7, 12)]
    rows = []
    for i in range(120):
        parts = [some(rng.randint(1, 25)) for _ in range(rng.randint(1, 4))] + [b for b in bars if rng.random() < 0.4]
        rng.shuffle(parts)
        kind = "article" if i % 5 == 0 else "section"
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<{kind}>" + "".join(f"<p>{p}</p>" for p in parts) + f"</{kind}>"))
    rows += rows[:9]
    got = {r.page_id: r.text for r in html_text.main_texts(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    pages = {}
    for i, url, page in rows:
        found, body = html_text.page_blocks(page)
        pages[i] = (url.split("/")[2], tuple(found), body)

    def spread(contents):
        holders: dict = {}
        for host, found in contents:
            sizes = [len(b.split()) for b in found]
            for a, b in html_text.runs(sizes):
                holders.setdefault((host, found[a : b + 1]), set()).add(found)
        return {run for run, held in holders.items() if len(held) >= html_text.SHARED}

    def covered(host, found, shared):
        sizes = [len(b.split()) for b in found]
        return {k for a, b in html_text.runs(sizes) if (host, found[a : b + 1]) in shared for k in range(a, b + 1)}

    contents = {(h, f) for h, f, body in pages.values() if not body}
    shared = spread(contents)
    size = lambda f, some: sum(len(f[k].split()) for k in some)
    voters = {(h, f) for h, f in contents if size(f, range(len(f))) - size(f, covered(h, f, shared)) >= html_text.OWN * size(f, range(len(f)))}
    shared &= spread(voters)
    for i, (host, found, body) in pages.items():
        gone = set() if body else covered(host, found, shared)
        left = [b for k, b in enumerate(found) if k not in gone] or list(found)
        assert got[i] == "\n".join(left)


def rule_of(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            best = r if best is None or len(r.name) > len(best.name) else best
    return host, path, best and best.name, best and best.verdict


def test_rules(spark):
    urls = [
        None, "", "nothing", "http://", "http://EXAMPLE.org/en/1?x#y", "a://b://c.org/p", "http://x.org", "http://org/", "http://forg/",
        "https://w.Example.ORG/es/a", "https://example.org/en/2", "http://a.com/fr/x", "http://a.com/de/?q", "http://a.com?/fr/", "http://É.org/\nx#", "x\ny://a.com/de/",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[4]), (4, urls[4])]
    got = url_model.judge(frame(spark, rows, "page_id bigint, url string"), URL_RULES).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(urls):
        host, path, name, verdict = rule_of(u)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, name)
        assert by_id[i].verdict in ((verdict,) if verdict else ("allow", "block"))
    assert url_model.judge(frame(spark, [], "page_id bigint, url string"), URL_RULES).count() == 0


def test_model_tells_held_out_urls(spark):
    rng = random.Random(3)
    good, bad = vocabulary(40, 1), ["casino", "pills", "win", "bonus", "cheap", "xxx"]
    rows, label = [], {}
    for i in range(900):
        spam = i % 3 == 0
        host = ("com", "org", "net")[i % 2 if i % 5 else 2]
        path = "/de/" if spam and host == "com" else "/es/" if spam else "/fr/" if host == "com" else "/"
        domain = "example.org" if spam and host == "org" else f"h{i % 7}.{host}"
        name = "-".join(rng.choice(bad if spam else good) for _ in range(4))
        rows.append((i, f"http://{domain}{path}{name}"))
        label[i] = "block" if spam else "allow"
    got = url_model.judge(frame(spark, rows, "page_id bigint, url string"), URL_RULES).where("rule is null").collect()
    right = sum(r.verdict == label[r.page_id] for r in got)
    assert len(got) > 100 and right / len(got) > 0.9
    kept = url_model.keep_allowed(frame(spark, rows, "page_id bigint, url string"), URL_RULES)
    assert kept.where("url like '%/de/%'").count() == 0


def test_probabilities_sum_to_one():
    import numpy as np
    import pyarrow as pa

    from wakeline.llm.words import chunks

    models = url_model.Models()
    rng = np.random.default_rng(1)
    models.total[:] = 0
    chunk = next(chunks(pa.array(["abab", "b"])))
    _, symbol, contexts = url_model._positions(chunk)
    assert symbol.tolist() == [97, 98, 97, 98, 256, 98, 256]
    assert len(contexts) == url_model.ORDERS and all(len(c) == 7 for c in contexts)
    assert models.scores(chunk).tolist() == [0.0, 0.0]
    del rng


def test_url_scores_are_exact(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(4)
    paths = ["/fr/", "/de/", "/x/"]
    urls = ["http://h.com" + rng.choice(paths) + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(30)) for _ in range(600)]
    urls += urls[:40]
    pad = lambda u: [257] * 4 + list(u.encode()) + [256]
    pairs = [Counter(), Counter()]
    for u in urls:
        verdict = rule_of(u)[3]
        if verdict and zlib.crc32(u.encode()) % url_model.FOLDS:
            s = pad(u)
            pairs[verdict == "allow"].update((tuple(s[i - k : i]), s[i]) for i in range(4, len(s)) for k in range(5))
    totals, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for m in (0, 1):
        for (context, _), n in pairs[m].items():
            totals[m][context] += n
            kinds[m][context] += 1

    def score(u):
        s, total = pad(u), 0.0
        for i in range(4, len(s)):
            for m in (0, 1):
                p = 1 / 257
                for k in range(5):
                    c = tuple(s[i - k : i])
                    if totals[m][c]:
                        p = (pairs[m][c, s[i]] + kinds[m][c] * p) / (totals[m][c] + kinds[m][c])
                total += math.log(p) * (1 if m else -1)
        return total / (len(s) - 4)

    rows = list(enumerate(urls))
    for hot in (1, 100, 1 << 20):
        got = url_model.judge(frame(spark, rows, "page_id bigint, url string"), URL_RULES, hot=hot).collect()
        assert len(got) == len(rows)
        assert max(abs(r.score - score(urls[r.page_id])) for r in got) < 1e-9
