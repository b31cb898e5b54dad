import base64
import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyspark.sql import Row

from finstrata.llm import html_extract, url_filter, warc
from finstrata.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def _judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(r.text), r.action == "block", r.text, r.action) for r in rules
            if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (host or path) and (r.path or path == "" or path[0] == "/")]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


URLS = [None, "", "no scheme", "http://", "://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://www.example.com/en", "ftp://a.example.com/EN/1", "http://notexample.com/en/x",
        "http://x.net/es/?q=://y", "http://x.net/fr/#a", "http://net/fr/", "http://x.net?es/", "http://x.net#/es/", "http://x.org/", "http://Éa.com/é", "http://a.b/c\nd", "http://a.com:80/x", "http://" + "a" * 5000 + ".com/" + "b/" * 5000]


def test_urls_against_brute_force(spark):
    rules = [*URL_RULES, url_filter.Rule("block", "", "/c"), url_filter.Rule("block", "b"), url_filter.Rule("allow", "b"), url_filter.Rule("block", "x.net", "/e"), url_filter.Rule("allow", "com:80", "/")]
    for use in (URL_RULES, rules, []):
        df = spark.createDataFrame([(i // 2, u, "x") for i, u in enumerate(URLS * 2)] + [(None, None, "x")], "page_id long, url string, rule string")
        got = url_filter.filter_urls(df, use).collect()
        want = [(i // 2, u, *_judge(u, use)) for i, u in enumerate(URLS * 2)] + [(None, None, *_judge(None, use))]
        assert sorted(map(str, [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, want))


def test_url_rules_are_indexed_by_the_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/en/{i}") for i in range(20)] + [(99, "http://rare.example.com/en/1")], "page_id long, url string")
    plan = url_filter.filter_urls(df, [url_filter.Rule("block", "rare.example.com", "/en/")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert url_filter.Rule("a", "x.com", "/en/ab").tokens == ["x", "com", "en"]
    assert url_filter.Rule("a", "", "/e").tokens == [""]
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href="/">Home</a></li><li><a>About us and all of our long menu entries</a></li></ul></nav>
<!-- comment <p>no</p> --><div class="ad banner">Buy a long advert text now, it is very long indeed and longer than many.</div>
<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;para  graph.<br>next<p>Sh is.</p><div class="advert"><p>inner ad</div><ul><li>one<li>two</ul><form>no <input></form>&copy; x &lt;p&gt; &notareal; &#65;
<aside>side</aside><p>Last.</article><section id="comments"><p>Reader comment that is quite long and would be kept otherwise, surely.</p></section><footer>&copy; foot</footer></body></html>"""


def test_html_main_text():
    assert html_extract.main_text(PAGE) == "Head & line First bold para graph. next Sh is. one two © x <p> ¬areal; A Last."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p><!-- x") == ""
    assert html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<div>" + "word " * 30 + "</div><ul>" + "<li><a>m</a></li>" * 9 + "</ul>") == ("word " * 30).strip()
    assert html_extract.main_text('<article><p title="a>b">x &am') == "x &am"
    long = "<article>" + "<p>w&amp;w</p>" * 50_000 + "</article>"
    assert html_extract.main_text(long) == " ".join(["w&w"] * 50_000)


def test_html_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "x", "<article>\U0001f600é</article>")]
    out = html_extract.extract(spark.createDataFrame([(*r, 7) for r in rows], PAGES + ", n_chars int")).collect()
    assert sorted((r.text, r.n_chars) for r in out) == sorted((html_extract.main_text(h), len(html_extract.main_text(h))) for _, _, h in rows)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def _bytes(spark, rows, **options):
    m = warc.write_archives(spark.createDataFrame(rows, PAGES), warc.fresh_path(spark, "t"), b"dictionary" * 9, **options)
    return m, warc.read_archives(m).collect()


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choices("abcdé\n\U0001f600", k=400_000))
    rows = [(3, "http://a/\r\nX: y", "same"), (1, "http://b", "same"), (2, None, "same"), (2, "http://c", "other"), (2, "http://c", "other"), (None, None, None), (7, "u", ""), (None, "z", "same"), (8, "u", big)]
    _, out = _bytes(spark, rows, min_bytes=0)
    same = {r.page_id: r for r in out if r.payload_bytes == 4}
    assert same[1].record_type == "response" and same[1].refers_to is None and same[1].payload == b"same"
    assert all(same[k].record_type == "revisit" and same[k].refers_to == 1 and same[k].payload is None for k in (2, 3, None))
    assert sorted(r.record_type for r in out if r.payload_bytes == 5) == ["response", "revisit"]
    assert {(r.page_id, r.record_type, r.refers_to) for r in out if r.payload_bytes == 0} == {(7, "response", None), (None, "revisit", 7)}
    assert [bytes(r.payload).decode() for r in out if r.page_id == 8] == [big]
    assert same[1].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert sorted(r.url or "" for r in out) == sorted((u or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20") for _, u, _ in rows)
    _, out = _bytes(spark, rows, min_bytes=5)
    assert all(r.record_type == "response" for r in out if r.payload_bytes < 5)
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_warc_archives_roll_and_damage_is_found(spark):
    m, out = _bytes(spark, [(i, "u", f"page {i} " * 50) for i in range(60)], archive_bytes=4000)
    paths = [r.path for r in m.collect()]
    assert len(out) == 60 and len(paths) > 8 and sum(r.records for r in m.collect()) == 60
    data = open(paths[0].removeprefix("file:"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8: 8 + size] == b"dictionary" * 9
    whole = list(warc.frames(io.BytesIO(data)))
    for bad in (data[4:], data[:20], data[:-3], data[:120] + b"xx" + data[122:]):
        with pytest.raises(ValueError):
            for w in warc.frames(io.BytesIO(bad)):
                warc.parse(w)
    for bad in (whole[0][:-1], whole[0].replace(b"page", b"pago"), b"x" + whole[0]):
        with pytest.raises(ValueError):
            warc.parse(bad)
    packed = zstandard.ZstdCompressor().compress(b"raw dictionary content")
    assert list(warc.frames(io.BytesIO(struct.pack("<II", magic, len(packed)) + packed))) == []
    assert isinstance(out[0], Row)


def test_wrappers_named_after_noise_keep_their_article():
    from finstrata.llm.html_extract import main_text
    body = "A long opening paragraph of the article, long enough for any block of lines to surge past its bar."
    aside = '<div class="{}"><p>Side text of some length that is no part of the article.</p></div>'
    for names in ("has-sidebar", "no-sidebar", "right-sidebar", "with-ads", "layout menu-left", "sidebar"):
        for tag in ("article", "main"):
            page = f'<div class="{names}">{aside.format("sidebar")}<{tag}><p>{body}</p><div class="related">More</div></{tag}></div><div class="site-footer">Foot</div>'
            assert main_text(page) == body, (names, tag)
        if names != "sidebar":
            assert main_text(f'<div class="{names}">{aside.format("left-sidebar")}<p>{body}</p><p>{body}</p></div><div class="site-footer">Foot</div>') == f"{body} {body}", names
    # an article of a noise element isn't the page's where another is
    assert main_text(f'<div class="related"><article>Teaser</article></div><article><p>{body}</p></article>') == body
    # short text after a dive
    noise = '<div class="ad">Buy this</div>' * 4
    assert main_text(f"<p>{body}</p>{noise}<p>The end.</p>") == f"{body} The end."
    assert main_text(aside.format("left-sidebar") + f"<p>{body}</p>") == body


NAMED = ["sidebar", "left-sidebar", "ad-slot-top", "cookie-bar", "newsletter-signup", "related-posts", "commentlist", "site-footer", "comments", "share"]
WRAPS = ["", 'class="content-with-sidebar"', 'class="sidebar-layout"', 'class="red-alert-story"', 'class="has-sidebar"', 'id="ad-free"', 'class="main-menu-left"']


def _page(rng):
    """A page put together from known parts, and the text of its article."""
    words = lambda a, b: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(a, b)))
    noise = lambda: rng.choice([
        lambda: f'<div class="{rng.choice(NAMED)}"><p>{words(3, 30)}</p></div>', lambda: f"<nav><ul>{''.join(f'<li><a href=x>{words(1, 4)}</a></li>' for _ in range(6))}</ul></nav>",
        lambda: f"<footer>{words(2, 30)}</footer>", lambda: f"<aside><p>{words(5, 30)}</p></aside>", lambda: f"<form>{words(1, 9)}<input></form>", lambda: f"<script>{words(9, 20)}</script>"])()
    kept, body = [], []
    for tag, a, b in [("h1", 2, 8), ("p", 25, 60), *[(rng.choice(["p", "p", "h2", "li", "p", "section"]), 3, 60) for _ in range(rng.randrange(1, 8))], ("p", 25, 60), ("p", 1, 6)]:
        t = words(a, b)
        kept.append(t)
        body.append(f'<section class="related-work"><p>{t} {t * 3}</p></section>' if tag == "section" else f"<{tag}>{t}</{tag}>")
        if tag == "section":
            kept[-1] = f"{t} {t * 3}"
        if rng.random() < 0.2:
            body.append(f'<div class="{rng.choice(NAMED)}"><p>{words(1, 8)}</p></div>')
    tag = rng.choice(["article", "main", "div", "div"])
    page = f"<{tag} {rng.choice(WRAPS) if tag == 'div' else ''}>{''.join(body)}</{tag}>"
    wrap = rng.choice(WRAPS)
    if wrap:
        page = f"<div {wrap}>{noise()}{page}</div>"
    if rng.random() < 0.3:
        page = f'<form id="aspnetForm">{page}</form>'
    edges = lambda: "".join(noise() for _ in range(rng.randrange(3)))
    return f"<html><body>{edges()}{page}{edges()}<div>&copy; {words(2, 5)}</div></body></html>", " ".join(kept)


def test_pages_of_known_parts():
    """Built from parts, so that the text to find is known without any of the extractor's rules."""
    rng = random.Random(11)
    wrong = [(p, t) for p, t in (_page(rng) for _ in range(400)) if html_extract.main_text(p) != t]
    assert len(wrong) <= 8, (len(wrong), wrong[0], html_extract.main_text(wrong[0][0]))


def test_layouts():
    main_text = html_extract.main_text
    body = "A long opening paragraph of the article, long enough for any block of lines to surge past its bar."
    two = f"<h1>Title</h1><p>Short.</p><p>{body}</p><p>{body}</p>"
    want = f"Title Short. {body} {body}"
    for page in (f'<main><div class="content-with-sidebar">{two}</div></main>', f'<article><div class="sidebar-layout">{two}</div></article>', f'<article><div class="red-alert-story">{two}</div></article>',
                 f'<form id="aspnetForm"><div>{two}</div></form>', f'<form id="aspnetForm"><article>{two}</article></form>', f'<article>Teaser</article><div>{two}</div>'):
        assert main_text(page) == want, page
    assert main_text(f'<article>{two}<section class="related-work"><p>{body}</p></section></article>') == f"{want} {body}"
    # dives: what is beside the container of the text isn't taken up again, unless text surges again
    assert main_text(f"<div>Site</div><div>{two}<p>End.</p></div><div>&copy; 2020 Some house</div>") == f"{want} End."
    assert main_text(f'<div>{two}</div><div class="ad">Buy</div><ul><li><a>x</a></li></ul><div>{two}</div>') == f"{want} {want}"
    assert main_text(f"<div>{two}</div><ol class=commentlist><li>{body}</li></ol>") == want
    # a short article stays the article, whatever an advert's length
    assert main_text(f'<div class="ad">{body}</div><article><p>Short.</p></article>') == "Short."


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old", 9)] * 2, "page_id long, html string, text string, n_chars int")
    assert [(r.text, r.n_chars, r.page_id) for r in html_extract.extract(df).collect()] == [("a", 1, 1)] * 2
