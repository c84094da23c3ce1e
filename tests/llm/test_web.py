import gzip
import html
import random
import re
from pathlib import Path

import numpy as np

from tessella.llm import url_filter, warc
from tessella.llm.queries import RULES


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls_by_brute_force(spark):
    rng = random.Random(4)
    parts = ["http", "://", "HTTPS://", "com", "example", ".", ".", "net", "org", "/", "/en/", "/de/8", "/es/", "7", "8", "?", "#", "x", "É", "\n", "\0", "*", "@", ":80"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    urls += [None, "", "://", "http://a.b.example.com/en/7", "http://COM/en/x", "http://xcom/en/", "http://com" + "/en/" * 20_000, "http://example.net/de/81", "http://example.net/de/7", "http://example.org/es"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, RULES).collect()}
    assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df.limit(3), []).collect()} == {"allow"}


def test_automaton_of_many_globs():
    rng = random.Random(9)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randint(1, 7))) for _ in range(120)]  # several words of bits
    globs = [g for g in globs if g.strip("*")]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = url_filter.Automaton([g.encode() for g in globs]).matches(data, offsets)
    want = [[re.fullmatch(g.replace("*", ".*"), t, re.S) is not None for g in globs] for t in texts]
    assert (got == np.array(want)).all()


PAGES = [
    (1, "http://a.example.com/x", "<!DOCTYPE html><html lang='de'><head><title>A &amp; b\n c</title><style>p{}</style></head><body><nav><a href=\"/u?a=1&amp;b=2\">u</a></nav><p>One &lt;two&gt;<br>three</p><script>var t='<p>';</script><!-- gone --></body></html>"),
    (2, None, None),
    (3, "", ""),
    (4, "http://b/\r\nWARC-Type: forged", "no markup <3 at all"),
    (4, "http://b/\r\nWARC-Type: forged", "no markup <3 at all"),
    (5, "http://c/", "<p>" + "word " * 50_000),
]


def test_derivatives(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, record_id string").repartition(2)
    sources = {r["page_id"]: r for r in warc.responses(df).collect()}
    made = warc.derivatives(warc.responses(df))
    rows = made.collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        (headers, block), = warc.parse(r["record"])
        source = sources[r["page_id"]]
        assert headers["WARC-Type"] == r["kind"] and headers["WARC-Refers-To"] == r["refers_to"] == source["record_id"]
        assert headers["WARC-Date"] == source["date"] and headers["WARC-Target-URI"] == re.sub(r"[\r\n]+", " ", source["target_uri"])
        assert headers["WARC-Refers-To-Payload-Digest"] == warc.digest(bytes(source["payload"]))
        assert headers["WARC-Block-Digest"] == warc.digest(block) and len(block) == r["block_bytes"]
        if r["kind"] == "metadata":
            assert b"http-header-content-type: text/html; charset=utf-8\r\n" in block
    first = {r["kind"]: next(warc.parse(r["record"]))[1].decode() for r in rows if r["page_id"] == 1}
    assert first["conversion"] == "u\nOne <two>\nthree"
    assert "title: A & b c\r\n" in first["metadata"] and "outlink: /u?a=1&b=2 L a/@href\r\n" in first["metadata"] and "languages-html: de" in first["metadata"]
    assert {next(warc.parse(r["record"]))[1].decode() for r in rows if r["page_id"] == 4 and r["kind"] == "conversion"} == {"no markup <3 at all"}
    files = warc.write_warc(made, tmp_path.as_uri()).collect()
    found = [x for f in files for x in warc.parse(gzip.decompress(Path(f["file"]).read_bytes()))]
    assert len(found) == len(rows) == sum(f["records"] for f in files)
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_plain_text_has_no_markup():
    assert html.unescape("&nbsp;") == "\xa0" and warc.plain_text(warc.Scan("<div>a&nbsp;&nbsp;b</div><b>c</b>d").shown) == "a b\ncd"


def slow_text(page):
    """The same by characters, without positions or patterns: (lines, hrefs)."""
    blocks = "p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 nav header footer section article main aside blockquote pre hr body html form dl dt dd".split()
    out, links, rest = "", [], page
    while rest:
        if rest[0] != "<" or len(rest) < 2 or not (rest[1] in "/!?" or "a" <= rest[1].lower() <= "z"):
            out, rest = out + rest[0], rest[1:]
            continue
        if rest[:4] == "<!--" and "-->" in rest[4:]:
            rest = rest[4:].split("-->", 1)[1]
            continue
        if ">" not in rest:
            out += rest
            break
        inside, after = rest[1:].split(">", 1)
        closing = inside[:1] == "/"
        name = ""
        for c in inside[closing:]:
            if c in "/ \t\n\r\f\v" or (not name and not ("a" <= c.lower() <= "z")):
                break
            name += c.lower()
        if name in blocks:
            out += "\n"
        if not closing and name in ("script", "style", "head", "template", "noscript"):
            for i in range(len(after)):
                tail = after[i:]
                if tail.lower().startswith("</" + name) and tail[2 + len(name) :].lstrip(" \t\n\r\f\v").startswith(">"):
                    after = tail.split(">", 1)[1]
                    break
        if not closing and name == "a":
            low = inside.lower()
            for i in range(1 + closing, len(inside)):
                value = low[i + 4 :].lstrip()
                if low[i : i + 4] == "href" and not (low[i - 1].isalnum() or low[i - 1] == "_") and value.startswith("="):
                    value = inside[len(inside) - len(value) + 1 :].lstrip()
                    if value[:1] in ('"', "'") and value:
                        links.append(value[1:].split(value[0], 1)[0])
                        break
                    word = ""
                    for c in value:
                        if c.isspace() or c in "\"'":
                            break
                        word += c
                    if word:
                        links.append(word)
                        break
        rest = after
    lines = (" ".join(x for x in re.split(r"[ \t\r\f\v\xa0]+", line)).strip() for line in html.unescape(out).split("\n"))
    return [x for x in lines if x], links


def test_scanner_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["<", ">", "<p>", "</p >", "<P class='x'>", "<a href=", "<a data-x=1 HREF = '", '<a href="/u?a&amp;b">', "<a>", "href=x", "<!--", "-->", "<!doctype html>", "<script>", "</script >", "</SCRIPT>", "<head>", "</head>", "<header>", "<br/>", "<style", "&lt;", " ", "\n", "text", '"', "'", "/", "<b>", "é<2", "<h1>", "<template>", "</template\n>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for page in pages:
        seen = warc.Scan(page)
        assert (warc.plain_text(seen.shown).split("\n") if warc.plain_text(seen.shown) else [], seen.links) == slow_text(page), page
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages[:200])], "page_id bigint, url string, html string")
    made = {(r["page_id"], r["kind"]): next(warc.parse(r["record"]))[1].decode() for r in warc.derivatives(warc.responses(df)).collect()}
    for i, page in enumerate(pages[:200]):
        lines, links = slow_text(page)
        assert made[i, "conversion"] == "\n".join(lines)
        assert [x for x in made[i, "metadata"].split("\r\n") if x.startswith("outlink: ")] == ["outlink: " + warc.one_line(f"{html.unescape(x)} L a/@href") for x in links]


def test_hostile_pages_take_one_pass():
    import time

    for piece in ("<script>", "<a href", "<!--", "<a href=x>", "<title>", "<html lang", "</script", "<head", "&amp", "<style></style "):
        page = (piece * (1 + 10_000_000 // len(piece))).encode()
        began = time.perf_counter()
        warc.derive(None, "s", "u", "d", "HTTP/1.1 200 OK", page)
        assert time.perf_counter() - began < 30, piece
    # twice the page takes about twice the time, not four times
    for piece in ("<script>", "<a href", "<!--"):
        times = []
        for n in (2_000_000, 8_000_000):
            began = time.perf_counter()
            warc.Scan(piece * (n // len(piece)))
            times.append(time.perf_counter() - began)
        assert times[1] < 12 * max(times[0], 0.01)


def test_derivatives_of_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "http://a/", "<p>x", "k"), (None, "http://a/", "<p>x", "k")], "page_id bigint, url string, html string, kind string")
    rows = warc.derivatives(warc.responses(df)).collect()
    assert len(rows) == 4 and {r["page_id"] for r in rows} == {None} and {r["kind"] for r in rows} == {"metadata", "conversion"}
    assert len({bytes(r["record"]) for r in rows}) == 2
