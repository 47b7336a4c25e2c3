"""URL verdicts against a brute-force version: explicit rules, equivalence by links, allow before block."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import judge_urls, link_edges, resolved, url_key

PAGE = "page_id long, url string, html string, verdict string, node string"


def rule_for(host, path):
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain(rows, edges):
    """Verdicts by walking links from every page."""
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for page_id, url in rows:
        host, path = parts(url)
        rule, verdict = rule_for(host, path)
        seen, todo = set(), [re.sub(r"^.*?://|#.*", "", url)] if url and "://" in url else []
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += near.get(at, ())
        bad = any(rule_for(at.split("/")[0], "/" + at.split("/", 1)[1].split("?")[0])[1] == "block" for at in seen if at in near)
        out.append((page_id, host, path, rule, verdict or ("block" if bad else "allow"), verdict is None and bad))
    return sorted(out, key=str)


def test_verdicts_follow_links_and_rules(spark):
    rng = random.Random(5)
    hosts = ["a.net", "b.example.org", "c.com", "d.example.net", "example.org", "myexample.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de', 'x'])}/{rng.randrange(20)}" for _ in range(120)]
    rows, edges = [], set()
    for i, url in enumerate(urls + urls[:10]):
        html = "<p>none</p>"
        if rng.random() < 0.35:
            to = rng.choice(urls)
            html = rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical>", '<meta http-equiv="refresh" content="0; url={}">']).format(to)
            edges.add((url[7:], to[7:]))
        rows.append((i, url, html, "x", "y"))
    rows += [(None, None, None, None, None), (7, "no scheme", "", None, None), (7, "no scheme", "", None, None), (900, "HTTP://A.B.com?q#/", None, None, None), (901, "x://", "<link rel=canonical>", None, None)]
    got = judge_urls(spark.createDataFrame(rows, PAGE), URL_RULES).collect()
    want = plain([r[:2] for r in rows], {(a, b) for a, b in edges if a != b})
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r.alias for r in got) and any(r.verdict == "allow" and r.rule for r in got)


def test_link_targets(spark):
    cases = {"../x": "h.net/a/x", "/r?q=1#f": "h.net/r?q=1", "//Other.ORG:80": "other.org/", "?p=2": "h.net/a/b/c?p=2", "d/./e/..": "h.net/a/b/d/", "https://s.com/a/../../b": "s.com/b", "mailto:a@b": None, "#top": None, "": None}
    df = spark.createDataFrame([("http://h.net/a/b/c?z#f", t) for t in cases], "base string, target string")
    got = {r.target: r.key for r in df.select("target", url_key(resolved(F.col("base"), F.col("target"))).alias("key")).collect()}
    assert got == cases


def test_only_real_links_are_edges(spark):
    html = [
        '<!-- <link rel=canonical href="http://z.net/1"> --><script>"<link rel=canonical href=http://z.net/2>"</script>',
        '<link rel="stylesheet canonical-x" href="http://z.net/3"><link data-href="http://z.net/4" rel="canonical">',
        '<base href="http://b.net/q/"><link title="a > b" rel="alternate CANONICAL" href="w?a=1&amp;b=2">',
        None,
    ]
    pages = spark.createDataFrame([(i, f"http://p.net/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert [tuple(r) for r in link_edges(pages).collect()] == [("p.net/2", "b.net/q/w?a=1&b=2")]


def test_redirect_log_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://q.net/a", None), (2, "http://w.net/", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://q.net/a#x", "https://r.net/m"), ("http://r.net/m", "http://k.com/de/"), (None, "http://w.net")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, URL_RULES, log).collect()} == {1: "block", 2: "allow"}
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_main_path_has_no_python_workers(spark):
    plan = judge_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
