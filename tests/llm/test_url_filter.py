import random
import re

from oracle import compare, connect

from earlog.llm import url_filter as u
from earlog.llm.queries import RULES, op5_url_filter, registered


def brute(url):
    s = "" if url is None or "://" not in url else url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", s)[0]
    path = re.match(r"[^?#]*", s[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    has = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)
    own = "block" if any(map(has, u.STRICT)) or sum(map(bool, map(has, u.SOFT))) > 1 else "allow"
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else own)


def test_query(spark, sf):
    sql = registered()["op5_url_filter"][1]
    assert compare(op5_url_filter(spark, sf), sql, connect(sf)) == ""


def test_odd(spark):
    rng = random.Random(1)
    parts = ["http", "://", "/", "?", "#", "Org", ".", "example.org", "com", "/fr/", "/de/x", "/en/1", "es", "free", "win", "casino", "-", "é", "x", "\n"]
    urls = [None, "", "://", "no scheme", "http://ORG/", "a://example.org/en/1", "b://x.example.org/es/?q", "c://notexample.org/es/",
            "free free", "free-win", "freewin", "x casino", "casinos", "éfree-ßwin"] + ["".join(rng.choices(parts, k=8)) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash", None) for i, x in enumerate(urls + urls)], "page_id long, url string, _host string, path int")
    got = u.url_filter(df, RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["_host"], r["_path"], r["_rule"], r["_verdict"]) == brute(r["url"]), r
    assert u.url_filter(df.limit(0), RULES).count() == 0
    assert {r["_verdict"] for r in u.url_filter(df).collect()} == {"allow", "block"}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://x.org/", "mine", "b")], "page_id long, url string, _which string, `a``b` string")
    r = u.url_filter(df, RULES).first()
    assert (r["_which"], r["a`b"], r["_verdict"]) == ("mine", "b", "allow")
