from cellweave.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/x", "block"), ("b.org", "", "allow"), ("", "/", "block"), (None, "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.Net/x?y#z", "https://anet/", "http://www.example.net/en/1", "http://example.net/EN/1", "http://example.net/en",
    "http://example.com/de/", "http://x.example.com/de/a/b", "http://notexample.com/de/", "http://q.org/fr/1", "http://q.org/f", "http://b.org/xyz", "http://b.org/a/x", "http://a.b.org",
    "http://net:80/", "x://y://net/", "http://a..net//", "http://net.?q", "http://b.org/x\nz",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_same_as_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(4, URLS[4], "again"), (None, URLS[6], "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, urls.url_verdicts(pages, rules).collect()), key=repr)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=repr)
    assert urls.url_verdicts(pages.limit(0), rules).collect() == []
    none = urls.url_verdicts(pages, rules.limit(0), "block").collect()
    assert len(none) == len(rows) and all(r.rule is None and r.verdict == "block" for r in none)


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    one = sorted(map(tuple, urls.url_verdicts(pages, rules).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, urls.url_verdicts(pages, rules).collect())) == one
