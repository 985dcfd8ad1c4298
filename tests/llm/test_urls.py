from __future__ import annotations

from stepwell.llm import urls
from stepwell.llm.queries import BLOCKED_HOSTS, URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/12?q#f",
    "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/", "http://notorg/x",
    "http://org", "http://org/", "ftp://q?a://b.com/fr/", "http://www.adult-x.example.com/en/", "a://b://c.com/fr/",
    "http://xadult-x.example.com/", "http://\u00c9.com/de/\u00e9", "http://free-bets.example.net#/x", "http://a.com/fr/" * 400,
    "http://" + "a." * 200_000 + "com/de/x", "http://" + "." * 1000 + "org/", "http://org./", "http://.org/a",
]


def plain(url):
    cut = (url or "").find("://")
    rest = url[cut + 3 :] if cut >= 0 and url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at : min([i for i in (rest.find(c, at) for c in "?#") if i >= 0], default=len(rest))]

    def under(parent):
        return host == parent or host.endswith("." + parent)

    fits = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if under(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if any(under(h) for h in BLOCKED_HOSTS) else "allow"


def test_both_ways_equal_a_plain_loop(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    expected = [(i, *plain(u)) for i, u in enumerate(URLS * 2)]
    assert sorted(map(tuple, urls.judge(pages, URL_RULES, BLOCKED_HOSTS).collect())) == expected
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    assert sorted(map(tuple, urls.judge_by_join(pages, rules, hosts).collect())) == expected
    assert urls.judge(pages.limit(0), URL_RULES, []).count() == 0
    assert {r.verdict for r in urls.judge(pages, [], []).collect()} == {"allow"}


def test_a_collision_never_decides(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "_key", lambda host, path: 5)
    file = tmp_path / "digests"
    file.write_bytes(urls.DigestArray.to_bytes([("a", "/", "block"), ("b", "/", "allow"), ("a", "/x", "allow")]))
    array = urls.DigestArray(str(file))
    assert array.find([("b", "/"), ("a", "/x"), ("c", "/"), ("a", "/")]) == ["allow", "allow", None, "block"]
