import re

import pytest

from tidebook.llm import urls as U


def brute(url, rules, patterns):
    rest = (url or "").split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), f"{h}{p}", v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(re.search(p, host + path) for p, _ in patterns) else "allow"


URLS = [
    None, "", "nothing", "://", "https://example.org/es/1", "http://EXAMPLE.org/ES/1", "https://a.example.org/en/12?x=1", "https://example.org/en/2#f", "https://badexample.org/es/1", "https://x.com/fr/a", "https://x.com/de/", "https://x.com/de",
    "https://com/de/x", "https://org", "https://org/", "http://spam.net/a", "http://notspam.net/a", "http://cheap-pills.net/", "http://x.net/login.html", "http://x.net/loginx", "http://x.net?u=http://spam.net/", "ftp://x.org:80/a://b", "https://Ünï.org/ß", "http://x.net/wp-admin/",
]


def test_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "https://x.com/de/", None), (None, None, None)] + [(0, None, "h")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judged(df, U.rules(spark)).collect()), key=str)
    assert got == sorted(((i, *brute(u, U.SITE_RULES, U.PATTERN_RULES)) for i, u, _ in rows), key=str)
    assert U.judged(df.filter("false"), U.rules(spark)).count() == 0
    assert {r.verdict for r in U.judged(df, U.rules(spark, [], [])).collect()} == {"allow"}


@pytest.mark.parametrize("bound", [0, 20_000])
def test_pages(spark, small_dir, monkeypatch, bound):
    """Real tables: every rule against every URL gives the same, and the index fetches few rules a page."""
    monkeypatch.setattr(U, "BROADCAST_RULES", bound)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judged(pages, U.rules(spark)).collect()), key=str)
    assert got == sorted(((r.page_id, *brute(r.url, U.SITE_RULES, U.PATTERN_RULES)) for r in pages.collect()), key=str)
    parsed, rules = U.with_tokens(pages), U.rules(spark)
    assert rules.count() > 100 and rules.filter("size(literals) = 0").count() == 0
    assert U.fetched(parsed, U.index(rules, parsed)).filter("p is not null").count() < 3 * pages.count()


def test_long_urls(spark):
    urls = ["https://x.net/" + "a/" * 100_000, "https://" + "a." * 20_000 + "com/de/", "https://x.net/" + "login-" * 30_000, "https://x.net/" + "x" * 300_000 + "/wp-admin/"]
    rows = list(enumerate(urls))
    got = [(r.page_id, r.rule, r.verdict) for r in U.judged(spark.createDataFrame(rows, "page_id bigint, url string"), U.rules(spark)).orderBy("page_id").collect()]
    assert got == [(i, *brute(u, U.SITE_RULES, U.PATTERN_RULES)[2:]) for i, u in rows] == [(0, None, "allow"), (1, "com/de/", "block"), (2, None, "allow"), (3, None, "block")]
