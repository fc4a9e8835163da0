import random

import pytest

from hookloom.llm import urls
from tests.llm.edges import no_pages, pages


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


ADDRESSES = [
    "http://example.org/es/1", "https://WWW.Example.ORG/en/123?x=1", "http://example.org/en/2", "http://org/", "http://org",
    "http://myorg/", "http://a.com/fr/x#y", "http://a.com/de", "http://a.com/de/", "http://com/fr/", "http://É.com/de/?",
    "ftp://x.example.org:80/es/", "no scheme", "://", "http://?q", "http://#f", "http:///fr/", "http://a.com?/fr/",
    "http://example.org./es/", "http://a://b.org/x", "http://org/\n/es/", "HTTP://NET/", "http://example.org/es/?://com/de/",
]


@pytest.mark.parametrize("rules", [urls.RULES, (
    ("block", "b.org", "/x"), ("allow", "b.org", "/x"), ("allow", "a.b.org", "/"), ("block", "org", "/x/y/z"),
)])
def test_verdicts_match_brute_force(spark, rules):
    random.seed(5)
    more = [
        "http://" + ".".join(random.choice(["a", "b", "org", "com", "example"]) for _ in range(random.randint(1, 4)))
        + "".join(random.choice(["/", "x", "y", "fr", "de", "es", "/en/1", "?", "#"]) for _ in range(random.randint(0, 5)))
        for _ in range(200)
    ]
    table = pages(spark, *((url, "") for url in ADDRESSES + more))
    got = [tuple(r) for r in urls.filter_urls(table, rules).collect()]
    want = [(r["page_id"], *brute(r["url"], rules)) for r in table.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rules_no_pages_bad_rules(spark):
    assert {r["verdict"] for r in urls.filter_urls(pages(spark), (), default="block").collect()} == {"block"}
    assert urls.filter_urls(no_pages(spark)).collect() == []
    with pytest.raises(ValueError):
        urls.filter_urls(no_pages(spark), [("deny", "org", "/")])
