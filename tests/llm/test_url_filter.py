"""URL verdicts against a plain reading of the rules."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cotflow.llm import url_filter
from cotflow.llm.url_filter import ADDRESS, RULE, SortedDigests
from pyspark.sql import functions as F

RULES = (*url_filter.RULES, ("a.b.c/x", "block"), ("b.c/xyz", "allow"), ("c", "allow"), ("bücher.de/é/", "block"))


def parts_of(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]


def judged(url, rules, listed):
    host, path = parts_of(url)
    fits = [
        (len(name), len(name.split("/", 1)[0]), name, verdict) for name, verdict in rules
        if ("." + host).endswith("." + re.match("[^/]*", name)[0])
        and host and path.startswith(re.match("[^/]*(.*)", name, re.S)[1])
    ]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if host and host + path in listed else "allow"


@pytest.fixture(scope="module")
def urls():
    draws = random.Random(5)
    hosts = ["x.example.net", "EXAMPLE.com", "example.com", "net", "www.org", "org", "a.b.c", "z.a.b.c", "b.c", "xb.c", "c", "bücher.de",
             "nota.net.uk", "example.net:80", "me@example.net", ".net", "..", "ÄÖ.org", ""]
    paths = ["", "/", "/en/1", "/en", "/de/x", "/fr/", "/fr", "/x", "/xy", "/xyz/1", "/é/b", "/é", "/a b", "/%2f"]
    tails = ["", "?q=1", "#top", "?u=http://other.net/", "#a?b"]
    found = [f"{draws.choice(['http', 'https', ''])}://{draws.choice(hosts)}{draws.choice(paths)}{draws.choice(tails)}" for _ in range(1500)]
    return [*found, None, "", "no scheme", "://", "a://b://c", "http:/x.net/", "//x.net/", "line\n://x.net/a\nb", "http://x.net/" + "y" * 200_000]


def test_urls_and_both_ways_to_search(spark, urls):
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(1, urls[1])] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "address", "part")})
    listed = url_filter.listing_addresses(pages.repartition(3))
    addresses = [h + p for h, p in map(parts_of, (u for _, u in rows)) if h]
    twice = {a for a in addresses if addresses.count(a) > 1}
    assert {r["address"] for r in listed.collect()} == twice
    want = sorted(map(str, ((i, *judged(u, RULES, twice)) for i, u in rows)))
    for limit in (url_filter.LIST_BYTES, 1000):
        got = url_filter.judge_urls(pages.repartition(3), listed, RULES, list_bytes=limit)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert {tuple(r)[3:] for r in url_filter.judge_urls(pages, None, ()).collect()} == {(None, "allow")}
    assert url_filter.judge_urls(pages.where("false"), listed.where("false")).collect() == []


def test_equal_digests_are_told_apart():
    few = lambda text, seed: (len(text) * 31 + seed) % 7
    stored = [f"{'k' * (i % 9)}{i}".encode() for i in range(200)]
    entries = [(RULE, t, i) for i, t in enumerate(stored)] + [(ADDRESS, t, 1000 + i) for i, t in enumerate(stored[::3])]
    array = SortedDigests(np.frombuffer(SortedDigests.pack(entries, few), np.uint8))
    assert (np.diff(array.digests.astype(np.int64)) >= 0).all()
    asked = [*stored, b"none", b"", b"kkkk"]
    places = array.find(RULE, asked, few)
    assert [int(array.meanings[p]) if p >= 0 else -1 for p in places] == [*range(200), -1, -1, -1]
    places = array.find(ADDRESS, asked, few)
    assert [int(array.meanings[p]) if p >= 0 else -1 for p in places] == [
        1000 + i // 3 if i < 200 and i % 3 == 0 else -1 for i in range(203)
    ]
    nothing = SortedDigests(np.frombuffer(SortedDigests.pack([]), np.uint8))
    assert nothing.find(RULE, asked).tolist() == [-1] * len(asked)


def test_the_file_is_mapped(tmp_path):
    path = tmp_path / "digests"
    path.write_bytes(SortedDigests.pack([(RULE, b"net/", 3), (ADDRESS, b"net/", 4)]))
    array = SortedDigests.mapped(str(path))
    assert isinstance(array.digests.base, np.memmap) or isinstance(array.digests, np.memmap)
    assert array.meanings[array.find(ADDRESS, [b"net/"])[0]] == 4


@pytest.mark.parametrize("rules", [(("a/", "block"), ("a/", "allow")), (("a/", "drop"),), (("/a", "block"),), (("", "block"),)])
def test_bad_rules_are_refused(rules):
    with pytest.raises(ValueError):
        url_filter.Rules(rules)
