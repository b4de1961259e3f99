import fnmatch
import random
import re

import pytest
from tracemill.llm.urlfilter import Automaton, GlobRule, HostRule, filter_urls, filter_urls_by_table

RULES = [HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def test_globs_match_like_fnmatch():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab./*?") for _ in range(rng.randrange(9))) for _ in range(90)]
    automaton = Automaton([], [GlobRule(p, "block") for p in words])
    assert automaton.words > 4
    hosts = ["".join(rng.choice("ab.") for _ in range(rng.randrange(6))) for _ in range(200)]
    paths = ["".join(rng.choice("ab./") for _ in range(rng.randrange(8))) for _ in hosts]
    fits = automaton.matches(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths)):
        for k, pattern in enumerate(words):
            assert fits[i, k] == bool(re.fullmatch(fnmatch.translate(pattern), h + p)), (h, p, pattern)


def test_pages(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.example.NET/en/x?y#z", "https://xexample.net/en/", "ftp://a.org/fr/",
            "http://Ä.org/fr/\n", "http://a.com/x.net/", "http://a.net?/en/", "x://y://b.net/", "http://spam.com", "http://e.com/" + "x" * 100_000 + "spam", "http://example.com/de/", "http://example.com/de"]
    urls += ["http://" + "".join(rng.choice(["example", "net", "org", "com", ".", "/", "en", "fr", "de", "?", "#", "/en/"]) for _ in range(7)) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate([*urls, urls[5]])] + [(None, "http://net/", None, None)], "page_id long, url string, host string, rule string")
    got = filter_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 2
    by_id = dict(enumerate([*urls, urls[5]])) | {None: "http://net/"}
    for r in got:
        host, path = parts(by_id[r.page_id])
        rule = rule_of(host, path)
        spam = "spam" in host + path
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else "block" if spam or "/login" in path or "/cart/" in path or "casino" in host + path else "allow")
    assert filter_urls(pages.limit(0), RULES).count() == 0


def _best(host, path, rules):
    """(rule, verdict, glob) by trying every rule."""
    fit = []
    for h, p, pattern, verdict, place in rules:
        place = 1 << 62 if place is None else place
        if verdict is None or (h is None and pattern is None):
            continue
        if pattern is not None:
            if re.fullmatch(".*".join("".join("." if c == "?" else re.escape(c) for c in x) for x in pattern.split("*")), host + path, re.S):
                fit.append((1, 0, place, pattern, verdict))
        else:
            h, p = h.lower(), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fit.append((0, -len(h + p), place, h + p, verdict))
    if not fit:
        return None, "allow", None
    kind, _, _, name, verdict = min(fit)
    return (name, verdict, None) if kind == 0 else (None, verdict, name)


@pytest.mark.parametrize(("block_chars", "sent_chars"), [(20_000, 4_000_000), (40, 4_000_000), (60, 400)])
def test_rules_of_a_table(spark, block_chars, sent_chars):
    """Against every rule tried on its own: many blocks, many passes, a route that a third of the rules share."""
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "www", "shop", "ex"])
    host = lambda: ".".join([label() for _ in range(rng.randrange(0, 3))] + [rng.choice(["ex.com", "ex.com", "a.net", "b.org", "net", "x.co.uk"])])
    path = lambda: "".join("/" + rng.choice(["en", "de", "e", "x.html", ""]) for _ in range(rng.randrange(0, 3)))
    rules = [(host(), rng.choice([path(), None]), None, rng.choice(["allow", "block"]), rng.choice([None, 1, 2, 3])) for _ in range(120)]
    rules += [(None, None, rng.choice(["*", "?", ""]) + label() + rng.choice(["*", "?*", "*/e*", ""]), rng.choice(["allow", "block"]), rng.randrange(4)) for _ in range(30)]
    rules += [("EX.com", "/de", None, "block", 1), (None, None, None, "block", 1), ("ex.com", "/", None, None, 1), *rules[:20]]
    urls = [f"http://{rng.choice([host(), label() + '.de'])}{path()}{rng.choice(['', '?q=/de', '#x'])}" for _ in range(400)] + [None, "", "nonsense", "http://", "http://net", "http://EX.COM/de/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, place int").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, pattern string, verdict string, place int")
    got = filter_urls_by_table(pages, table, block_chars=block_chars, sent_chars=sent_chars).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        assert (r.rule, r.verdict, r.glob) == _best(r.host, r.path, rules), (r, urls[r.page_id])
    assert len({r.rule for r in got}) > 20 and len({r.glob for r in got}) > 2


def test_rules_of_a_table_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    table = spark.createDataFrame([], "host string, path string, pattern string, verdict string, place int")
    assert [tuple(r) for r in filter_urls_by_table(pages, table).collect()] == [(1, "a.b", "/c", None, "allow", None)]
    assert filter_urls_by_table(pages.limit(0), table).count() == 0
