"""URL filters against a plain version over dicts of contexts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    shown = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, rest = shown.partition("/")
    return host.translate(LOW), slash + rest


def by_rules(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


class Plain:
    """Counts of symbols after each context of up to three."""

    def __init__(self, texts):
        self.seen = collections.defaultdict(collections.Counter)
        for t in texts:
            s = self.symbols(t)
            for i, x in enumerate(s[3:], 3):
                for k in range(4):
                    self.seen[tuple(s[i - k : i])][x] += 1

    @staticmethod
    def symbols(t):
        return [0, 0, 0, *[urls.ALPHABET.find(c) + 1 or urls.SYMBOLS - 1 for c in (t or "").translate(LOW)]]

    def logs(self, t):
        s, out = self.symbols(t), []
        for i, x in enumerate(s[3:], 3):
            p = 1 / urls.SYMBOLS
            for k in range(4):
                c = self.seen.get(tuple(s[i - k : i]), {})
                p = (c.get(x, 0) + urls.MASS * p) / (sum(c.values()) + urls.MASS)
            out.append(math.log(p))
        return out


def plain_version(rows, rules):
    held = lambda u: hashlib.sha256(u.encode()).hexdigest()[0] in urls.HELD_OUT
    ruled = [(u, r.verdict == "allow") for u in rows if (r := by_rules(*parts(u), rules))]
    good, bad = (Plain([u for u, g in ruled if g == want and not held(u)]) for want in (True, False))
    score = lambda u: sum(a - b for a, b in zip(good.logs(u), bad.logs(u), strict=True)) / max(1, len(u or ""))
    bins = collections.defaultdict(lambda: [0, 0])
    for u, g in ruled:
        if held(u):
            bins[math.floor(score(u) * urls.BINS)][not g] += 1
    ga, ba = sum(b[0] for b in bins.values()), sum(b[1] for b in bins.values())
    least = 0
    if ga and ba:
        keys = sorted(bins)
        share = lambda t: sum(b[0] for k, b in bins.items() if k >= t) * ba + sum(b[1] for k, b in bins.items() if k < t) * ga
        best = max(keys, key=lambda t: (share(t), -t))
        least = math.ceil((best + max([k for k in keys if k < best], default=best)) / 2)
    out = []
    for u in rows:
        r = by_rules(*parts(u), rules)
        out.append((u, *parts(u), r.name if r else None, r.verdict if r else "allow" if math.floor(score(u) * urls.BINS) >= least else "block"))
    return out


def made(seed, n):
    rng = random.Random(seed)
    hosts = ["a.example.net", "example.net", "WWW.example.com", "xexample.com", "b.example.org", "org", "net", "deep.x.net", "blog.info", "é.org"]
    out = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/', '/fr/', '/EN/', '/en', '?a=/en/', '#x'])}{rng.choice(['page', 'buy-now', '日本', 'A_B'])}{rng.randrange(100)}" for _ in range(n)]
    return [*out, None, "", "no scheme", "://", "x://", "http://net//", "http://NET/de/", "a://b://c.net/x", "ftp://example.com:80/de/x", *out[:3]]


def test_equals_plain(spark):
    for seed, n in ((1, 400), (2, 0)):
        rows = made(seed, n)
        df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(rows)], "page_id long, url string, host string").repartition(3)
        out = urls.filter_urls(df)
        got = sorted((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect())
        assert got == [(i, *r) for i, r in enumerate(plain_version(rows, urls.RULES))]
        assert sorted(out.columns) == sorted(["page_id", "url", *urls.MADE])


def test_grams_and_probabilities():
    texts = ["http://é.net/a?b=c", "", "abc", "ABC"]
    gram, owner = urls.grams(pa.array(texts))
    want = [sum(s[i - k] * urls.SYMBOLS**k for k in range(4)) for s in map(Plain.symbols, texts) for i in range(3, len(s))]
    assert gram.tolist() == want and owner.tolist() == [i for i, t in enumerate(texts) for _ in t]
    p = urls.probabilities(gram, np.ones(len(gram)))
    assert np.allclose(p.reshape(-1, urls.SYMBOLS).sum(1), 1)
    plain = Plain(texts)
    assert np.allclose(np.log(p[gram]), [x for t in texts for x in plain.logs(t)])


def test_threshold():
    assert urls.threshold([]) == urls.threshold([(5, 1, 0)]) == 0
    assert urls.threshold([(-300, 0, 4), (100, 3, 0), (200, 1, 0)]) == -100
    assert urls.threshold([(1, 5, 5), (2, 0, 5), (3, 5, 0)]) == 3
    assert urls.threshold([(7, 1, 1)]) == 7


def test_tells_kinds_of_urls_apart(spark):
    rng = random.Random(5)
    word = lambda cs: "".join(rng.choice(cs) for _ in range(6))
    fine, foul = (lambda h: f"https://{word('aeioubcd')}.{h}/guide/{word('aeiou')}"), (lambda h: f"http://{word('xzqk789')}.{h}/win-{word('0123')}-cash")
    rows = [(i, f("org" if f is fine else "net") if i % 2 else f("info")) for i in range(1200) for f in (fine, foul)]
    rules = (urls.Rule("allow", "org"), urls.Rule("block", "net"))
    out = [r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect() if r.rule is None]
    assert len(out) == 1200
    assert sum((r.verdict == "allow") == ("guide" in r.url) for r in out) > 0.99 * len(out)


@pytest.mark.parametrize("keep", [0, 12])
def test_rough(spark, keep):
    df = spark.createDataFrame([(None, "http://a.net/x", 1), (1, None, 2), (1, "http://a.net/x", 3), (2, "x" * 300_000, 4)], "page_id long, url string, score int").limit(keep)
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in urls.filter_urls(df).collect()) == ([(0, "net/", "block"), (1, "", "allow"), (1, "net/", "block"), (2, "", "block")] if keep else [])
