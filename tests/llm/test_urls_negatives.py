"""URL filters and hard negatives: odd rows against plain loops, the SQL over whole tables, and each way of the joins."""

import math
import random

import pytest
from oracle import duck_rows, spark_rows

from textloom.llm import negatives, queries, urls

QUERIES = ["op12_url_filters", "op13_hard_negatives"]


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, data, name):
    assert spark_rows(queries.QUERIES[name](spark, data)) == duck_rows(data, queries.ORACLE_SQL[name])


# -- operator 12

URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "https://a.NET", "https://a.net/", "https://a.net?q=/x", "https://x.example.net/en/1?a=b", "https://example.net/en", "https://xexample.net/en/1",
    "ftp://b.example.com/de/5#t", "http://b.example.com/en/5", "http://b.example.com/en/6", "http://www.example.org/fr/", "http://www.example.org/en/", "http://u@h.co.uk:80/a b?c", "http://10.0.0.1:8080/x", "http://İ.org/fr/é", "a://b://c/d",
]


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain_rule(host, path):
    fit = []
    for rule, action in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fit.append((len(rule), rule, action))
    return max(fit)[1:] if fit else (None, None)


def plain_domain(host):
    bare = host.rsplit("@", 1)[-1]
    if ":" in bare and bare.rsplit(":", 1)[1].isdigit():
        bare = bare.rsplit(":", 1)[0]
    labels = bare.split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return bare, bare
    t = 2 if ".".join(labels[-2:]) in urls.LONG_SUFFIXES else 1
    return ".".join(labels[-t - 1 :]), ".".join(labels[-t:])


def plain_strength(children):
    told = [(n, k) for n, k in children if n]
    total, bad = sum(n for n, _ in told), sum(k for _, k in told)
    if len(told) < 2 or bad in (0, total):
        return urls.PRIOR
    p, own = bad / total, len(told) - 1
    spread = sum(k * k / n for n, k in told) - bad * bad / total
    rest = total - sum(n * n for n, _ in told) / total - own
    if rest == 0:
        return urls.PRIOR
    rho = (spread / (p * (1 - p)) - own) / rest
    return urls.STRENGTH[1] if rho <= 0 else round(min(max(1 / rho - 1, urls.STRENGTH[0]), urls.STRENGTH[1]), 6)


def plain_verdicts(rows, outcomes=None):
    parsed = [plain_parse(u) for _, u in rows]
    ruled = [plain_rule(*x) for x in parsed]
    known = outcomes or [None if a is None else int(a == "block") for _, a in ruled]
    counts = {}
    for (host, _), o in zip(parsed, known, strict=True):
        c = counts.setdefault(host, [0, 0])
        c[0] += o is not None
        c[1] += o or 0
    up = lambda groups, name: {p: [sum(groups[c][i] for c in groups if name(c) == p) for i in (0, 1)] for p in {name(c) for c in groups}}
    domain_of, suffix_of = {h: plain_domain(h)[0] for h in counts}, {plain_domain(h)[0]: plain_domain(h)[1] for h in counts}
    domains = up(counts, domain_of.get)
    suffixes = up(domains, suffix_of.get)
    n, k = (sum(x[i] for x in suffixes.values()) for i in (0, 1))
    root, s0 = (k + 1) / (n + 2), plain_strength(suffixes.values())
    verdicts = {}
    for host, (n, k) in counts.items():
        d = domain_of[host]
        x = suffix_of[d]
        m = (root * s0 + suffixes[x][1]) / (s0 + suffixes[x][0])
        s = plain_strength([v for c, v in domains.items() if suffix_of[c] == x])
        m = (m * s + domains[d][1]) / (s + domains[d][0])
        s = plain_strength([v for c, v in counts.items() if domain_of[c] == d])
        a, b = m * s + k, (1 - m) * s + n - k
        verdicts[host] = "block" if a / (a + b) - urls.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > urls.LIMIT else "allow"
    return sorted(((i, h, p, r, act or verdicts[h]) for (i, _), (h, p), (r, act) in zip(rows, parsed, ruled, strict=True)), key=repr)


def many_urls():
    rng = random.Random(5)
    rows = [(k if k % 5 else None, u) for k, u in enumerate(URLS)] * 2
    for k in range(3000):
        host = "hot.example.com" if k % 3 == 0 else rng.choice(["www.", "", "m.", "a.b."]) + rng.choice(["example.com", "example.org", "shop.co.uk", "news.org", "x.net", "solo.com"])
        rows.append((1000 + k, f"http://{host}/{rng.choice(['de', 'en', 'fr', ''])}/{k}"))
    return rows


@pytest.mark.parametrize("limit", [urls.BROADCAST_HOSTS, 0])
def test_urls_against_loops(spark, limit):
    rows = many_urls()
    pages = spark.createDataFrame([(i, u, "h", "p", None) for i, u in rows], "page_id long, url string, host string, path string, verdict string").repartition(5)
    out = urls.judged(pages, broadcast_hosts=limit)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_verdicts(rows)


def test_urls_with_outcomes(spark):
    rng = random.Random(7)
    rows = [(k, f"http://h{k % 11}.{rng.choice(['good', 'bad', 'mixed'])}.{rng.choice(['com', 'info'])}/x") for k in range(2000)]
    outcomes = [None if rng.random() < 0.4 else int(rng.random() < {"good": 0.05, "bad": 0.9, "mixed": 0.5}[u.split(".")[1]]) for _, u in rows]
    pages = spark.createDataFrame([(i, u, o) for (i, u), o in zip(rows, outcomes, strict=True)], "page_id long, url string, outcome int")
    out = sorted((tuple(r) for r in urls.judged(pages, outcome="outcome").collect()), key=repr)
    assert out == plain_verdicts(rows, outcomes)
    by = {d: [v for _, h, _, _, v in out if f".{d}." in h] for d in ("good", "bad")}
    assert by["good"].count("allow") == len(by["good"]) and by["bad"].count("block") > 0.9 * len(by["bad"])


def test_urls_of_no_rows(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


# -- operator 13


def plain_negatives(rows, positives=5, negatives_=5):
    kept = []
    for r, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((r, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for ra, ia, la, qa in kept:
        if ia is None or ia % 100:
            continue
        told = sorted(((sum(x * y for x, y in zip(qa, q)), i, label == la) for r, i, label, q in kept if r != ra), key=lambda x: (-x[0], x[1] is None, x[1] or 0))  # noqa: B905
        for p, pid, _ in [x for x in told if x[2]][:positives]:
            hard = [x for x in told if not x[2] and 80 * p <= 100 * x[0] <= 100 * p][:negatives_]
            out += [(ia, pid, k + 1, x[1], p, x[0]) for k, x in enumerate(hard)]
    return sorted(out, key=repr)


def vectors(n=900, seed=3):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.random()]) for _ in range(6)], 4 if k % 3 == 0 else rng.randrange(10)) for k in range(n)]
    rows += [(None, [0.5] * 6, 4), (None, [0.5] * 6, 5), (5000, None, 1), (5100, [0.5] * 6, None), (5200, [0.5, None, 1.0], 2), (5300, [float("nan")] * 6, 2), (5400, [float("inf")] * 6, 2), (5500, [], 2), (5600, [1.0, 2.0], 3), (-100, [0.5] * 7, 3), (-7, [0.25] * 6, 3)]
    return rows + [rows[100]] * 3 + [rows[300], (300, [0.75] * 6, 4), (300, [0.75] * 6, 7)]


@pytest.mark.parametrize("blocks", [(8192, 4096), (100, 3)])
def test_negatives_against_loops(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, rid int, score int").repartition(5)
    x = negatives.taking_part(df)
    moved = x.selectExpr("id", "case when id % 7 = 0 then (label + 1) % 10 else label end as label", "vector")
    out = negatives.hard_negatives(moved, moved["id"] % 100 == 0, row_block=blocks[0], anchor_block=blocks[1])
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == plain_negatives(rows) and len(found) > 100
    if blocks[0] > 1000:
        assert sorted((tuple(r) for r in negatives.mined(df).collect()), key=repr) == found


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(k, [float(rng.randrange(2**27)) + rng.random() for _ in range(3)], k % 2) for k in range(201)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in negatives.mined(df).collect()]
    most = 2**63 - 1  # every product is beyond a long: all scores are equal, so ids decide
    assert [r[1:4] for r in sorted(got) if r[0] == 0 and r[1] == 1] == [(1, k, i) for k, i in zip(range(1, 6), sorted(k for k in range(201) if (k + (k % 7 == 0)) % 2 == 0), strict=False)]
    assert all(r[4:] == (most, most) for r in got)
    small = [(k, [x / 2**9 for x in v], label) for k, v, label in rows]  # products beyond 2^53, within a long
    df = spark.createDataFrame(small, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in negatives.mined(df).collect()), key=repr) == plain_negatives(small)


def test_negatives_of_no_rows(spark):
    assert negatives.mined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
