import datetime as dt
import random

import pytest

from patronlens.llm import urls

CAPTURES = "id long, url string, day date, key string, host string"
ENTRIES = "key string, day date, action string, category string, span string"
START = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else START + dt.timedelta(days=n)


def keys(url):
    if url is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].split(":")[0].lower().rstrip(".")
    if not host:
        return []
    labels = host.split(".")
    parents = [".".join(labels[i:]) for i in range(1, len(labels) - 1)]
    steps = [p for p in path.split("/") if p][:2]
    return [host, *parents, *[f"{host}/{'/'.join(steps[: i + 1])}" for i in range(len(steps))]]


def brute(capture, entries):
    _, url, at = capture
    best = []
    for key in keys(url):
        past = [e for e in entries if None not in e[:3] and e[0] == key and at is not None and e[1] <= at]
        if past:
            last = max(e[1] for e in past)
            same = [e for e in past if e[1] == last]
            if any(e[2] == "add" for e in same):
                best.append((-len(key), key, min(e[3] or "" for e in same if e[2] == "add"), last))
    return min(best)[1:] if best else (None, None, None)


def judged(spark, captures, entries, **options):
    left = spark.createDataFrame([(*c, "x", "y") for c in captures], CAPTURES)
    right = spark.createDataFrame([(*e, "z") for e in entries], ENTRIES)
    rows = urls.filter_urls(left, right, **options).collect()
    return sorted(((r["id"], r["day"], r["blocked"], r["entry"], r["category"], r["valid_from"]) for r in rows), key=str)


def expected(captures, entries):
    found = [(c, brute(c, entries)) for c in captures]
    return sorted(((c[0], c[2], b[0] is not None, *b) for c, b in found), key=str)


@pytest.mark.parametrize("span", [1, 7, 64])
def test_random_lists(spark, span):
    r = random.Random(span)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "A.EXAMPLE.com:80"]
    paths = ["", "/", "/en", "/en/one", "/en/one/two?q=1", "/de#x"]
    pool = ["a.example.com", "example.com", "b.a.example.com", "x.org/en", "a.example.com/en/one", "com", None]
    entries = [(r.choice(pool), day(r.choice([None, *range(40)])), r.choice(["add", "remove", "add", None]), r.choice(["p", "q", None])) for _ in range(60)]
    entries += entries[:5]
    captures = [(r.randint(0, 50), f"http://{r.choice(hosts)}{r.choice(paths)}", day(r.choice([None, *range(-2, 45)]))) for _ in range(300)]
    captures += [(7, None, day(3)), (None, "https://x.org/en/", day(20)), (8, "nonsense", day(9)), (9, "", day(1)), (10, "http:///x", day(1))]
    assert judged(spark, captures, entries, span_days=span) == expected(captures, entries)


def test_empty(spark):
    assert judged(spark, [], [("x.org", day(1), "add", "p")]) == []
    assert judged(spark, [(1, "http://x.org", day(2))], []) == [(1, day(2), False, None, None, None)]


@pytest.mark.parametrize("depth", [3, 4, 40])
def test_deep_entries(spark, depth):
    """Entries of any number of steps block what lies below them, and the longest one decides."""
    steps = [f"s{i}" for i in range(depth)]
    entries = [(f"x.org/{'/'.join(steps[:n])}", day(n), "add", str(n)) for n in range(1, depth + 1)]
    captures = [(n, f"https://x.org/{'//'.join(steps[:n])}/?q#f", day(99)) for n in range(depth + 1)]
    captures += [(100, f"http://X.org/{'/'.join(steps)}/below/it", day(99)), (101, f"http://x.org/{'/'.join(steps)}x", day(99))]
    found = {r[0]: r[3] for r in judged(spark, captures, entries)}
    assert found == {0: None, **{n: entries[n - 1][0] for n in range(1, depth + 1)}, 100: entries[-1][0], 101: entries[-2][0]}
    only = {r[0]: r[3] for r in judged(spark, captures, entries[-1:])}
    assert {n for n, key in only.items() if key} == {depth, 100}
