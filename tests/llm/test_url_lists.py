import datetime as dt
import random
import re

from pyspark.sql import functions as F

from textloom.llm import url_lists


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


URLS = [
    "http://a.example.com/x/y?q=1", "https://user@B.a.example.com:8080/X", "http://example.com", "ftp://example.org/x//y/",
    "no url", "", None, "http:///x", "http://a.example.com/x#f",
]
PATTERNS = ["example.com", "a.example.com", "a.example.com/x", "a.example.com/x/y", "example.org/x/y", "com", "B.A.example.com/x"]


def covers(pattern, url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    if not m or not m.group(1):
        return False
    host, path = m.group(1).lower(), [s for s in m.group(2).lower().split("/") if s]
    own, *segments = pattern.lower().split("/")
    if segments:
        return host == own and path[: len(segments)] == segments
    return host == own or host.endswith("." + own)


def test_against_replay(spark):
    rng = random.Random(4)
    entries = [
        (rng.choice("pq"), rng.choice(PATTERNS), day(rng.randrange(300)), rng.choice(["add", "remove"]))
        for _ in range(60)
    ]
    entries += entries[:5] + [(None, "com", day(0), "add"), ("p", None, day(0), "add"), ("p", "com", None, "add")]
    captures = [(i, rng.choice(URLS), day(rng.randrange(-5, 320))) for i in range(300)]
    captures += [captures[0], (900, URLS[0], None), (None, URLS[0], day(100))]
    # Repeated captures that certainly meet an entry.
    entries.append(("p", "certain.example", day(0), "add"))
    captures += [(901, "http://certain.example/x", day(50))] * 3
    got = url_lists.url_verdicts(
        spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("pattern", F.lit(1)),
        spark.createDataFrame(entries, "list string, pattern string, at date, action string"),
    ).collect()
    assert len(got) == len(set(captures))
    assert [(r.blocked, r.n_matches) for r in got if r.page_id == 901] == [(True, 1)]
    for r in got:
        state = {}
        for name, pattern, at, action in sorted(
            (e for e in entries if None not in e), key=lambda e: (e[2], e[3] == "add")
        ):
            if r.fetched is not None and at <= r.fetched:
                state[name, pattern.lower()] = action == "add"
        held = [k for k, on in state.items() if on and covers(k[1], r.url)]
        assert (r.blocked, r.n_matches) == (bool(held), len(held)), r
        assert r.lists == ",".join(sorted({k[0] for k in held}))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "list string, pattern string, at date, action string")
    pages = spark.createDataFrame([(1, URLS[0], day(3))], "page_id long, url string, fetched date")
    assert [r.blocked for r in url_lists.url_verdicts(pages, none).collect()] == [False]
    assert url_lists.url_verdicts(pages.limit(0), none).collect() == []
