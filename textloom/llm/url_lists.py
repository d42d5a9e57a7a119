"""URL lists over time: dated entries, validity intervals, and an as-of join.

A list is a log of entries ``(list, pattern, at, action)``, where ``action`` is
``add`` or ``remove`` and ``pattern`` is a host (it covers its subdomains) or a
host with leading path segments (``host/a/b`` covers what lies below it). Each
entry holds from its time until the next entry for the same list and pattern, so
a capture meets, for each list and pattern, the one entry in force when it was
fetched. Intervals are cut at fixed time buckets, and captures join them by
(pattern, bucket): a host with a third of all captures is spread over time, and a
capture meets only the entries of its own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a time bucket of the join (32 days).
BUCKET = 32 * 86_400

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def url_segments(url: Column) -> Column:
    """Non-empty path segments, without query and fragment."""
    parts = F.split(F.regexp_extract(url, _PATH, 1), "/", -1)
    return F.filter(parts, lambda p: p != "")


def _seconds(at: Column) -> Column:
    return F.unix_timestamp(at.cast("timestamp"))


def intervals(entries: DataFrame, until: int) -> DataFrame:
    """(list, pattern, from, to, bucket) of the times a pattern is listed, up to ``until``.

    Entries are first reduced to one per list, pattern and time (``add`` wins a
    tie), so repeated entries never reach the window. Entries with a null column
    or a time after ``until`` take no part.
    """
    log = (
        entries.select(
            "list",
            F.lower("pattern").alias("pattern"),
            _seconds(F.col("at")).alias("from"),
            (F.col("action") == "add").alias("_add"),
        )
        .dropna()
        .filter(F.col("from") <= until)
        .groupBy("list", "pattern", "from")
        .agg(F.max("_add").alias("_add"))
    )
    following = F.lead("from").over(Window.partitionBy("list", "pattern").orderBy("from"))
    last = F.least(F.coalesce(F.col("to") - 1, F.lit(until)), F.lit(until))
    return (
        log.withColumn("to", following)
        .filter("_add")
        .withColumn(
            "bucket", F.explode(F.sequence(F.expr(f"`from` div {BUCKET}"), F.floor(last / BUCKET)))
        )
        .select("list", "pattern", "from", "to", "bucket")
    )


def _depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """Label counts of the hosts and segment counts of the paths that patterns have."""
    parts = F.split("pattern", "/", -1)
    found = (
        entries.filter(F.col("pattern").isNotNull())
        .select(F.size(F.split(parts[0], r"\.", -1)).alias("h"), (F.size(parts) - 1).alias("p"))
        .groupBy("h", "p")
        .count()
        .collect()
    )
    hosts = sorted({r["h"] for r in found if r["p"] == 0})
    return hosts, sorted({r["p"] for r in found if r["p"]})


def url_patterns(url: Column, host_depths: list[int], path_depths: list[int]) -> Column:
    """All patterns that cover a URL, of the depths that occur in the lists."""
    host, segments = url_host(url), url_segments(url)
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(
        F.filter(
            F.array(*map(F.lit, host_depths)).cast("array<int>"), lambda n: n <= F.size(labels)
        ),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    paths = F.transform(
        F.filter(
            F.array(*map(F.lit, path_depths)).cast("array<int>"), lambda n: n <= F.size(segments)
        ),
        lambda n: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(segments, 1, n), "/"))),
    )
    return F.when(host != "", F.concat(hosts, paths))


def url_verdicts(
    captures: DataFrame,
    entries: DataFrame,
    key: str = "page_id",
    url: str = "url",
    fetched: str = "fetched",
) -> DataFrame:
    """Whether each capture was listed when it was fetched, and by which lists.

    Returns one row per distinct (key, URL, fetch time), a repeated capture counting once:
    ``blocked``, ``n_matches``
    (patterns of lists in force) and ``lists`` (sorted, comma-joined, empty if
    none). A null URL, one without a host, and a null fetch time meet no entry.
    Empty lists block nothing; an empty table of captures gives no rows. Only the
    named columns are read, so others cannot clash.
    """
    base = captures.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_at")
    ).distinct().withColumn("_sec", _seconds(F.col("_at")))
    until = base.agg(F.max("_sec")).first()[0] or 0
    held = intervals(entries, until)
    wanted = base.withColumn(
        "pattern", F.explode_outer(F.array_distinct(url_patterns(F.col("_url"), *_depths(entries))))
    ).withColumn("bucket", F.floor(F.col("_sec") / BUCKET))
    in_force = (F.col("_sec") >= F.col("from")) & (
        F.col("to").isNull() | (F.col("_sec") < F.col("to"))
    )
    w, h = wanted.alias("w"), held.alias("h")
    met = w.join(
        h,
        (F.col("w.pattern") == F.col("h.pattern"))
        & (F.col("w.bucket") == F.col("h.bucket"))
        & in_force,
        "left",
    )
    return (
        met.groupBy("_key", "_url", "_at")
        .agg(F.count("h.list").alias("n_matches"), F.collect_set("h.list").alias("_lists"))
        .select(
            F.col("_key").alias(key),
            F.col("_url").alias(url),
            F.col("_at").alias(fetched),
            (F.col("n_matches") > 0).alias("blocked"),
            "n_matches",
            F.array_join(F.sort_array("_lists"), ",").alias("lists"),
        )
    )
