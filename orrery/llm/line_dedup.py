"""Site-relative line frequency: lines that a site repeats on many pages go.

Lines are counted by (host, hash) with map-side sums, so what is shuffled is
one row per distinct line of a partition, not the text. Of a host's lines at
most (lines per page / ratio) can exceed the ratio, so its boilerplate fits in
one small array per host; pages are joined with that array by host and
filtered in place, and texts are never exploded into a shuffle. Up to
``BROADCAST_BYTES`` of arrays are broadcast. Beyond that pages are shuffled by
host, hosts with more than a ``1 / SPREAD`` of all pages being dealt to several
salts (their arrays are copied to each), so no site is one task's work.

A line is compared without surrounding blanks; blank lines are kept and not
counted; a line that stands twice on a page counts once. A line is boilerplate
where (pages of the host with it) / (pages of the host) > ``ratio`` and it is
on ``min_pages`` pages at least (2, the least that is a repetition: otherwise
the only page of a host would lose all its lines).

Rows, defined results: null text stays null (and counts as a page); a null or
empty host is no site and its pages stay as they are; repeated rows are pages
of their own; texts of any length are filtered whole; empty tables give empty
results; all columns are returned under their names, whatever these are, and
only the text changes; ``dropped`` may not be one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.runtime import cut

#: Bytes of boilerplate (8 a line and 64 a host) up to which it is broadcast, and the share of all pages from which a host is dealt to salts.
BROADCAST_BYTES = 32 << 20
SPREAD = 1000

_DROP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|main|aside|table|tr|title|body|html|head)\b[^>]*>"
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _HOST, 1)


def html_lines(html: Column) -> Column:
    """Text of a page, a line per block element."""
    x = F.regexp_replace(html, _DROP, "")
    x = F.regexp_replace(x, _BLOCK, "\n")
    return F.regexp_replace(x, r"<[^>]*>", "")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """``site, bad ARRAY<BIGINT>, pages``: line hashes above the ratio of ``pages`` (``site, text``), for hosts that have any."""
    p = pages.select("site", F.split("text", "\n").alias("l")).where("site <> ''")
    total = p.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter("l", lambda x: F.trim(x) != ""), _key))
    lines = p.select("site", F.explode(keys).alias("h")).groupBy("site", "h").agg(F.count(F.lit(1)).alias("k"))
    hot = lines.where(F.col("k") >= min_pages).join(total, "site").where(F.col("k") / F.col("pages") > ratio)
    return hot.groupBy("site").agg(F.collect_list("h").alias("bad"), F.first("pages").alias("pages"))


def drop_boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = 0.05, min_pages: int = 2, dropped: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns with boilerplate lines taken out of ``text``; ``dropped`` names a column for their number."""
    if dropped in pages.columns:
        raise ValueError(f"{dropped} is already a column")
    bad = cut(boilerplate(pages.select(host.alias("site"), pages[text].alias("text")), ratio, min_pages))
    size = bad.agg((F.sum(8 * F.size("bad")) + 64 * F.count(F.lit(1))).alias("bytes"), F.sum("pages").alias("pages")).first()
    # names of our own, whatever the input's are
    src = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(pages.columns)], pages[text].alias("text"), host.alias("site"))
    if (size["bytes"] or 0) <= broadcast_bytes:
        j = src.join(F.broadcast(bad.select("site", "bad")), "site", "left")
    else:
        share = max(1, (size["pages"] or 0) // SPREAD)
        big = F.broadcast(bad.where(F.col("pages") > share).select("site", F.ceil(F.col("pages") / share).cast("int").alias("salts")))  # SPREAD rows at most
        dealt = src.join(big, "site", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        copies = bad.join(big, "site", "left").select("site", "bad", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        j = dealt.join(copies, ["site", "salt"], "left")
    lines = F.split("text", "\n")
    # few of a host's lines are on one page: these are found by hash, and the page's lines looked up among them
    out = j.withColumn("hit", F.array_intersect(F.transform(lines, _key), "bad"))
    out = out.withColumn("touched", F.coalesce(F.size("hit") > 0, F.lit(False)))
    out = out.withColumn("keep", F.when(F.col("touched"), F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("hit", _key(x)))))
    cols = [F.when(F.col("touched"), F.array_join("keep", "\n")).otherwise(F.col("text")).alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(pages.columns)]
    if dropped:
        cols.append(F.when(F.col("touched"), F.size(lines) - F.size("keep")).otherwise(0).cast("bigint").alias(dropped))
    return out.select(*cols)
