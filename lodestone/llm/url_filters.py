"""URL filters: host-suffix and path-prefix expressions, met by short digest prefixes and confirmed by full digests.

Every distinct (host, path) expands into the suffixes of its host at label bounds times the prefixes of its path at the
lengths that some rule has. Expressions meet the rules on the first bytes of their SHA-256, the full digests confirm,
and the longest rule wins. Only built-in functions run.

Empty cases: a null url, or one without ``://``, has an empty host and path and no rule, and gets the default verdict.
Repeated pages keep their rows, and extra columns of any name are left out. Rules that repeat count once; of equal (host,
path) with both verdicts, block wins. Of rules of one length, the one with the longer host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the first join uses (4 bytes, as in published safe-browsing lists).
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each page.

    ``rules``: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with its own.
    The longest host + path wins, then the longer host.
    """
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length("path").alias("path_length"),
        F.length("host").alias("host_length"),
    )
    # the distinct lengths of rule paths: at most as many as a url has characters
    lengths = sorted(r[0] for r in known.select("path_length").distinct().collect())
    own = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return own.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = own.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = keys.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    expressions = expressions.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("full"))
    met = expressions.withColumn("short", F.substring("full", 1, PREFIX_HEX)).join(known.withColumn("short", F.substring("digest", 1, PREFIX_HEX)), "short")
    met = met.where(F.col("full") == F.col("digest"))
    order = F.struct(F.length("rule"), "host_length", "rule", "verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    out = own.join(best, (own["host"] == best["h"]) & (own["path"] == best["p"]), "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
