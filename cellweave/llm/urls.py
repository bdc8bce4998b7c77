"""URL filters by host-suffix and path-prefix expressions, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are broadcast; beyond it the join shuffles.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end.
    Both are empty for a null url and for one without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return lower_ascii(host), path


def _folder(path: Column) -> Column:
    """A rule's path up to its last slash, which stands among the prefixes of every path that it begins."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    """The first four bytes of a digest, the key of the join."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages.

    rules: (host, path, verdict). A rule fits its host and the host's subdomains when the url's path starts with
    the rule's path; of those that fit, the longest host + path wins, then the longer host, then block. Where
    none fits, rule is null and the verdict is default.

    Each distinct (host, path) gives the host's suffixes and the path's prefixes that end in a slash (the empty
    one too), as many as the rules' own depths need; they meet the rules on four bytes of their digest, and the
    full digest and the rest of the rule's path are confirmed afterwards. Null urls have empty host and path.
    Null or empty rule hosts never fit; a null rule path counts as empty. Repeated urls are judged once; repeated
    rows each return. Other columns are ignored."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path"))
    r = rules.select(
        lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host <> ''")
    r = r.withColumn("r_folder", _folder(F.col("r_path")))
    bounds = r.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.length("r_folder") - F.length(F.replace("r_folder", F.lit("/")))).alias("slashes"),
    ).first()
    if not bounds.n:
        return rows.select(
            F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    r = r.withColumn("r_digest", _digest(F.concat("r_host", F.lit("\n"), "r_folder"))).withColumn("r_short", _short(F.col("r_digest")))
    if bounds.n <= BROADCAST_RULES:
        r = F.broadcast(r)
    seen = rows.select("_host", "_path").where("_host <> ''").distinct()
    suffixes = F.array(*[F.substring_index("_host", ".", -k) for k in range(1, bounds.labels + 1)])
    # substring_index gives the text itself when it has fewer slashes; such a one is no prefix once it ends in a slash.
    folders = [F.concat(F.substring_index("_path", "/", k), F.lit("/")) for k in range(1, bounds.slashes + 1)]
    prefixes = F.filter(F.array_distinct(F.array(F.lit(""), *folders)), lambda x: F.startswith(F.col("_path"), x))
    spread = seen.select("_host", "_path", F.explode(F.array_distinct(suffixes)).alias("_s"), prefixes.alias("_prefixes")).select(
        "_host", "_path", F.explode("_prefixes").alias("_p"), "_s"
    )
    spread = spread.withColumn("_digest", _digest(F.concat("_s", F.lit("\n"), "_p"))).withColumn("_short", _short(F.col("_digest")))
    fits = spread.join(r, F.col("_short") == F.col("r_short")).where("_digest = r_digest and startswith(_path, r_path)")
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = fits.groupBy("_host", "_path").agg(F.max(rank).alias("_best")).select(F.col("_host").alias("b_host"), F.col("_path").alias("b_path"), "_best")
    return rows.join(best, (F.col("_host") == F.col("b_host")) & (F.col("_path") == F.col("b_path")), "left").select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP1_SQL = r"""
with p as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1, 's') as path from p),
r(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
  (select rh || rp from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc, length(rh) desc limit 1) as rule,
  coalesce((select rv from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc, length(rh) desc limit 1), 'allow') as verdict
from q
"""
