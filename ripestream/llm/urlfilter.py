"""URL rules by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into ``host suffix + path prefix`` strings, for the suffix
depths and prefix lengths that occur among the rules.  The first 8 hex digits
of an expression's SHA-256 are joined with those of the rules; a hit counts
only if the full digests agree.  The longest rule wins, then the longer host,
then block over allow.

The join is a plain equi-join: Spark broadcasts the rules while they are under
its own size threshold and shuffles otherwise.  For the shuffle, every prefix
is salted, as one expression such as ``com/`` may hold most URLs.

Cases: null URL or no ``://`` reads as empty host and path, which no rule fits
(rules with an empty host are ignored).  Repeated rows and repeated or null ids
are judged row by row.  Rules that repeat act once; of two equal rules with
different actions block wins.  Other columns of the input are ignored, whatever
their names.  An empty rule table gives every URL the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.llm.common import lower_ascii

SALTS = 16
#: Precedence packs rule length, host length and action into one long; lengths below 2**24.
_LEN, _HOST = 1 << 32, 1 << 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame, rule: str = "rule", action: str = "action") -> DataFrame:
    """Rules split into host and path, with their digest and precedence; one row per digest."""
    text = F.col(rule)
    parts = rules.select(text.alias("rule"), F.col(action).alias("action")).where(text.isNotNull())
    host = lower_ascii(F.regexp_extract("rule", r"(?s)^([^/?#]*)", 1))
    parts = parts.select(host.alias("r_host"), F.expr("substring(rule, length(regexp_extract(rule, '(?s)^([^/?#]*)', 1)) + 1)").alias("r_path"),
                         (F.col("action") == "block").cast("long").alias("blocks")).where("r_host <> ''")
    return parts.groupBy("r_host", "r_path").agg(F.max("blocks").alias("blocks")).select(
        F.size(F.split("r_host", r"\.")).alias("depth"), F.length("r_path").alias("reach"),
        F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256).alias("r_digest"),
        (F.length(F.concat("r_host", "r_path")).cast("long") * _LEN + F.length("r_host") * _HOST + F.coalesce("blocks", F.lit(0))).alias("precedence"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rule_col: str = "rule", action_col: str = "action", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict, rule_host, digest of the rule.

    ``default`` is the verdict of a URL that no rule fits.
    """
    table = rule_table(rules, rule_col, action_col)
    # Which suffix depths and prefix lengths occur: at most as many as a URL has characters, whatever the number of rules.
    shapes = sorted((r[0], r[1]) for r in table.select("depth", "reach").distinct().collect())
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        F.monotonically_increasing_id().alias("row"), "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shapes:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
                           F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_digest"))
    labels = rows.withColumn("labels", F.split("host", r"\."))
    tried = F.filter(F.array(*[
        F.when((F.size("labels") >= depth) & (F.length("path") >= reach),
               F.concat(F.array_join(F.slice("labels", -depth, depth), "."), F.lit("\n"), F.substring("path", 1, reach)))
        for depth, reach in shapes]), lambda x: x.isNotNull())
    # A marker keeps URLs with no expression in the result.
    digests = F.concat(F.transform(tried, lambda x: F.sha2(x, 256)), F.array(F.lit("")))
    tries = labels.select("row", "id", "host", "path", F.explode(digests).alias("digest")).select(
        "*", F.substring("digest", 1, 8).alias("short"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    sides = table.select(F.substring("r_digest", 1, 8).alias("short"), "r_digest", "precedence",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    hits = tries.join(sides, ["short", "salt"], "left").withColumn("precedence", F.when(F.col("digest") == F.col("r_digest"), F.col("precedence")))
    best = hits.groupBy("row", "id", "host", "path").agg(F.max("precedence").alias("p"))
    rule_len, host_len = F.expr(f"cast(p div {_LEN} as int)"), F.expr(f"cast((p % {_LEN}) div {_HOST} as int)")
    best = best.select("id", "host", "path", "p", rule_len.alias("rl"), host_len.alias("hl"))
    r_host, r_path = F.expr("right(host, hl)"), F.expr("left(path, rl - hl)")
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.when(F.col("p").isNotNull(), F.concat(r_host, r_path)).alias("rule"),
        F.when(F.col("p").isNull(), F.lit(default)).when(F.col("p") % _HOST == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("p").isNotNull(), r_host).alias("rule_host"),
        F.when(F.col("p").isNotNull(), F.sha2(F.concat(r_host, F.lit("\n"), r_path), 256)).alias("rule_digest"))
