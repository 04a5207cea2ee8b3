"""Allow and block rules on URLs by a sort-merge range join.

A rule is a host and a path; it fits URLs of that host and its subdomains whose path starts
with its path, and the longest fitting rule decides.  Written with the host reversed, the
rules of a host are intervals of the canonical key: every key that starts with the rule's
lies between the rule and the end of its prefix, and such intervals nest or are disjoint.

The sweep: rules and URLs of one reversed host, sorted by canonical key.  Each rule carries
the stack of rules it is nested in.  The last rule at or before a URL is on top; the rule
that decides is the innermost of its stack whose interval still holds the URL (anything
sorted between a prefix and a string with that prefix has the prefix too, so no other rule
can fit).  A URL takes part once for each suffix of its host that has rules.

URLs are reduced to distinct (host, path) before the sweep, combined in the map tasks.  A
host with most of the URLs is dealt to ``spread`` sweeps by a hash of the path, each with
all rules of the host; the rows per sweep are only sorted and streamed.

A null URL, or one without ``://``, has an empty host and path and fits no rule.  Rows with
null or repeated ids each give a row.  Rules without ``/``, or that repeat another with the
other verdict, are rejected.  Between fitting rules of equal length the longer host decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.llm.common import ascii_lower
from oreline.operators.absent import join_afresh

_STACK = "array<struct<key:string,length:int,host:int,rule:string,verdict:string>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the module describes them."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """``site, key, stack`` per rule: its reversed host, its canonical key and the rules it is
    nested in, outermost first, itself last.  ``rules``: ``rule`` (host/path), ``verdict``."""
    cut = F.instr("rule", "/")
    bad = (cut == 0) | ~F.col("verdict").isin("allow", "block") | F.col("rule").isNull()
    host = F.substring_index("rule", "/", 1)
    each = rules.select(
        F.when(~F.coalesce(bad, F.lit(True)), F.col("rule"))
        .otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.coalesce("rule", F.lit("null")))))
        .alias("rule"),
        "verdict",
    ).groupBy("rule").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other"))
    each = each.select(
        _reversed(host).alias("site"),
        F.expr("substr(rule, instr(rule, '/'))").alias("key"),
        F.length("rule").alias("length"),
        F.length(host).alias("host"),
        "rule",
        F.when(F.col("verdict") == F.col("other"), F.col("verdict"))
        .otherwise(F.raise_error(F.concat(F.lit("two verdicts: "), F.col("rule"))))
        .alias("verdict"),
    )
    # Every proper prefix of a rule's path that may be a rule of the same host: an equi-join.
    prefix = each.select(
        "site", F.col("key").alias("own"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"),
    )
    entry = F.struct("key", "length", "host", "rule", "verdict")
    return (
        prefix.join(each, ["site", "key"])
        .groupBy("site", F.col("own").alias("key"))
        .agg(F.sort_array(F.collect_list(entry)).cast(_STACK).alias("stack"))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    spread: int = 64,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; ``default`` where no rule fits."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    table = rule_table(rules)
    places = rows.select("host", "path").distinct()
    label = F.split("host", r"\.", -1)
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(label)),
        lambda n: F.array_join(F.reverse(F.slice(label, n, F.size(label))), "."),
    )
    urls = places.where("path != ''").select("host", "path", F.explode(suffix).alias("site"))
    urls = urls.join(table.select("site").distinct(), "site", "left_semi")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(spread)).cast("int")
    events = urls.select(
        "site", salt.alias("salt"), F.col("path").alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(_STACK).alias("stack"), "host", "path",
    ).unionByName(
        table.select(
            "site", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"), "key",
            F.lit(0).alias("kind"), "stack",
            F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        )
    )
    sweep = Window.partitionBy("site", "salt").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    active = F.filter(F.col("open"), lambda r: F.startswith(F.col("path"), r["key"]))
    fitting = (
        events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1 AND open IS NOT NULL")
        .select("host", "path", F.try_element_at(active, F.lit(-1)).alias("r"))
        .where("r IS NOT NULL")
    )
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct("r.length", "r.host", "r.rule", "r.verdict")).alias("r")
    )
    # Fresh shuffles, which can be split: one URL, or none, may be on any number of pages.
    return join_afresh(rows, best, ["host", "path"], "left", step=6).select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """A rule list as the operator's input: pairs of rule and verdict."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")
