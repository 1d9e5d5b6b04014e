"""robots.txt as tables: parsed rules, and whether a link may be fetched."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines


def rules(files: DataFrame, origin: str, text: str, agent: str) -> DataFrame:
    """(origin, kind, pattern, delay) of the groups that hold for `agent`: those that name it, else those for all.

    Agent lines in a row open one group; a rule closes the list of agents. The delay is the largest of the
    groups, 1 at least. An origin without rules has one row with null kind."""
    rows = files.select(F.col(origin).alias("origin"), F.posexplode_outer(lines(F.col(text))).alias("pos", "line"))
    line = F.trim(F.split(F.coalesce("line", F.lit("")), "#", 2)[0])
    rows = rows.select("origin", "pos", F.lower(F.trim(F.split(line, ":", 2)[0])).alias("key"), F.trim(F.try_element_at(F.split(line, ":", 2), F.lit(2))).alias("value"))
    known = rows.where(F.col("value").isNotNull() & F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate"))
    w = Window.partitionBy("origin").orderBy("pos")
    known = known.withColumn("opens", ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")).cast("int"))
    known = known.withColumn("grp", F.sum("opens").over(w)).where("grp > 0")
    name = F.lower("value")
    agents = known.where("key = 'user-agent'").groupBy("origin", "grp").agg(F.bool_or(F.lit(agent.lower()).contains(name) & (name != "*")).alias("named"), F.bool_or(name == "*").alias("any"))
    has_rule = known.where("key <> 'user-agent'").select("origin", "grp").distinct()
    agents = agents.join(has_rule, ["origin", "grp"], "left_semi").withColumn("any_named", F.bool_or("named").over(Window.partitionBy("origin")))
    chosen = agents.where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("any"))).select("origin", "grp")
    held = known.join(chosen, ["origin", "grp"])
    rate = F.regexp_extract("value", r"^(\d+)/(\d+)$", 2).try_cast("double") / F.nullif(F.regexp_extract("value", r"^(\d+)/(\d+)$", 1).try_cast("double"), F.lit(0.0))
    delay = F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double")).when(F.col("key") == "request-rate", rate)
    delays = held.groupBy("origin").agg(F.greatest(F.coalesce(F.max(delay), F.lit(1.0)), F.lit(1.0)).alias("delay"))
    pattern = held.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("origin", F.col("key").alias("kind"), F.col("value").alias("pattern"))
    every = files.select(F.col(origin).alias("origin")).distinct()
    return every.join(pattern, "origin", "left").join(delays, "origin", "left").select("origin", "kind", "pattern", F.coalesce("delay", F.lit(1.0)).alias("delay"))


def as_regex(pattern: Column) -> Column:
    """* is any text, a last $ the end; everything else stands for itself."""
    end = pattern.endswith("$")
    body = F.when(end, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.transform(F.split(body, r"\*"), lambda p: F.concat(F.lit("\\Q"), F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p), F.lit("\\E")))
    return F.concat(F.lit("^"), F.array_join(quoted, ".*"), F.when(end, F.lit("$")).otherwise(F.lit("")))


def allowed(links: DataFrame, url: str, origin: str, rules_: DataFrame) -> DataFrame:
    """links with `allowed`: the longest pattern that fits decides, an allowing one wins ties; none fits: allowed."""
    part = lambda name: F.try_parse_url(F.col(url), F.lit(name))
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    target = F.concat(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.coalesce(F.concat(F.lit("?"), F.nullif(part("QUERY"), F.lit(""))), F.lit("")))
    r = rules_.where("kind IS NOT NULL").groupBy(F.col("origin").alias("_o")).agg(F.collect_list(F.struct(F.length(F.replace("pattern", F.lit("*"), F.lit(""))).alias("n"), (F.col("kind") == "allow").alias("allow"), as_regex(F.col("pattern")).alias("re"))).alias("_rules"))
    fits = F.filter("_rules", lambda x: F.regexp_like(F.col("_target"), x["re"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(x["n"], x["allow"])))
    return links.withColumn("_target", target).join(r, F.col(origin) == F.col("_o"), "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_target", "_o", "_rules")


def allowed_one(url_path: str, rule_list: list[tuple[str, str]]) -> bool:
    """The same rule for one path, for tests."""
    hits = []
    for kind, pattern in rule_list:
        body = pattern.removesuffix("$")
        if re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else ""), url_path):
            hits.append((len(body.replace("*", "")), kind == "allow"))
    return max(hits)[1] if hits else True
