"""URL filters: pattern rules indexed by their rarest literal token.

A rule has literal tokens (runs of a-z and 0-9 that any URL it fits must hold as whole tokens) and a
regular expression. Token counts over all URLs say which literal of each rule is rarest; the index
holds each rule under that one. A URL's own tokens fetch candidate rules, and only those run their
expression; a rule without a literal runs on every URL. Everything is DataFrame expressions. The index is a map literal while there are at most
LITERAL_RULES rules; a larger rule set is joined by token instead.

The verdict is the longest site rule's that fits; else block if any pattern rule fits; else allow.

Nulls: a null url, or one without `://`, has empty host and path, fits nothing and is allowed. A null
page_id is kept; repeated rows stay. Empty table: no rows. Only page_id and url are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many are matched through a map literal in the plan.
LITERAL_RULES = 2_000
#: Every URL has this token: rules without a literal run on all of them.
ANY = ""


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # over host and path together; a host has no slash, a path starts with one or is empty
    literals: tuple[str, ...]
    site: bool


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits a host and its subdomains where the path starts with this path."""
    whole = re.sub("[A-Za-z0-9]+$", "", path)  # a last token may go on in a URL, so it is no literal
    parts = tuple(re.findall("[a-z0-9]+", f"{host} {whole}".lower()))
    return Rule(host + path, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", parts, True)


def pattern_rule(token: str, verdict: str = "block") -> Rule:
    """Fits hosts with this as a whole token."""
    return Rule(token, verdict, f"^(?:[^/]*[^a-z0-9/])?{re.escape(token)}(?![a-z0-9])", (token,), False)


#: The contract's site rules, and tokens of hosts that serve advertising or gambling.
SITE_RULES = (site_rule("net", "/", "block"), site_rule("example.net", "/en/", "allow"), site_rule("example.com", "/de/", "block"), site_rule("org", "/fr/", "allow"))
HOST_TOKENS = ("ads", "adserver", "banner", "tracker", "casino", "poker", "porn", "xxx", "viagra")
RULES = SITE_RULES + tuple(pattern_rule(t) for t in HOST_TOKENS)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_literals(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, str]:
    """Of each rule's name the literal that the fewest URLs hold (ties: the first in order)."""
    wanted = sorted({t for r in rules for t in r.literals})
    held = F.array_intersect(F.col("tokens"), F.lit(wanted)) if len(wanted) <= LITERAL_RULES else F.col("tokens")
    counts = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if len(wanted) > LITERAL_RULES:
        counts = counts.join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    seen = {r.token: r.n for r in counts.collect()}  # as many rows as there are literals at most
    return {r.name: min(r.literals, key=lambda t: (seen.get(t, 0), t), default=ANY) for r in rules}


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, literal_rules: int = LITERAL_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    parsed = parsed.withColumn("subject", F.concat("host", "path")).withColumn("tokens", tokens(F.col("subject")))
    key = rarest_literals(parsed, rules)
    if ANY in key.values():
        parsed = parsed.withColumn("tokens", F.concat("tokens", F.array(F.lit(ANY))))
    if len(rules) <= literal_rules:
        by: dict[str, list[Rule]] = {}
        for r in rules:
            by.setdefault(key[r.name], []).append(r)
        struct = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.site).alias("site"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
        index = F.create_map(*(x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*map(struct, rs)))))
        candidates = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(index, t)), lambda a: a.isNotNull()))
        fits = F.filter(candidates, lambda r: F.regexp_like(F.col("subject"), r["pattern"]))
        found = parsed.withColumn("fits", fits)
    else:
        index = spark.createDataFrame([(key[r.name], len(r.name), r.site, r.name, r.verdict, r.pattern) for r in rules], "token string, size int, site boolean, name string, verdict string, pattern string")
        hosts = parsed.select("host", "path", "subject", "tokens").distinct()
        hit = hosts.select("host", "path", "subject", F.explode("tokens").alias("token")).join(index, "token").filter("subject rlike pattern")
        hit = hit.groupBy("host", "path").agg(F.collect_list(F.struct("size", "site", "name", "verdict", "pattern")).alias("fits"))  # as many as fit one URL
        found = parsed.join(hit, ["host", "path"], "left").withColumn("fits", F.coalesce("fits", F.expr("array()")))
    best = F.array_max(F.filter("fits", lambda r: r["site"]))
    blocked = F.exists("fits", lambda r: ~r["site"] & (r["verdict"] == "block"))
    found = found.withColumn("best", best)
    return found.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same judgement as plain SQL over all rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sites = [r for r in rules if r.site]
    values = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.name.split('/', 1)[0])}, {q('/' + r.name.split('/', 1)[1])})" for r in sites)
    words = "|".join(r.name for r in rules if not r.site)
    return f"""
with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(rule, verdict, h, s) as (values {values}),
m as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
      from (select distinct host, path from u), r where (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by host, path)
select u.page_id, u.host, u.path, m.rule,
       coalesce(m.verdict, case when regexp_matches(u.host, '(^|[^a-z0-9])({words})([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
from u left join m on u.host = m.host and u.path = m.path"""
