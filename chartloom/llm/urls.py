"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule is written with literals, ``*`` (anything), ``^`` (a separator or
the end) and a leading ``||`` (start of the host or of one of its labels).  Each
rule is filed under the literal token of its pattern that the fewest URLs hold.
A URL's tokens fetch the rules filed under them, and only those run their
regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """``rule`` is a host and a path prefix; the longest that fits a URL decides."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


SITE_RULES = (
    SiteRule("net/", "block"),
    SiteRule("example.net/en/", "allow"),
    SiteRule("example.com/de/", "block"),
    SiteRule("org/fr/", "allow"),
)

#: pattern rules for URLs that no site rule covers
PATTERN_RULES = (
    "||spam-farm.",
    "||cheap-pills.",
    "||casino-win.",
    "||ads-track.",
    "||adult-x.",
    "||free-bets.",
    "/porn/",
    "/viagra^",
    "/free-download^",
    "/replica-watches-*buy",
)

_TOKEN = re.compile(r"[a-z0-9]+")


def pattern_regex(rule: str) -> str:
    body = rule[2:] if rule.startswith("||") else rule
    spelled = "".join(
        {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c) if not c.isalnum() else c) for c in body.lower()
    )
    return (r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if rule.startswith("||") else "") + spelled


def site_regex(rule: SiteRule) -> str:
    return r"^[^:]*(?::(?!//)[^:]*)*://(?:[^/?#]*\.)?" + re.escape(rule.host) + re.escape(rule.path)


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every URL fitting the pattern holds as whole tokens or as parts of one.

    A token at the edge of the pattern or of a wildcard may go on in the URL;
    those count only where a separator or the host's start bounds them.
    """
    body = pattern[2:] if pattern.startswith("||") else pattern
    out = []
    for m in _TOKEN.finditer(body.lower()):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and pattern.startswith("||")
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            out.append(m.group())
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = at > 0
    return (
        F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""),
        F.when(known, path).otherwise(""),
    )


def _filed(urls: DataFrame, tokens: str, patterns: list[tuple]) -> list[tuple]:
    """(token or null, pattern row): each pattern under its token that the fewest URLs hold."""
    wanted = sorted({t for row in patterns for t in row[-1]})
    held = {}
    if wanted:
        # the counts are of the rules' tokens only: as many rows as the rule tables have tokens
        counts = (
            urls.select(F.explode(F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]))).alias("t"))
            .groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        )
        held = {r["t"]: r["n"] for r in counts.collect()}
    return [(min(row[-1], key=lambda t: (held.get(t, 0), t), default=None), *row[:-1]) for row in patterns]


def url_filter(
    df: DataFrame,
    url: str = "url",
    site_rules: tuple[SiteRule, ...] = SITE_RULES,
    pattern_rules: tuple[str, ...] = PATTERN_RULES,
) -> DataFrame:
    """The table with ``host``, ``path``, ``rule`` (site rule, else null), ``pattern`` (first that fits, else null) and ``verdict``.

    A null URL and one without ``://`` has an empty host and path, fits no site
    rule and is allowed unless a pattern fits.  Repeated rows keep their number
    and get one verdict; input columns named like a result are replaced by it;
    an empty table stays empty.  A verdict depends on the URL alone, so
    candidates are worked out once per different URL.
    """
    kept = [c for c in df.columns if c not in {"host", "path", "rule", "pattern", "verdict"} or c == url]
    key, low, toks, host, path = fresh(df, "url_key", "url_low", "url_tokens", "url_host", "url_path")
    spread = df.select(*kept, F.col(url).alias(key))
    h, p = url_parts(F.col(key))
    urls = spread.select(key).where(F.col(key).isNotNull()).distinct().select(
        key, h.alias(host), p.alias(path), F.translate(key, UPPER, LOWER).alias(low)
    ).withColumn(toks, F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))))

    rules = [
        ("site", i, r.rule, r.verdict, len(r.rule), r.host, r.path, "", tuple(_TOKEN.findall(r.host.lower())))
        for i, r in enumerate(site_rules)
    ] + [
        ("pattern", i, r, "block", 0, "", "", pattern_regex(r), tuple(literal_tokens(r)))
        for i, r in enumerate(pattern_rules)
    ]
    filed = _filed(urls, toks, rules)
    schema = "token string, kind string, ord int, rule string, verdict string, size int, host string, path string, regex string"
    index = df.sparkSession.createDataFrame(filed, schema)
    names = {c: f"_rule_{c}" for c in index.columns}
    index = index.select(*[F.col(c).alias(n) for c, n in names.items()])

    tokenless = [row for row in filed if row[0] is None]
    # rules without a bounded literal are fetched by every URL, through an empty token
    asked = F.concat(F.col(toks), F.array(F.lit(""))) if tokenless else F.col(toks)
    index = index.withColumn("_rule_token", F.coalesce("_rule_token", F.lit("")))
    fetched = urls.select(key, host, path, low, F.explode(asked).alias("_token")).join(
        index, F.col("_token") == F.col("_rule_token")
    )
    dotted, ruled = F.concat(F.lit("."), F.col(host)), F.concat(F.lit("."), F.col("_rule_host"))
    site = (F.col("_rule_kind") == "site") & dotted.endswith(ruled) & F.startswith(F.col(path), F.col("_rule_path"))
    pattern = (F.col("_rule_kind") == "pattern") & F.expr(f"`{low}` rlike _rule_regex")
    fits = fetched.where(F.when(F.col("_rule_kind") == "site", site).otherwise(pattern))
    best = fits.groupBy(key).agg(
        F.max(F.when(F.col("_rule_kind") == "site", F.struct("_rule_size", (-F.col("_rule_ord")).alias("o"), "_rule_rule", "_rule_verdict"))).alias("_site"),
        F.min(F.when(F.col("_rule_kind") == "pattern", F.struct("_rule_ord", "_rule_rule"))).alias("_pattern"),
    )
    out = spread.join(best.withColumnRenamed(key, "_best_key"), F.col(key) == F.col("_best_key"), "left")
    h, p = url_parts(F.col(key))
    return out.select(
        *[F.col(c) for c in kept],
        h.alias("host"),
        p.alias("path"),
        F.col("_site._rule_rule").alias("rule"),
        F.col("_pattern._rule_rule").alias("pattern"),
        F.coalesce(F.col("_site._rule_verdict"), F.when(F.col("_pattern").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
    )


RESULT = ["page_id", "host", "path", "rule", "pattern", "verdict"]


def op10_url_filter(spark, folder: str) -> DataFrame:
    """Verdict of every page's URL."""
    return url_filter(table(spark, folder, "pages").select("page_id", "url")).select(*RESULT)


def _sql() -> str:
    site = ", ".join(f"('{r.rule}', '{r.verdict}', '{r.host}', '{r.path}')" for r in SITE_RULES)
    tests = " ".join(
        f"when regexp_matches(low, '{pattern_regex(r)}') then '{r}'" for r in PATTERN_RULES
    )
    return f"""
with parts as (
  select page_id, url, translate(url, '{UPPER}', '{LOWER}') as low,
    case when strpos(url, '://') > 0
      then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') else '' end as host,
    case when strpos(url, '://') > 0
      then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(rule, verdict, rule_host, rule_path) as (values {site}),
judged as (
  select *, (select max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) from rules r
             where ends_with('.' || host, '.' || r.rule_host) and starts_with(path, r.rule_path)) as hit,
    case {tests} end as pattern
  from parts)
select page_id, host, path, hit.rule as rule, pattern,
  coalesce(hit.verdict, case when pattern is not null then 'block' else 'allow' end) as verdict
from judged"""


ORACLE = _sql()
