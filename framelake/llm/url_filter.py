r"""URL filters: pattern rules indexed by their rarest literal token.

``judge_urls`` is native: tokens, rule look-up and regular expressions are column expressions, and
no row leaves its partition. Every rule carries a regular expression and a set of literal tokens
that each matching URL must contain; the rule is filed under the one of them that the URLs hold
least often (counted by one aggregation over the whole column, only for tokens of rules). A URL's
tokens fetch the rules filed under them, and only these run their expressions.

The index is a literal map while there are at most ``MAX_INLINE`` rules; a longer list becomes a
table: tokens are counted, rules filed and candidates fetched by joins on the token, so that no plan
and no driver holds the list twice. Both give the same rows.

A rule is written ``HOST`` or ``HOST/PATH``. The host pattern has to fit the whole host (``||`` in
front: or a subdomain of it), the path pattern the beginning of the path (``$`` behind: all of it).
``*`` stands for any run of characters, in a host of those other than ``/``; ``^`` for one character
that is neither a-z nor a digit, or for an end of the host; everything else for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INLINE = 2000
#: A URL is cut into tokens at everything but letters and digits.
TOKEN_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name``: what is reported; ``pattern``: Java expression over host and path; ``rank``: the highest wins."""

    name: str | None
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int


_EDGE, _PART = r"(?:\A|[^a-z0-9/]|(?=/|\z))", re.compile(r"[a-z0-9]+|.", re.S | re.I)


def parse_rule(text: str, verdict: str = "block", name: str | None = None, rank: int | None = None) -> Rule:
    """The rule that ``text`` writes; without ``rank`` the longer of two rules ranks higher."""
    wide, rest = text.startswith("||"), text.removeprefix("||")
    host, slash, path = rest.partition("/")
    path, whole = slash + path.removesuffix("$"), rest.endswith("$")
    literals: set[str] = set()

    def written(parts: list[str], star: str, edge: str, opens: bool, closes: bool) -> str:
        """Expression of a pattern; letters and digits between two ends of tokens are literal tokens."""
        for k, part in enumerate(parts):
            before = opens if k == 0 else parts[k - 1] != "*"
            after = closes if k == len(parts) - 1 else parts[k + 1] != "*"
            if part.isascii() and part.isalnum() and before and after:
                literals.add(part.lower())
        return "".join(star if p == "*" else edge if p == "^" else re.escape(p) for p in parts)

    front = written(_PART.findall(host), "[^/]*", _EDGE, True, True)
    behind = written(_PART.findall(path), ".*", "[^a-z0-9]", True, whole)
    pattern = r"(?s)\A" + r"(?:[^/]*\.)?" * wide + front + r"(?=/|\z)" + behind + r"\z" * whole
    if not literals:
        raise ValueError(f"rule {text!r} has no literal token to be filed under")
    return Rule(name, verdict, pattern, tuple(sorted(literals)), len(rest) if rank is None else rank)


def site_rule(site: str, verdict: str) -> Rule:
    """A named rule ``host/path-prefix`` that fits the host and its subdomains; it ranks above unnamed ones."""
    return parse_rule("||" + site, verdict, site, 1_000_000 + len(site))


#: General spam and tracking patterns (an example; a list of one's own is a parameter of ``judge_urls``):
#: they decide where no site rule fits.
GENERAL_RULES = tuple(
    parse_rule(f"*^{words.replace('-', '^')}^*")
    for words in ("cheap-pills", "casino-win", "free-bets", "spam-farm", "ads-track", "link-farm", "click-bait", "adult-cams", "payday-loans", "warez-zone")
)
SITE_RULES = (
    site_rule("com/en/", "block"), site_rule("example.com/en/7", "allow"), site_rule("net/de/", "allow"),
    site_rule("example.net/de/8", "block"), site_rule("org/es/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://`` (null without one)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _lowered(text: Column) -> Column:
    """A-Z in small letters and nothing else: other letters never become one of a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(_lowered(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def _tokens() -> Column:
    """Tokens of a URL; the path's first slash parts it from the host."""
    return F.array_distinct(F.split(_lowered(F.concat("__host", "__path")), TOKEN_SPLIT))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each literal of the rules: one aggregation, as many rows as there are literals at most."""
    literals = sorted({t for r in rules for t in r.literals})
    wanted = F.array_intersect(_tokens(), F.array(*map(F.lit, literals)))
    return {r.t: r["count"] for r in urls.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.literals, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(rarest, []).append(rule)
    return index


def _rule_struct(rule: Rule) -> Column:
    return F.struct(
        F.lit(-rule.rank).cast("long").alias("down"), F.lit(rule.name).cast("string").alias("name"),
        F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"),
    )


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + GENERAL_RULES, *, url_col: str = "url", default: str = "allow",
    max_inline: int = MAX_INLINE,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (columns of these names are replaced).

    Null URL or no ``://``: host and path are empty and the verdict is the default. Of the rules that
    fit the highest rank wins; of equal ranks the smallest name (none before any), then the smallest
    verdict. Repeated rows are judged alike, an empty table gives an empty one, URLs are never cut.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "__host", "__path", "__rule")
    parts = pages.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    if not rules:
        judged = parts.withColumn("__rule", F.lit(None).cast("struct<down:long,name:string,verdict:string>"))
    elif len(rules) <= max_inline:
        index = rule_index(rules, token_counts(parts, rules))
        filed = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_rule_struct, rs)))])
        known = F.filter(_tokens(), lambda t: F.map_contains_key(filed, t))
        fetched = F.flatten(F.transform(known, lambda t: F.element_at(filed, t)))
        fitting = F.filter(fetched, lambda r: F.rlike(F.concat("__host", "__path"), r["pattern"]))
        best = F.array_min(F.transform(fitting, lambda r: F.struct(r["down"].alias("down"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
        judged = parts.withColumn("__rule", best)
    else:
        judged = _joined(parts, rules)
    return judged.select(
        *pages.columns, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.name").alias("rule"),
        F.coalesce("__rule.verdict", F.lit(default)).alias("verdict"),
    )


def _joined(parts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same for long rule lists: distinct (host, path) fetch their rules by a join on the token."""
    spark: SparkSession = parts.sparkSession
    table = spark.createDataFrame(
        [(k, -r.rank, r.name, r.verdict, r.pattern, list(r.literals)) for k, r in enumerate(rules)],
        "__id long, down long, name string, verdict string, pattern string, literals array<string>",
    )
    urls = parts.select("__host", "__path").distinct().select("__host", "__path", F.explode(_tokens()).alias("__t"))
    literals = table.select("__id", F.explode("literals").alias("__t"))
    rows = parts.select(F.explode(_tokens()).alias("__t")).join(literals.select("__t").distinct(), "__t", "left_semi").groupBy("__t").agg(F.count("*").alias("__n"))
    rarest = literals.join(rows, "__t", "left").groupBy("__id").agg(F.min_by("__t", F.struct(F.coalesce("__n", F.lit(0)), F.col("__t"))).alias("__t"))
    filed = table.drop("literals").join(rarest, "__id").drop("__id")
    found = (
        urls.join(filed, "__t").where(F.rlike(F.concat("__host", "__path"), F.col("pattern")))
        .groupBy("__host", "__path").agg(F.min(F.struct("down", "name", "verdict")).alias("__rule"))
    )
    return parts.join(found, ["__host", "__path"], "left")
