"""URL filtering by pattern rules that are indexed by their rarest literal token.

Each rule states literal tokens that every URL it fits must hold as whole tokens (maximal runs of
``[0-9a-z]`` of the lower-cased URL). Spark counts, over all URLs, in how many each of these tokens
occurs; a rule is filed under its rarest. A URL's tokens then fetch the rules filed under them, and
only those rules run their regular expression. A rule without a literal token is tried everywhere.

Work is per row: nothing is shuffled but one count per rule token, so a host that holds a third of
all rows needs no care. The rule set is a parameter; its size bounds what the driver and tasks hold.

Defined results: a null URL, or one without ``://``, has empty host and path and matches no host
rule (pattern rules see the raw URL; for null an empty one). Repeated rows are judged one by one.
Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path for host rules (``whole`` false), else on the whole URL.

    ``literals``: whole tokens that any fitting URL holds. Of fitting rules host rules go first,
    then the longest name.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    whole: bool = False


def host_rule(rule: str, verdict: str) -> UrlRule:
    """``example.org/en/1``: the host and its subdomains, paths that start with the rule's."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole_tokens = TOKEN.findall(host)
    # the last token of the path may go on in a URL, unless the rule itself ends it
    inner = TOKEN.findall(path.lower())
    if inner and re.search("[0-9A-Za-z]$", path):
        inner.pop()
    return UrlRule(
        rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole_tokens + inner)
    )


#: Host rules of the service contract.
HOST_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/es/", "block"),
    host_rule("example.org/en/1", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)

#: The method's own pattern rules for URLs that no host rule fits.
PATTERN_RULES = (
    UrlRule("spam-farm", "block", r"://(?:[^/?#]*[.-])?spam-farm[.-]", ("spam", "farm"), True),
    UrlRule("link-farm", "block", r"://(?:[^/?#]*[.-])?link-farm[.-]", ("link", "farm"), True),
    UrlRule("casino", "block", r"[/.-]casino(?:[/.-]|$)", ("casino",), True),
    UrlRule("porn", "block", r"[/.-]porn(?:[/.-]|$)", ("porn",), True),
    UrlRule("session", "block", r"[?&;](?:phpsessid|jsessionid)=", (), True),
    UrlRule("login", "block", r"/login(?:[/.?#]|$)", ("login",), True),
    UrlRule("cart", "block", r"/cart(?:[/.?#]|$)", ("cart",), True),
)


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def token_frequency(urls: DataFrame, rules: tuple[UrlRule, ...], url: str = "url") -> dict[str, int]:
    """In how many URLs each token that some rule states occurs; at most a row per such token."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(F.col(url), F.lit(""))), "[^0-9a-z]+"))
    rows = (
        urls.select(F.explode(tokens).alias("token"))
        .where(F.col("token").isin(wanted))
        .groupBy("token")
        .count()
        .collect()
    )
    return {r["token"]: r["count"] for r in rows}


def rarest_token_index(rules: tuple[UrlRule, ...], seen: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Rules by their rarest literal token; ``""`` holds those that state none."""
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        key = min(r.literals, key=lambda t: (seen.get(t, 0), t), default="")
        index.setdefault(key, []).append(r)
    return index


def judge_urls(
    urls: DataFrame,
    host_rules: tuple[UrlRule, ...] = HOST_RULES,
    pattern_rules: tuple[UrlRule, ...] = PATTERN_RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule (the host rule or null), pattern (the pattern rule or null), verdict."""
    rules = tuple(host_rules) + tuple(pattern_rules)
    index = rarest_token_index(rules, token_frequency(urls, rules, url_col))
    filed = {
        token: [(r.name, r.verdict, re.compile(r.pattern), r.whole) for r in group]
        for token, group in index.items()
    }

    @F.pandas_udf("rule string, pattern string, verdict string")
    def verdict(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for u, h, p in zip(url, host, path, strict=True):
            u = u or ""
            best = None  # host rules first, then the longest, then by name
            for token in {"", *TOKEN.findall(u.lower())}:
                for name, says, pattern, whole in filed.get(token, ()):
                    if pattern.search(u.lower() if whole else h + p):
                        best = max(best or (False, 0, "", ""), (not whole, len(name), name, says))
            if best is None:
                out.append((None, None, default))
            elif best[0]:
                out.append((best[2], None, best[3]))
            else:
                out.append((None, best[2], best[3]))
        return pd.DataFrame(out, columns=["rule", "pattern", "verdict"])

    rows = urls.select(
        F.col(id_col).alias(id_col),
        F.col(url_col).alias("_url"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    return rows.withColumn("_v", verdict("_url", "host", "path")).select(
        id_col, "host", "path", "_v.rule", "_v.pattern", "_v.verdict"
    )
