"""URL rules with redirect equivalence (DataFrame functions only).

Each URL is judged by the longest rule that fits its host (or a domain above
it) and the beginning of its path. Then decisions spread to aliases: the nodes
are URLs in canonical form, the edges say that one leads to another:

* a page's canonical link (``<link rel=canonical href=...>``) and its refresh
  redirect (``<meta http-equiv=refresh content="0; url=...">``);
* rows of an optional table of redirects (``from_url``, ``to_url``).

Canonical form drops what sites redirect by convention: the scheme, default
ports, a ``www.`` or ``m.`` label in front, the fragment, tracking parameters,
a closing slash, ``.html`` and ``index.html``. A component that holds a
blocked URL and no explicitly allowed one blocks its pages that no rule fits;
an allow rule anywhere in the component takes precedence. Rules that fit a page
itself always decide it.

A link's target is judged by the rules like a page, whether or not it is one,
so an uncrawled URL spreads its decision too.

Flags are aggregated per canonical URL with a partial aggregate before they
move, and components come from ``connected_components``; html is read once and
not shuffled.

Defined results: null URLs and those without ``://`` have empty host and path,
no rule and no alias, and are allowed. Null html has no edges. Targets without
a scheme are resolved against the page's URL, or its ``<base href>``; those of
other schemes (``mailto:``) and empty ones are no edges. Rows that repeat a
page id are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize
from .components import connected_components

#: (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"

_BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def resolve(target: Column, base: Column) -> Column:
    """URL without its scheme that a link leads to from the page at ``base``
    (also without its scheme); null for none and for the page itself."""
    host = F.regexp_extract(base, "^[^/?#]*", 0)
    path = F.regexp_extract(target, "^[^?#]*", 0)
    tail = F.regexp_extract(target, "(?s)^[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(base), "(?s)^.*/", 0)
    full = F.when(F.startswith(path, F.lit("/")), path) \
            .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))) \
                         .when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    # a closing . or .. is a folder
    dotted = F.regexp_replace(full, "/(\\.\\.?)$", "/$1/")
    plain = F.array_join(F.aggregate(F.split(dotted, "/"), F.array().cast("array<string>"), up), "/")
    full = F.when(full.rlike("/\\.\\.?(/|$)"), plain).otherwise(full)
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), after_scheme(target)) \
            .when(F.startswith(target, F.lit("//")), F.substr(target, F.lit(3))) \
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)) \
            .when(host == "", F.lit(None)) \
            .when(path != "", F.concat(host, full, tail)) \
            .when(F.startswith(target, F.lit("?")), F.concat(host, path_of(base), tail))


def canonical(rest: Column) -> Column:
    """Canonical form of a URL without its scheme; null for none."""
    host = F.regexp_replace(F.regexp_replace(host_of(rest), ":(80|443)$", ""), "^(www|m)\\.(?=[^.]+\\.)", "")
    path = F.regexp_replace(path_of(rest), "(/index)?\\.html?$|/index$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)")))
    key = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", key)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, allow first among equals."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return rule, action


def _judged(rest: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(canonical form, action) of a link's target."""
    _, action = rule_for(host_of(rest), path_of(rest), rules)
    return F.struct(canonical(rest).alias("key"), action.alias("action"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, component`` per page
    (``component`` is the smallest canonical URL of its aliases)."""
    if any(a not in ("allow", "block") or "/" not in t for a, t in rules):
        raise ValueError("a rule is allow or block and a host with a path")
    html = col(html_col) if html_col else F.lit(None).cast("string")
    target = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    x = pages.select(col(id_col).alias("page_id"), after_scheme(F.coalesce(col(url_col), F.lit(""))).alias("rest"),
                     F.when(html.rlike("(?i)canonical"), target(_LINK)).alias("link"),
                     F.when(html.rlike("(?i)http-equiv"), target(_REFRESH)).alias("refresh"),
                     F.when(html.rlike("(?i)<base"), target(_BASE)).alias("base"))
    x = x.withColumn("base", F.coalesce(resolve(F.col("base"), F.col("rest")), "rest"))
    x = x.select("page_id", "rest", *[resolve(F.col(c), F.col("base")).alias(c) for c in ("link", "refresh")])
    x = x.select("page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"),
                 canonical(F.col("rest")).alias("key"),
                 F.filter(F.array(*[_judged(F.col(c), rules) for c in ("link", "refresh")]),
                          lambda t: t["key"].isNotNull()).alias("targets"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    x = materialize(x.select("*", rule.alias("rule"), action.alias("action")), "pages")
    edges = x.where("key is not null").select(F.col("key").alias("a"), F.explode("targets.key").alias("b"))
    if redirects is not None:
        ends = [canonical(after_scheme(F.coalesce(F.col(c), F.lit("")))).alias(n) for c, n in (("from_url", "a"), ("to_url", "b"))]
        edges = edges.unionAll(redirects.select(*ends))
    comp = connected_components(edges)
    flags = x.where("key is not null").groupBy(F.col("key").alias("url")) \
             .agg(F.max((F.coalesce("action", F.lit("")) == "block")).alias("blocked"),
                  F.max((F.coalesce("action", F.lit("")) == "allow")).alias("allowed"))
    # URLs that are no page of the table can be under a rule as well
    ends = x.where("key is not null").select(F.explode("targets").alias("t")).where("t.action is not null")
    flags = flags.unionAll(ends.select("t.key", F.col("t.action") == "block", F.col("t.action") == "allow")) \
                 .groupBy("url").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    if redirects is not None:
        named = edges.select(F.explode(F.array("a", "b")).alias("url")).where("url is not null").distinct()
        host, path = F.regexp_extract("url", "^[^/?]*", 0), F.concat(F.regexp_extract("url", "^[^/?]*([^?]*)", 1), F.lit("/"))
        _, kind = rule_for(host, path, rules)
        flags = flags.unionAll(named.select("url", F.coalesce(kind == "block", F.lit(False)), F.coalesce(kind == "allow", F.lit(False)))) \
                     .groupBy("url").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    named = flags.join(comp, F.col("url") == F.col("node"), "left") \
                 .select("url", F.coalesce("root", "url").alias("component"), "blocked", "allowed")
    over = named.groupBy(F.col("component").alias("top")) \
                .agg(F.max("blocked").alias("any_block"), F.max("allowed").alias("any_allow"))
    verdicts = named.join(over, F.col("component") == F.col("top")) \
                    .select("url", "component", (F.col("any_block") & ~F.col("any_allow")).alias("stop"))
    method = F.when(F.col("stop"), "block").otherwise("allow")
    return x.join(verdicts, F.col("key") == F.col("url"), "left") \
            .select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"),
                    F.col("key").alias("canonical"), "component")
