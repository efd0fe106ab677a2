"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (divergence, line_dedup, mixing, packing, quality_model, quality_rules, secrets, sharding, simhash, spelling, topk,
               toxicity, url_equivalence)
from .common import load

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


@register("op1_secret_battery")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of known forms and random strings in every document."""
    return secrets.secrets(load(spark, sf_dir, "documents"))


def _fail_bits_sql() -> str:
    return quality_rules.fail_bits().replace("L else 0L", " else 0")


def _mask(version: str) -> int:
    return quality_rules.POLICIES[version].mask


@register("op2_rule_ledger", rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6),
grams AS (SELECT doc_id, i, ws[i:i+4] AS g FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
             length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(ls) AS n_lines,
             length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, CAST({_fail_bits_sql()} AS BIGINT) AS fail_bits FROM m)
SELECT *, '{quality_rules.DEFAULT_POLICY}' AS policy, (fail_bits & {_mask('base-1')}) <> 0 AS base_failed,
       (fail_bits & {_mask(quality_rules.DEFAULT_POLICY)}) = 0 AS kept FROM b
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule bitmask ledger of every document under the default policy."""
    return quality_rules.apply_policy(quality_rules.ledger(load(spark, sf_dir, "documents")))


def _ablation_sql() -> str:
    mask = _mask(quality_rules.DEFAULT_POLICY)
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST({1 << i} AS BIGINT) AS bit" for i, r in enumerate(quality_rules.RULES) if mask >> i & 1)
    return f"""WITH led AS ({_ORACLE['op2_rule_ledger']}), enforced AS ({rules})
SELECT rule, '{quality_rules.DEFAULT_POLICY}' AS policy, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed,
       count(*) FILTER ((fail_bits & {mask}) = bit) AS n_only,
       count(*) FILTER ((fail_bits & {mask} & ~bit) <> 0) AS n_rejected_without
FROM led CROSS JOIN enforced GROUP BY rule"""


@register("rule_ablation", _ablation_sql())
def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects over all documents."""
    return quality_rules.ablation(quality_rules.ledger(load(spark, sf_dir, "documents")))


_LETTERS = url_equivalence.UPPER, url_equivalence.LOWER


def _rule_sql(pick: int) -> str:
    arms = []
    for kind, text in sorted(url_equivalence.RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        name, _, rest = text.partition("/")
        arms.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') "
                    f"THEN '{(kind, text)[pick]}'")
    return f"CASE {' '.join(arms)} END"


def _canonical_sql(rest: str) -> str:
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_LETTERS[0]}', '{_LETTERS[1]}')"
    host = rf"regexp_replace(regexp_replace({host}, ':(80|443)$', ''), '^(www|m)\.([^.]+\.)', '\2')"
    path = rf"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '(/index)?\.html?$|/index$', ''), '/+$', '')"
    kept = (f"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            f"lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')))")
    return (f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN len({kept}) > 0 "
            f"THEN '?' || array_to_string({kept}, '&') ELSE '' END END")


def _after_sql(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


@register("op3_redirect_equivalence", rf"""
WITH RECURSIVE u AS (SELECT page_id, {_after_sql("coalesce(url, '')")} AS rest, html FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_LETTERS[0]}', '{_LETTERS[1]}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_canonical_sql('rest')} AS canonical,
             CASE WHEN regexp_matches(html, '(?i)canonical') THEN
               regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*', 0),
                              '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS link,
             CASE WHEN regexp_matches(html, '(?i)http-equiv') THEN
               regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*', 0),
                              '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS refresh
      FROM u),
r AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS action FROM x),
t AS (SELECT canonical AS a, unnest([link, refresh]) AS url FROM r WHERE canonical IS NOT NULL),
e AS (SELECT DISTINCT a, {_canonical_sql(_after_sql('url'))} AS b FROM t WHERE url IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
top AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
c AS (SELECT r.*, coalesce(component, canonical) AS component FROM r LEFT JOIN top ON r.canonical = top.a),
f AS (SELECT component, bool_or(coalesce(action, '') = 'block') AS b, bool_or(coalesce(action, '') = 'allow') AS a
      FROM c WHERE component IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN f.b AND NOT f.a THEN 'block' ELSE 'allow' END) AS verdict,
       canonical, c.component FROM c LEFT JOIN f ON c.component = f.component
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page, with decisions spread to its aliases."""
    return url_equivalence.judge(load(spark, sf_dir, "pages"))


@register("op4_line_chunks", rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lines, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS v FROM l),
e AS (SELECT doc_id, lines, list_filter(range(1, len(v) + 1), lambda i: i = len(v) OR
        ({line_dedup.BASE} * coalesce(v[i - 1], 0) * (i > 1)::BIGINT + v[i]) % {line_dedup.MODULUS} % {line_dedup.MEAN_LINES} = 0) AS ends FROM h),
k AS (SELECT doc_id, lines, ends, unnest(range(1, len(ends) + 1)) AS k FROM e),
c AS (SELECT doc_id, k - 1 AS chunk, CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END AS lo, ends[k] AS hi, lines FROM k),
t AS (SELECT doc_id, chunk, lo, hi, hi - lo AS n_lines, array_to_string(lines[lo + 1:hi], chr(10)) AS body FROM c),
r AS (SELECT *, n_lines >= {line_dedup.MIN_LINES} AND regexp_matches(body, '[^\x20\x09-\x0D]') AND
             row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM t),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(lines)), lambda i: {{'i': i, 'body': lines[i] || chr(10) || lines[i + 1]}})) AS w FROM l),
q AS (SELECT doc_id, w.i AS i, row_number() OVER (PARTITION BY w.body ORDER BY doc_id, w.i) > 1 AS gone
      FROM w WHERE regexp_matches(w.body, '[^\x20\x09-\x0D]')),
g AS (SELECT doc_id, unnest([i, i + 1]) AS p FROM q WHERE gone
      UNION SELECT doc_id, unnest(range(lo + 1, hi + 1)) FROM r WHERE gone),
n AS (SELECT doc_id, unnest(list_transform(range(1, len(lines) + 1), lambda i: {{'p': i, 'line': lines[i]}})) AS n FROM l),
o AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.p) FILTER (g.p IS NULL) AS text, count(g.p) AS removed_lines
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.p = g.p GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(o.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated multi-line chunks and the short
    repeated runs that chunk edges miss."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed_col="removed_lines")


@register("line_runs", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(lines)), lambda i: {'i': i, 'body': lines[i] || chr(10) || lines[i + 1]})) AS w FROM l),
r AS (SELECT doc_id, w.i AS i, row_number() OVER (PARTITION BY w.body ORDER BY doc_id, w.i) > 1 AS gone
      FROM w WHERE regexp_matches(w.body, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS p FROM r WHERE gone),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(lines) + 1), lambda i: {'p': i, 'line': lines[i]})) AS k FROM l),
o AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.p) FILTER (g.p IS NULL) AS text, count(g.p) AS removed_lines
      FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(o.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
""")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of two lines or more."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_runs(docs, removed_col="removed_lines")


@register("op5_simhash_multi_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@register("op6_toxicity_ftrl")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@register("op7_vector_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"))


def _weight_sql(level: str) -> str:
    arms = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items())
    return f"CAST(CASE {arms} ELSE 1 END AS DOUBLE)" if arms else "CAST(1 AS DOUBLE)"


#: Epochs of the registered query; the pipeline takes each document once.
OP8_EPOCHS = 3


def _op8_sql() -> str:
    ctes = [r"""d AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(source, '^src[0-9]{1,9}$')
                   THEN 'd' || (CAST(substr(source, 4) AS INTEGER) % 4) END, 'unknown') AS domain,
                   coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
                 FROM documents WHERE doc_id IS NOT NULL)""",
            "leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL)"]
    parents: list[str] = []
    for level in mixing.LEVELS:
        path = ", ".join([*parents, level])
        join = f"JOIN s_{parents[-1]} USING ({', '.join(parents)})" if parents else ""
        budget = f"s_{parents[-1]}.share" if parents else \
            f"CAST(floor(sum(n) OVER () * {mixing.SHARE_PERCENT} / 100) AS DOUBLE)"
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        before = f"{by} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        ctes += [f"n_{level} AS (SELECT {path}, sum(tokens)::BIGINT AS n, CAST(sum(tokens) * {OP8_EPOCHS} AS DOUBLE) AS cap, "
                 f"{_weight_sql(level)} AS weight FROM leaves GROUP BY {path})",
                 f"k_{level} AS (SELECT n_{level}.*, {budget} AS budget FROM n_{level} {join})",
                 f"f_{level} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({before}), 0)) * weight >= "
                 f"cap * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({before}), 0)) AS is_full FROM k_{level})",
                 f"s_{level} AS (SELECT {path}, n, CASE WHEN is_full THEN cap ELSE (budget - "
                 f"sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by})) * weight / "
                 f"sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) END AS share FROM f_{level})"]
        parents.append(level)
    ctes += [f"p AS (SELECT domain, lang, source, n AS leaf_tokens, floor(share)::BIGINT AS share, "
             f"CASE WHEN n > 0 THEN (floor(share)::BIGINT // n) ELSE {OP8_EPOCHS} END AS epochs FROM s_source)",
             f"o AS (SELECT d.*, leaf_tokens, share, epochs, md5('{mixing.SEED}:' || epochs || ':' || doc_id) AS h "
             f"FROM d JOIN p USING (domain, lang, source))",
             "c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM o)"]
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, domain, lang, source, leaf_tokens, share,
       CAST(epochs + (epochs < {OP8_EPOCHS} AND upto <= share - epochs * leaf_tokens)::INT AS BIGINT) AS copies FROM c""")


@register("op8_hierarchical_budget", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, budget and number of chosen copies of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    x = mixing.mix(docs, max_epochs=OP8_EPOCHS)
    return x.select("doc_id", *[F.col(f"mix.{c}") for c in ("domain", "lang", "source", "leaf_tokens", "share", "copies")])


@register("op9_random_indexing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return quality_model.score(docs, quality_model.fit(docs, labels))


@register("op10_tiled_top_k", f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each 50th."""
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, vec_col="embedding")


@register("op11_communication_matrix")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; counts differ by one at most."""
    x = sharding.shuffle(sharding.with_size(load(spark, sf_dir, "documents")))
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _op12_sql() -> str:
    p = lambda c, n: f"1 + ({divergence.SCALE}::HUGEINT * ({c} + 1)) // nullif({n} + v, 0)"
    f = "((p - q) * (p - q)) // q"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL),
t AS (SELECT lang, count(*) AS v, sum(c) AS n FROM l GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, v, n AS nl FROM t) USING (lang)),
every AS (SELECT g.lang, g.source, l.term, {p('coalesce(c.c, 0)', 'g.n')} AS p, {p('l.c', 'g.nl')} AS q, coalesce(c.c, 0) AS c
          FROM g JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
own AS (SELECT lang, source, term AS item, {f} AS value FROM every WHERE c > 0 AND p > q),
twos AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0) AS value
         FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
two AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN twos ON twos.lang = a.lang AND twos.source = a.source AND twos.item = b.source),
r AS (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM own
      QUALIFY rank <= {divergence.TOP} UNION ALL
      SELECT lang, source, 'pair', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM two)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r"""


@register("op12_count_cells", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that set each source apart from its language, and the distances
    of the language's sources from each other."""
    return divergence.audit(load(spark, sf_dir, "documents"))


@register("op13_trie_frontier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words' number, its form and its root."""
    return spelling.group_variants(load(spark, sf_dir, "documents"))
