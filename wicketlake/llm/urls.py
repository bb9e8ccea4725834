"""Operator 3, URL filters by association rules.

A URL becomes a set of tokens: host labels, registered domain, path segments,
query keys, scheme. Spark's FP-growth mines combinations of tokens and the
class token from labelled URLs; combinations that reach the support and the
confidence become rules for the class ``block``. Rules are matched by an
inverted index: every rule is posted under each of its tokens, the tokens of a
URL are joined with the postings, and a rule fires where all its tokens were
found.

Above the mined rules stands a list of fixed rules (host and path prefix, the
longest that fits wins); a URL that none of them fits gets the mined verdict:
block where a rule fires, else allow.

Scale. Distinct URL shapes (token sets) are judged once each and joined back,
so a host with a third of all pages is one aggregated row per shape. Mining
reads all labelled URLs; the support is a share of them, so the number of
frequent combinations, and with it the rule table, is bounded by the share and
by ``max_rule`` tokens and does not grow with the pages. The shapes at which a
rule fires are written, counted, and broadcast up to 100,000; beyond that the
same join shuffles, and Spark splits a shape with very many pages.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no tokens, fits no rule and is allowed; labels with nulls are not used;
repeated pages give repeated rows; without labelled URLs no rule is mined and
the method allows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import small, written

BLOCK = "class=block"

# Rules of the contract as (verdict, host, path prefix).
FIXED_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens; numbers are one token, so ids do not split shapes."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segment = lambda s: F.regexp_replace(s, r"[0-9]+", "9")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
                F.concat(F.lit("domain="), F.array_join(F.slice(F.reverse(labels), 1, 2), "<"))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), segment(s))),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                    lambda s: F.concat(F.lit("query="), F.split(s, "=")[0])))
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(parts))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.2,
               max_rule: int = 3) -> DataFrame:
    """``(rule_id, tokens, support, confidence)`` mined from ``(tokens,
    blocked)``: combinations of at most ``max_rule`` tokens seen in at least
    ``min_support`` of the labelled URLs, of which at least ``min_confidence``
    are blocked and ``min_lift`` times the overall share. A rule that holds a
    smaller rule is pruned: it fires only where the smaller one does."""
    from pyspark.ml.fpm import FPGrowth

    baskets = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK)))
                              .otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules
             .filter((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.size("antecedent") <= max_rule)
                     & (F.col("lift") >= min_lift))
             .select(F.array_sort("antecedent").alias("tokens"), "support", "confidence"))
    rules = rules.withColumn("rule_id", F.xxhash64("tokens"))
    # A smaller rule inside a rule shares its tokens: found by the same index.
    posted = rules.select("rule_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    inside = (posted.alias("a").join(posted.alias("b"), F.expr("a.token = b.token and a.n < b.n"))
              .groupBy("a.rule_id", "a.n", F.col("b.rule_id").alias("larger")).count().filter("count = n")
              .select(F.col("larger").alias("rule_id")).distinct())
    return rules.join(inside, "rule_id", "left_anti").select("rule_id", "tokens", "support", "confidence")


def fired(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets at which a rule fires, through the inverted index:
    ``(tokens, n_rules, confidence)``."""
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    posted = shapes.select("tokens", F.xxhash64("tokens").alias("shape"), F.explode("tokens").alias("token"))
    met = (posted.join(index, "token").groupBy("shape", "tokens", "rule_id", "n", "confidence").count()
           .filter("count = n"))
    return met.groupBy("tokens").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest fixed rule that fits, as ``struct(rule, verdict)``, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(FIXED_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """``(page_id, host, path, rule, verdict, n_rules, confidence)``.
    ``labelled`` has ``(url, blocked)``."""
    url = F.col("url")
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).withColumn("tokens", tokens_of(url))
    rules = mine_rules(labelled.filter("url is not null and blocked is not null")
                       .select(tokens_of(url).alias("tokens"), "blocked").filter(F.size("tokens") > 0), **mining)
    verdicts = written(fired(own.select("tokens").filter(F.size("tokens") > 0).distinct(), rules), "url-verdicts")
    judged = own.join(small(verdicts, 100_000), "tokens", "left").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    judged = judged.withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"),
                         F.coalesce("fixed.verdict", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
                         F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, blocked)`` of the pages whose document is labelled: the first
    number that starts a path segment names the document; a document of low
    quality, or a toxic one, is to be blocked."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[^0-9/][^/]*)?(?:/|$)", 1)
    own = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).filter("doc_id is not null")
    bad = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return own.join(bad, "doc_id").select("url", "blocked")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), parts AS (
  SELECT *, string_split(host, '.') AS labels, regexp_extract(url, '(?s)\?([^#]*)', 1) AS query FROM p
), t AS (
  SELECT page_id, url, host, path, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_concat(
      ['scheme=' || regexp_extract(url, '(?s)^(.*?)://', 1), 'domain=' || array_to_string(list_reverse(labels)[1:2], '<')],
      list_transform(labels, lambda x: 'host=' || x),
      list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '9', 'g')),
      list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'query=' || string_split(x, '=')[1])))) ELSE [] END AS tokens,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[^0-9/][^/]*)?(?:/|$)', 1), '') AS BIGINT) AS doc_id FROM parts
), l AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS blocked FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
train AS (SELECT row_number() OVER () AS row, tokens, blocked FROM t JOIN l USING (doc_id) WHERE len(tokens) > 0),
total AS (SELECT count(*) AS n, count_if(blocked) AS bad FROM train),
one AS (SELECT row, blocked, unnest(tokens) AS x FROM train),
sets AS (
  SELECT [x] AS tokens, blocked FROM one
  UNION ALL SELECT [a.x, b.x], a.blocked FROM one a JOIN one b ON a.row = b.row AND a.x < b.x
  UNION ALL SELECT [a.x, b.x, c.x], a.blocked FROM one a JOIN one b ON a.row = b.row AND a.x < b.x JOIN one c ON c.row = a.row AND b.x < c.x
), mined AS (
  SELECT tokens, count_if(blocked) / count(*) AS confidence FROM sets GROUP BY 1
  HAVING count_if(blocked) >= greatest(1, ceil(0.002 * (SELECT n FROM total))) AND count_if(blocked) / count(*) >= 0.6
     AND (count_if(blocked) / count(*)) / ((SELECT bad FROM total) / (SELECT n FROM total)) >= 1.2
), rules AS (
  SELECT * FROM mined m WHERE NOT EXISTS (SELECT 1 FROM mined k WHERE len(k.tokens) < len(m.tokens) AND list_has_all(m.tokens, k.tokens))
), fired AS (
  SELECT s.tokens, count(*) AS n_rules, max(r.confidence) AS confidence FROM (SELECT DISTINCT tokens FROM t) s
  JOIN rules r ON list_has_all(s.tokens, r.tokens) GROUP BY 1
), fixed AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM t,
    (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
            ('block', 'com', '/de/')) f(verdict, h, prefix), LATERAL (SELECT h || prefix AS rule) z
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) GROUP BY 1
)
SELECT t.page_id, host, path, fixed.rule, coalesce(fixed.verdict, CASE WHEN n_rules > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(n_rules, 0) AS BIGINT) AS n_rules, confidence
FROM t LEFT JOIN fired ON fired.tokens = t.tokens AND len(t.tokens) > 0 LEFT JOIN fixed ON fixed.page_id = t.page_id
"""
