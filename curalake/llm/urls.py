"""URL filter by association rules: FP-growth over URL tokens of labelled pages, rules matched by an inverted index.

A labelled page is a transaction of its URL's tokens and, if it is bad, the token ``BAD``. Frequent itemsets give
rules ``tokens -> BAD``, pruned by support and by confidence against the share of bad pages: a rule stays if its
confidence is ``lift`` times that share and lies ``deviations`` standard errors above it. Each rule is filed under its
rarest token; a URL meets the rules of its own tokens and matches those whose tokens it all has. Hosts named in a fixed
list are judged by it first.
Built-in functions and Spark's own FP-growth only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import attach, written

BAD = "bad"
#: Fixed values of the production query: (rule, verdict); a rule is a host and a path.
HOST_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
#: A rule's confidence over the share of bad pages, and its distance from that share in standard errors (one-sided, 1 %).
MIN_LIFT, MIN_DEVIATIONS = 1.25, 2.33
#: Least share of labelled pages, and least number of them, that hold all tokens of a rule.
MIN_SUPPORT, MIN_PAGES = 0.001, 20
#: Rows with one token set meet its verdict in this many parts.
PARTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. A rule fits its host and all subdomains, by prefix of the path."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its domains, path words (numbers as ``#``), file ending, names in the query."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = host_of(lower)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda k: F.concat(F.lit("d:"), F.concat_ws(".", F.slice(labels, -k, k))))
    words = F.filter(F.split(path_of(lower), "[/._-]"), lambda w: w != "")
    path = F.transform(words, lambda w: F.concat(F.lit("p:"), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))
    asked = F.filter(F.split(F.regexp_extract(lower, r"(?s)\?([^#]*)", 1), "&"), lambda p: p != "")
    names = F.transform(asked, lambda p: F.concat(F.lit("q:"), F.substring_index(p, "=", 1)))
    first = F.array(F.concat(F.lit("s:"), F.substring_index(lower, "://", 1)), F.concat(F.lit("l:"), F.element_at(labels, 1)))
    return F.when(F.instr(lower, "://") > 0, F.array_distinct(F.concat(first, domains, path, names))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, lift: float = MIN_LIFT, deviations: float = MIN_DEVIATIONS, support: float = MIN_SUPPORT, pages: int = MIN_PAGES) -> DataFrame:
    """``antecedent, confidence, support`` of rules for BAD from rows ``tokens, bad`` (boolean). Without bad pages, or with bad ones only, none."""
    spark = labelled.sparkSession
    empty = spark.sql("SELECT cast(null AS array<string>) AS antecedent, 0d AS confidence, 0d AS support WHERE false")
    items = labelled.filter(F.size("tokens") > 0).select("bad", F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    counts = items.agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("bad")).first()
    total, share = counts["total"], counts["bad"] / max(counts["total"], 1)
    least = max(support, pages / max(total, 1))
    if least > 1 or share in (0.0, 1.0):
        return empty
    confidence = min(1.0, lift * share)
    model = FPGrowth(itemsCol="items", minSupport=least * confidence, minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.array_contains("consequent", BAD))
    held = F.col("support") / F.col("confidence")  # share of pages with all tokens of the rule
    error = F.sqrt(F.lit(share * (1 - share)) / (held * total))
    kept = rules.filter((held * total >= least * total - 0.5) & (F.col("confidence") - share >= deviations * error))
    return kept.select("antecedent", "confidence", "support")


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = HOST_RULES, **pruning: float) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every row of ``pages``.

    ``labels`` has ``page_id, bad``. ``rule`` is the list's rule that decided, else null; then ``verdict`` is block if
    a mined rule matches (``confidence``: the highest such), else allow. A null url and one without ``://`` have empty
    host and path, no tokens, and are allowed unless a rule of the list fits. Repeated rows are judged alike.
    """
    rows = pages.select("page_id", "url", url_tokens(F.col("url")).alias("tokens"))
    marked = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")).filter("bad IS NOT NULL")
    labelled = written(rows.join(marked, "page_id").select("tokens", (F.col("bad") == 1).alias("bad")), "url-labelled")
    mined = mine_rules(labelled, **pruning)
    # the inverted index: a rule stands under its token that the fewest labelled pages have; one row per token
    frequency = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = mined.withColumn("rule_id", F.xxhash64("antecedent")).select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    rarest = filed.join(frequency, "token", "left").groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("antecedent").alias("antecedent"), F.max("confidence").alias("confidence")
    )
    index = written(rarest.groupBy("token").agg(F.collect_list(F.struct("antecedent", "confidence")).alias("rules")), "url-rules")
    # equal token sets are matched once; only tokens that rules are filed under go on
    distinct = rows.select("tokens").filter(F.size("tokens") > 0).distinct()
    met = attach(distinct.select("tokens", F.explode("tokens").alias("token")), index, ["token"], F.col("tokens"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.size(F.array_except(r["antecedent"], F.col("tokens"))) == 0), lambda r: r["confidence"]))
    hits = met.select("tokens", best.alias("confidence")).filter("confidence IS NOT NULL").groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    parts = hits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    listed = listed_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(parts, ["tokens", "part"], "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence")
    return judged.withColumn("_listed", listed).select(
        "page_id", "host", "path", F.col("_listed.rule").alias("rule"),
        F.coalesce("_listed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("_listed").isNull(), F.col("confidence")).alias("confidence"),
    )
