"""URL filters: hand-written rules, and association rules that FP-growth mines from the pages those judge.

A page's URL is a set of tokens: scheme, host labels, path words, file ending, query keys. Pages with a
hand-written rule carry its verdict as one more item. Frequent combinations that imply a verdict with enough
confidence become rules for the other pages, which find them through an index by each rule's rarest token.
Everything runs on DataFrame functions.

Defined cases: a null URL, or one without `://`, has an empty host and path, no tokens, and the default
verdict; repeated rows and repeated URLs are judged alike; without labelled pages there are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewledger.llm.frames import settled

# Verdict and rule: a host with all its subdomains, and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"
# Share of the labelled pages a combination must occur in, and of its pages that must agree.
SUPPORT, CONFIDENCE = 0.01, 0.75
# A path word that may be a token: letters of any script, digits, marks; a bare number only names one page.
PATH_WORD = r"^(?![0-9]+\z)[^\x09-\x0D\x20.]+\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: str) -> Column:
    """What follows the first `://`; empty without one."""
    return F.expr(f"coalesce(if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), ''), '')")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens_of(url: str, rest: Column) -> Column:
    """The distinct tokens of a URL, each with its part in front."""
    host, path = host_of(rest), path_of(rest)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark + ":"), x))

    scheme = F.translate(F.substring_index(F.coalesce(F.col(url), F.lit("")), "://", 1), UPPER, LOWER)
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda x: x.rlike(PATH_WORD))
    ending = F.regexp_extract(F.translate(path, UPPER, LOWER), r"\.([a-z]{1,5})$", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    found = F.concat(marked("s", F.array(scheme)), marked("h", F.split(host, r"\.")), marked("p", words), marked("e", F.array(ending)), marked("q", keys))
    return F.when(rest != "", F.array_distinct(found)).otherwise(F.expr("cast(array() as array<string>)"))


def fitting(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest hand-written rule that fits `host` and `path`, as (rule, verdict)."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support) of association rules of any length, from rows (tokens, verdict)."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("=:"), "verdict"))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    return rules.filter(F.col("consequent")[0].startswith("=:")).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 3, 1000).alias("verdict"), "confidence", "support")


def judged(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT, support: float = SUPPORT,
    confidence: float = CONFIDENCE, id_column: str = "page_id", url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every page."""
    read = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url")).withColumn("rest", rest_of("url"))
    parts = read.select("page_id", "url", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), tokens_of("url", F.col("rest")).alias("tokens"))
    parts = parts.withColumn("own", fitting(rules))
    labelled = parts.filter("own is not null").select("tokens", F.col("own.verdict").alias("verdict"))
    others = parts.filter("own is null and size(tokens) > 0").select("url", "tokens").distinct()
    if labelled.isEmpty():
        best = others.select("url", F.lit(None).cast("struct<verdict: string, name: string>").alias("best"))
    else:
        best = best_rules(others, settled(mined(labelled, support, confidence)), settled(labelled))
    found = parts.join(best.withColumnRenamed("url", "judged_url"), F.col("url") == F.col("judged_url"), "left")
    return found.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("own").isNull(), F.col("best.verdict")), F.lit(default)).alias("verdict"),
        F.when(F.col("own").isNull(), F.col("best.name")).alias("mined_rule"))


def best_rules(urls: DataFrame, rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """(url, best) for URLs that a mined rule matches: the surest, then most frequent, then shortest, then first by name."""
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rules = rules.withColumn("name", F.concat_ws(" ", "tokens"))
    rarest = rules.select("name", F.explode("tokens").alias("token")).join(often, "token").groupBy("name").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"))
    index = rules.join(rarest, "name")
    seen = urls.select("url", F.col("tokens").alias("has"), F.explode("tokens").alias("token"))
    hits = seen.join(index, "token").filter("size(array_except(tokens, has)) = 0")
    order = F.struct(F.col("confidence"), F.col("support"), (-F.size("tokens")).alias("short"))
    top = hits.groupBy("url").agg(F.max(order).alias("top"))
    chosen = F.struct("name", "verdict")
    return hits.withColumn("order", order).join(top, "url").filter("order = top").groupBy("url").agg(F.min(chosen).alias("first")).select(
        "url", F.struct(F.col("first.verdict").alias("verdict"), F.col("first.name").alias("name")).alias("best"))
