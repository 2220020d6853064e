"""URL filtering by association rules.

A url's tokens are its host's labels and their hyphenated parts, its path's segments and its
query's names.  FP-growth mines token sets of labelled urls, each with its label
as one more item; rules `tokens -> label` are pruned by support, confidence and
lift, and a rule goes where one of a token less within it is as sure.  Rules meet urls
by an inverted index: a rule is posted under its rarest token only, and the other
tokens are verified in the row.

Declared rules (host and path prefix) come first; the longest that fits decides.

Defined results: host and path of a null url, or one without ://, are empty, and
no rule fits; a null id stays null; repeated rows get a row each; an empty table
gives no rows; without labels no rule is mined and all else is allowed.  Of rules that tie
in confidence one that blocks decides.  Urls of any length are read whole; columns other than
those named are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, shuffle_partitions

#: Declared rules (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BAD, GOOD = "label=block", "label=allow"


def host_column(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def declared(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest declared rule that fits; nulls else."""
    rule = verdict = None
    for how, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, how) if verdict is None else verdict.when(fits, how)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host labels and the parts of hyphenated ones, path segments, names of the query."""
    host, path = host_column(url), ascii_lower(path_column(url))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    tag = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    labels = F.split(host, r"\.")
    return F.array_distinct(
        F.concat(
            tag("host=", labels),
            # parts of hyphenated labels only: a whole label twice over would double every token set
            tag("word=", F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))),
            tag("path=", F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))),
            tag("query=", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        )
    )


def mine(labelled: DataFrame, least_support: float = 0.002, least_rows: int = 8, confidence: float = 0.8, lift: float = 1.2) -> DataFrame:
    """(verdict, antecedent, confidence, support, lift): pruned rules for blocking and for allowing, from rows (items, bad).

    FP-growth keeps its frequent items on the driver; least_support bounds them.
    """
    n = labelled.count()
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "verdict string, antecedent array<string>, confidence double, support double, lift double")
    support = max(least_support, least_rows / max(n, 1))
    if not n or support > 1:
        return empty
    rows = labelled.select(F.concat("items", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=shuffle_partitions(spark)).fit(rows)
    rules = model.associationRules.withColumn("verdict", F.when(F.col("consequent") == F.array(F.lit(BAD)), "block").when(F.col("consequent") == F.array(F.lit(GOOD)), "allow"))
    rules = rules.where(F.col("verdict").isNotNull() & (F.col("lift") >= lift))  # a row has one label, so no antecedent holds the other
    rules = settle(rules.select("verdict", F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift"))
    # a longer rule goes where one of one token less is as sure
    subsets = rules.where(F.size("antecedent") > 1).select(
        "verdict", "antecedent", "confidence", F.explode("antecedent").alias("left_out")
    ).select("verdict", "antecedent", F.col("confidence").alias("c"), F.array_remove("antecedent", F.col("left_out")).alias("subset"))
    within = rules.select("verdict", F.col("antecedent").alias("subset"), F.col("confidence").alias("shorter"))
    spent = subsets.join(within, ["verdict", "subset"]).where(F.col("shorter") >= F.col("c")).select("verdict", "antecedent").distinct()
    return rules.join(spent, ["verdict", "antecedent"], "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, confidence, matched, how) of rows (row, items) that at least one rule fits: the surest one, of equal ones one that blocks, then the last by name."""
    posted = rules.select("verdict", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    index = settle(posted)
    wanted = index.select("token").distinct()
    seen = urls.select("row", "items", F.explode("items").alias("token"))
    frequency = seen.groupBy("token").count()
    rare = index.join(wanted.join(frequency, "token"), "token")
    posting = rare.groupBy("verdict", "antecedent", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    hits = seen.join(posting, "token").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", F.col("verdict").alias("how"), F.array_join("antecedent", " ").alias("name")))
    return hits.groupBy("row").agg(best.alias("b")).select("row", F.col("b.confidence").alias("confidence"), F.col("b.name").alias("matched"), F.col("b.how").alias("how"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched, confidence).

    Rules are mined from labels (doc_id, quality, toxic) only, which speak of the page
    with that id: low quality or toxic is to be blocked.  Declared verdicts are no labels:
    they would give the declared rules again, for pages that these don't cover.  Urls are judged once each and joined back.
    """
    url = F.col("url").cast("string")
    distinct = settle(pages.select(url.alias("url")).distinct().select("url", tokens(url).alias("items")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = pages.select("page_id", tokens(url).alias("items")).join(marks, F.col("page_id") == F.col("l_id")).where(F.col("bad").isNotNull())
    mined = mine(known.select("items", (F.col("bad") == 1).alias("bad")), **how)
    found = match(distinct.select(F.col("url").alias("row"), "items"), mined)
    host, path = host_column(url), path_column(url)
    rule, verdict = declared(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path")).join(found, F.col("url") == F.col("row"), "left")
    by_method = F.coalesce("how", F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "matched", "confidence")
