"""URL filters: fixed host and path rules first, association rules mined from labels for the rest.

Spark's FP-growth finds the token combinations of badly labelled URLs, whole addresses included. A combination that reaches the support and the confidence asked
for becomes a rule, unless part of it already is one. Rules are filed under their rarest token; a URL looks up its own tokens and
verifies what it finds, so it meets few rules. Both sides work on distinct token sets, so a very common host costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.llm.common import saved

#: Rules up to this number are sent to every task; beyond it they are joined by shuffle.
BROADCAST_RULES = 100_000
#: Copies of one token set that a task writes.
LOT = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both are empty for a null or a text without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: all labels of the host, parts of the path and names of the query, each with its place's mark."""
    filled = lambda a: F.filter(a, lambda x: x != "")
    labels, parts = filled(F.split(host, "[.]")), filled(F.split(path, "/"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*[?]([^#]*)", 1)
    names = filled(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)))
    mark = lambda a, sign: F.transform(a, lambda x: F.concat(F.lit(sign), x))
    return F.array_sort(F.array_distinct(F.concat(mark(labels, "h:"), mark(parts, "p:"), mark(names, "q:"))))


def mined_rules(labelled: DataFrame, confidence: float, pages: int = 20) -> DataFrame:
    """rule (sorted array of tokens), confidence, support; ``labelled`` has tokens and bad (boolean). Rows without tokens don't count.

    A rule is seen on ``pages`` bad rows at least, the same at every size. Tokens on fewer bad rows are in no rule and
    go first; a token that is a rule alone goes too, as wider rules add nothing. Only what bad rows hold is combined then.
    """
    rows = labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    rows = saved(rows.withColumn("id", F.xxhash64("tokens")), "transactions")
    number = rows.agg(F.sum("n")).first()[0] or 0
    each = rows.select("id", "n", "n_bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.sum("n").alias("all"), F.sum("n_bad").alias("bad")).where(F.col("bad") >= pages)
    seen = saved(seen.withColumn("alone", F.col("bad") / F.col("all") >= confidence), "frequent")
    single = seen.where("alone").select(F.array("token").alias("rule"), (F.col("bad") / F.col("all")).alias("confidence"), (F.col("bad") / number).alias("support"))
    left = each.join(seen.where("not alone").select("token"), "token").groupBy("id").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"), F.array_sort(F.collect_set("token")).alias("items"))
    left = saved(left, "left")
    # one row for each bad page again; a set that very many pages share is dealt to many tasks first
    lots = left.where("n_bad > 0").select("items", "n_bad", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bad") - 1) / LOT))).alias("lot")).repartition("lot", "items")
    copies = F.least(F.lit(LOT), F.col("n_bad") - F.col("lot") * LOT).cast("int")
    bad = saved(lots.select("items", F.explode(F.sequence(F.lit(1), copies))).select("items"), "bad")
    n_bad = bad.count()
    if n_bad < pages:
        return single
    sets = FPGrowth(itemsCol="items", minSupport=pages / n_bad * (1 - 1e-12)).fit(bad).freqItemsets.where(F.size("items") > 1)
    sets = saved(sets.select(F.array_sort("items").alias("rule"), F.col("freq").alias("bad")), "itemsets")
    counted = sets.select("rule", "bad", F.explode("rule").alias("token")).join(seen.select("token", "all"), "token")
    counted = counted.groupBy("rule", "bad").agg(F.min_by("token", F.struct("all", "token")).alias("token"))
    met = left.select("n", "items", F.explode("items").alias("token")).join(counted, "token").where(F.size(F.array_except("rule", "items")) == 0)
    share = F.col("bad") / F.sum("n")
    wide = met.groupBy("rule", "bad").agg(share.alias("confidence")).where(F.col("confidence") >= confidence)
    found = saved(single.unionByName(wide.select("rule", "confidence", (F.col("bad") / number).alias("support"))), "rules")
    # a rule that holds another one whole adds nothing
    parts = found.select("rule", F.explode("rule").alias("token")).alias("b")
    smaller = found.select(F.col("rule").alias("part")).withColumn("token", F.col("part")[0]).alias("a")
    wider = smaller.join(parts, "token").where((F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0)).select("rule").distinct()
    return found.join(wider, "rule", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, matched_rule, matched_confidence of the distinct token sets that meet a rule: the most confident, then the first by its tokens."""
    rules = saved(rules, "kept-rules")
    seen = rules.select(F.explode("rule").alias("token")).distinct().join(sets.select(F.explode("tokens").alias("token")).groupBy("token").count(), "token", "left")
    rare = rules.select("rule", "confidence", F.explode("rule").alias("token")).join(seen, "token").groupBy("rule", "confidence").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = saved(rare, "index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule")).alias("best"))
    return best.select("tokens", F.array_join("best.rule", " ").alias("matched_rule"), (-F.col("best.c")).alias("matched_confidence"))


def judged_urls(pages: DataFrame, labels: DataFrame, fixed: list[tuple[str, str, str]], confidence: float = 0.7, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, matched_rule, matched_confidence of every row of ``pages``.

    ``fixed`` lists (verdict, host, path): such a rule fits its host and all subdomains where the path starts with the rule's, and the longest
    wins. Without one, a URL is blocked if a mined rule meets it, else allowed. ``labels`` has an id as ``pages`` and bad (null: not
    labelled); several labels of an id count as bad if any is. A null URL has no tokens and is allowed. Repeated rows come back as given.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = saved(rows.withColumn("tokens", tokens(url, F.col("host"), F.col("path"))), "urls")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, start in sorted(fixed, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is tried first
        fits = ((F.col("host") == where) | F.col("host").endswith("." + where)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, where + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    known = labels.where("bad is not null").groupBy(F.col("id").alias("page_id")).agg(F.max("bad").alias("bad"))
    rules = mined_rules(rows.join(known, "page_id").select("tokens", "bad"), confidence)
    hit = matched(rows.select("tokens").distinct(), rules)
    out = rows.join(hit, "tokens", "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("matched_rule").isNotNull(), "block").otherwise("allow")))
    return out.select("page_id", "host", "path", "rule", "verdict", "matched_rule", "matched_confidence")
