"""URL filtering by host rules and by association rules mined from labels, in DataFrame operations only.

A url becomes a set of tokens (scheme, host labels, suffix, path words, depth, query keys). FP-growth over
the labelled urls mines token combinations that imply a verdict. Rules are kept if their support and
confidence reach their bounds, if the verdict is more frequent with them than without (lift over 1), and if
no rule of fewer of their tokens is at least as confident. What such a rule cannot hold is left out before
mining, which keeps urls of many words from having two to that power of combinations: tokens of one verdict
only are rules by themselves, tokens of all urls tell nothing, and of tokens that are in just the same urls one
stands for all (a rule asks for any of them).

Kept rules form an inverted index by the rarest token of each; a url that has it is verified to have the
rule's other tokens. The most confident match decides, then the most supported, then the one of more tokens,
then the last by name.

Edge cases: a null url, or one without ``://``, has empty host and path and no token but its depth.
Where no rule matches, the verdict is the default. Rows with null labels teach nothing; without labels
there are no rules. Urls of any length are read whole. An empty table has an empty result. Repeated rows, null
ids and extra columns pass through, but for columns named like the added ones, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: An index of rules, or a table of frequent tokens, up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 20_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of the rules (host, path, verdict) that fits, else null.

    A rule fits its host and that host's subdomains, where the path starts with the rule's. The rules
    are the caller's own list, so they are literals of the plan, found by each of the host's suffixes.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host, []).append((rule_path, verdict))
    entry = lambda h, p, v: F.struct(
        F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    pairs = [x for h, own in by_host.items() for x in (F.lit(h), F.array(*(entry(h, p, v) for p, v in own)))]
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(F.create_map(*pairs), s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(known, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def tokens_of(url: Column) -> Column:
    """The url's tokens, sorted and distinct. Digits are folded, so that page numbers make no tokens."""
    host, path = host_of(url), path_of(url)
    prefixed = lambda p, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    fold = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", "0")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    every = F.concat(
        prefixed("scheme:", F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        prefixed("host:", F.split(fold(host), r"[.\-]", -1)),
        prefixed("suffix:", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        prefixed("path:", F.split(fold(path), r"[/.\-_]", -1)),
        prefixed("query:", keys),
        F.array(F.concat(F.lit("depth:"), F.size(F.split(path, "/", -1)).cast("string"))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array(F.lit("depth:1")))


def _checked(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.6, min_count: int = 20) -> DataFrame:
    """(rule, verdict, tokens, confidence, lift, support, slots, rarest) from rows (url, verdict). Each token is one of
    its slot, an array of tokens that are in the same urls; rarest is the slot in the fewest urls.

    A combination has to be in ``min_support`` of the labelled rows and in ``min_count`` of them."""
    rows = labelled.where("verdict is not null").select(tokens_of(F.col("url")).alias("tokens"), "verdict", F.monotonically_increasing_id().alias("id"))
    rows = staged(rows, "url-labelled")
    total = rows.count()
    least = max(1, math.ceil(max(min_support * total, min(min_count, total)) - 1e-9))
    shares = F.broadcast(rows.groupBy("verdict").agg((F.count(F.lit(1)) / max(1, total)).alias("share")))  # one row a verdict
    # Tokens with equal counts and equal sums of their rows' hashes are in the same rows.
    print_ = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    tokens = rows.select("id", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("verdict").alias("lo"), F.max("verdict").alias("hi"), print_.alias("print")).where(F.col("n") >= least)
    tokens = staged(tokens, "url-tokens")
    kept = ["rule", "verdict", "tokens", "confidence", "lift", "support", "slots", "rarest"]
    alone = tokens.where("lo = hi").join(shares, F.col("lo") == F.col("verdict")).where((F.col("share") < 1) & F.lit(min_confidence <= 1))
    alone = alone.select(
        F.col("token").alias("rule"), "verdict", F.array("token").alias("tokens"), F.lit(1.0).alias("confidence"), (1 / F.col("share")).alias("lift"),
        (F.col("n") / max(1, total)).alias("support"), F.array(F.array("token")).alias("slots"), F.array("token").alias("rarest"))
    slots = tokens.where((F.col("lo") != F.col("hi")) & (F.col("n") < total)).groupBy("print", "n").agg(
        F.sort_array(F.collect_set("token")).alias("slot")).select("slot", "n", F.col("slot")[0].alias("token"))  # as long as a url at most
    slots = staged(slots, "url-slots")
    found = rows.select("id", F.explode("tokens").alias("token")).join(_checked(slots.select("token")), "token")
    found = found.groupBy("id").agg(F.collect_set("token").alias("own"))
    items = rows.select("id", "verdict").join(found, "id", "left").select(
        F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    items = staged(items, "url-items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / max(1, total))), minConfidence=min_confidence).fit(items)
    mined = model.associationRules.where("lift > 1 and size(consequent) = 1 and consequent[0] like '=%' and not exists(antecedent, x -> x like '=%')")
    rules = mined.select(F.array_sort("antecedent").alias("tokens"), F.regexp_replace(F.col("consequent")[0], "^=", "").alias("verdict"), "confidence", "lift", "support")
    rules = staged(rules.withColumn("rule", F.array_join("tokens", " ")), "url-mined")
    # A rule of more tokens has to be more confident than every rule of all its tokens but one.
    fewer = F.explode(F.transform("tokens", lambda x: F.array_join(F.array_remove(F.col("tokens"), x), " ")))
    shorter = rules.select(F.col("rule").alias("longer"), "verdict", "confidence", fewer.alias("rule"))
    plain = rules.select("rule", "verdict", F.col("confidence").alias("plain"))
    worse = shorter.join(plain, ["rule", "verdict"]).where("plain >= confidence").select(F.col("longer").alias("rule"), "verdict").distinct()
    rules = rules.join(worse, ["rule", "verdict"], "left_anti")
    of_rule = rules.select("rule", "verdict", F.explode("tokens").alias("token")).join(slots, "token").groupBy("rule", "verdict").agg(
        F.collect_list("slot").alias("slots"), F.min_by("slot", F.struct("n", "token")).alias("rarest"))
    return alone.select(*kept).unionByName(rules.join(of_rule, ["rule", "verdict"]).select(*kept))


def judged_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, found): the verdict of each distinct token set (set, tokens) that a rule matches."""
    index = rules.select(F.explode("rarest").alias("token"), "rule", "slots", "verdict", "confidence", "support")
    rows = sets.select("set", "tokens", F.explode("tokens").alias("token"))
    has_all = F.forall("slots", lambda slot: F.arrays_overlap(slot, F.col("tokens")))
    matches = rows.join(_checked(index), "token").where(has_all)
    best = F.max_by(F.struct("rule", "verdict", "confidence"), F.struct("confidence", "support", F.size("slots"), "rule"))
    return matches.groupBy("set").agg(best.alias("found"))


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, url: str = "url", default: str = ALLOW,
             min_support: float = 0.01, min_confidence: float = 0.6, min_count: int = 20) -> DataFrame:
    """pages with host, path, rule, verdict, mined (the association rule that decided, if one did) added."""
    mined = staged(mine_rules(labelled, min_support, min_confidence, min_count), "url-rules")
    tokens = tokens_of(F.col(url))
    # Urls with equal tokens are judged once.
    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "__set": F.sha2(F.array_join(tokens, " "), 256)})
    sets = pages.select(tokens.alias("tokens")).groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("set")).agg(F.any_value("tokens").alias("tokens"))
    found = judged_sets(sets, mined).withColumnsRenamed({"set": "__set", "found": "__found"})
    rows = rows.join(found, "__set", "left").withColumn("__rule", matched_rule(F.col("host"), F.col("path"), rules))
    return rows.withColumns({
        "rule": F.col("__rule.rule"),
        "verdict": F.coalesce("__rule.verdict", "__found.verdict", F.lit(default)),
        "mined": F.when(F.col("__rule").isNull(), F.col("__found.rule")),
    }).drop("__set", "__found", "__rule")
