"""URL filters: association rules of URL tokens, mined by FP-growth and matched through an inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.plans.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "label=block"
#: Rules up to which the index is broadcast (some hundred bytes each).
BROADCAST_RULES = 50_000
#: The hand-written rules, as verdict and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, labels of the host, segments of the path by place, ending, names in the query; empty for null."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    named = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{name}="), x))
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "(?s)^(.*?)://", 1))),
        named("host", F.filter(F.split(host(url), r"\."), lambda x: x != "")),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), x)),
        named("ending", F.filter(F.array(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)), lambda x: x != "")),
        named("query", F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", *, support: float = 0.002, least_rows: int = 20, confidence: float = 0.8, lift: float = 1.2) -> DataFrame:
    """Rules ``rule_id, antecedent, anchor, confidence, support`` by which a URL with all tokens of the antecedent is bad.

    ``labelled``: a URL and a boolean; rows with a null in either teach nothing. At every size a
    rule needs all of these: its tokens and the label meet in at least ``support`` of the rows and
    in ``least_rows`` of them (fewer prove nothing, however often they are bad), at least
    ``confidence`` of the rows with its tokens are bad, that is at least ``lift`` times the share
    of bad rows, and no rule of some of its tokens is as sure. At most 1 / ``support`` x tokens of
    a URL single tokens are frequent, which bounds what the driver sees, however many URLs there
    are. ``anchor`` is the rarest token of the antecedent, ties by name.
    """
    items = F.when(F.col(bad), F.array_append(tokens(F.col(url)), F.lit(BAD))).otherwise(tokens(F.col(url)))
    known = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(items.alias("items"))
    share = min(1.0, max(support, least_rows / max(1, known.count())))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(known)
    rules = stage(
        model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= lift))
        .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules",
    )
    parts = rules.select(F.col("antecedent").alias("small"), F.col("confidence").alias("as_sure"), F.element_at("antecedent", 1).alias("first"))
    larger = rules.withColumn("first", F.explode("antecedent"))
    implied = (F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("as_sure") >= F.col("confidence"))
    pruned = larger.join(parts, "first").where(implied).select("antecedent").distinct()
    kept = rules.join(pruned, "antecedent", "left_anti").withColumn("rule_id", F.array_join("antecedent", " "))
    often = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    anchors = kept.select("rule_id", F.explode("antecedent").alias("token")).join(often, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("least"))
    return kept.join(anchors, "rule_id").select("rule_id", "antecedent", F.col("least.token").alias("anchor"), "confidence", "support")


def matches(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``url, mined, sureness`` for every different URL that fits a rule: the surest rule, ties by support, then by text.

    Inverted index: a rule stands under its anchor, so a URL meets only the rules whose rarest
    token it has; it fits those of which it has all tokens.
    """
    index = stage(rules, "index")
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    seen = urls.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    hits = seen.select("url", "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    fit = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = fit.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule_id")).alias("best"))
    return best.select("url", F.col("best.rule_id").alias("mined"), F.col("best.confidence").alias("sureness"))


def ruled(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Labels for mining, ``url, bad``: what the hand-written rules say, of the rows that one fits."""
    verdict, _ = fitting_rule(host(F.col(url)), path(F.col(url)), rules)
    return pages.select(F.col(url).alias("url"), (verdict == "block").alias("bad")).where("bad is not null")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Verdict and text of the longest hand-written rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, as it is put outermost
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        verdict, text = F.when(fits, says).otherwise(verdict), F.when(fits, rule).otherwise(text)
    return verdict, text


def judge(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, **mining: float) -> DataFrame:
    """One row ``page_id, host, path, rule, verdict, mined`` for each row of pages.

    A hand-written rule has the first word; else a URL is blocked if it fits a mined rule
    (``mined``), and allowed if not. A null URL or one without ``://`` has an empty host and path
    and fits no hand-written rule; a null URL is allowed. Without labelled rows nothing is mined.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    found = matches(rows, mine(labelled, **mining))
    judged = rows.join(found, "url", "left")
    verdict, rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )
