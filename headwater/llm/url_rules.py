"""Operator 3: URL filters by association rules. DataFrame and SQL operations only.

Rules come in two kinds. Given rules (host, path) decide first. For the other URLs, Spark's
FP-growth mines combinations of URL tokens that go with bad labels; rules pruned by support and
confidence are kept in an inverted index by token, and a URL is blocked if all tokens of a rule
are among its own.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import column, staged

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL), path


def given_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Longest of the given (verdict, host, path) rules that fits, as text and verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels of the host, segments of the path, names of arguments."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark + "="), p))

    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)))).otherwise(F.array())
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    tokens = F.concat(scheme, marked("host", F.split(host, r"\.")), marked("path", F.split(path, "/")), marked("arg", names))
    return F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))


def text_lines(text: Column) -> Column:
    """(hash, words) of the lines of a text that have words, blanks made one."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")))
    return F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.struct(
        F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("words")))


def html_text(html: Column) -> Column:
    """Text of a page, a line per stretch between two tags."""
    text = F.regexp_replace(html, r"<[^>]*>", "\n")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def label_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages that hold the text of a labelled document. ``labels`` has one (doc_id, bad) per document.

    A line stands for one document, a labelled one if there is any, so that a common line is one row.
    A page has the label of the document that has more than half of the words the page shares with documents.
    """
    each = docs.select("doc_id", F.explode(text_lines(F.col("text"))).alias("e")).select("doc_id", "e.line")
    known = each.join(labels, "doc_id", "left")
    owner = F.struct(F.col("bad").isNull().alias("unlabelled"), "doc_id", "bad")
    lines = known.groupBy("line").agg(F.min(owner).alias("owner")).select("line", "owner.*")
    held = pages.select("page_id", F.explode(text_lines(html_text(F.col("html")))).alias("e")).select("page_id", "e.*")
    shared = held.join(lines, "line").groupBy("page_id", "doc_id", "bad").agg(F.sum("words").alias("words"))
    best = shared.groupBy("page_id").agg(F.sum("words").alias("total"), F.max(F.struct("words", "doc_id", "bad")).alias("best"))
    found = best.where((2 * F.col("best.words") > F.col("total")) & F.col("best.bad").isNotNull())
    return pages.select("page_id", "url").join(found.select("page_id", F.col("best.bad").alias("bad")), "page_id").select("url", "bad")


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_rows: int = 20) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from rows (id, url, bad).

    All labelled rows are mined. Rare tokens cannot be in a rule and go first. Tokens that occur in
    exactly the same rows (a URL template) stand for one another, so one of them is mined; otherwise
    a template of n segments alone would have 2^n combinations. A rule is kept if it reaches both
    thresholds and no rule with a part of its tokens is as confident. Without labels there are no rules.
    """
    spark = labelled.sparkSession
    rows = staged(labelled.select(
        F.monotonically_increasing_id().alias("tid"), url_tokens(F.coalesce("url", F.lit(""))).alias("tokens"), F.col("bad"),
    ))
    total = rows.count()
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    least = max(min_rows, -int(-min_support * total // 1))
    if total < least:
        return none
    each = rows.select("tid", F.explode("tokens").alias("token"))
    frequent = (
        each.groupBy("token")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(7))).alias("y"))
        .where(F.col("n") >= least)
    )
    mined = staged(frequent.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"))
    found = each.join(mined, "token").groupBy("tid").agg(F.collect_list("token").alias("found"))
    known = F.coalesce("found", F.array().cast("array<string>"))
    items = rows.select("tid", "bad").join(found, "tid", "left").select(
        F.when(F.col("bad"), F.array_append(known, F.lit(BAD))).otherwise(known).alias("items")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence, numPartitions=parts).fit(items)
    rules = staged(
        model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    )
    # A rule falls if a shorter rule with a part of its tokens is as confident. Shorter rules are found by token.
    by_token = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.col("tokens")[0].alias("token"))
    covered = (
        rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(by_token, "token")
        .where((F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence")))
        .where(F.size(F.array_except("part", "tokens")) == 0).select("tokens").distinct()
    )
    kept = rules.join(covered, "tokens", "left_anti")
    return kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs of ``urls`` that a rule fits, with the most confident one: url, mined_rule, confidence.

    The index has a row per token and rule. Tokens of each distinct URL meet it by token, and the
    hits per URL and rule are counted; counting combines before the shuffle.
    """
    index = staged(rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("needed"), "confidence", "tokens"))
    tokens = urls.where(F.col("url").isNotNull()).select("url").distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hits = tokens.join(index, "token").groupBy("url", "rule_id", "needed", "confidence", "tokens").agg(F.count("*").alias("n"))
    best = hits.where(F.col("n") == F.col("needed")).groupBy("url").agg(
        F.max(F.struct("confidence", F.array_join("tokens", " ").alias("rule"))).alias("best")
    )
    return best.select("url", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: list[Rule], mined: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, mined_rule.

    A given rule decides; else a mined rule that fits blocks; else the page is allowed. A null URL,
    or one without ``://``, has an empty host and path and is allowed unless a mined rule fits.
    Repeated rows give a row each; other columns are not read.
    """
    rows = pages.select(column(key).alias(key), column(url).cast("string").alias("url"))
    address = F.coalesce("url", F.lit(""))
    host, path = host_and_path(address)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(matched_urls(rows, mined), "url", "left").withColumns({"host": host, "path": path})
    mined_verdict = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "mined_rule")
