"""Edge policy as log analytics: rate bans, injection flags, first matching rule.

The pattern lists are this library's own; the policy names only opaque rule sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.columns import epoch

RATE_LIMIT, RATE_SECONDS, BAN_SECONDS = 600, 60, 300

SQLI_PATTERNS = (
    r"(?i)\bunion\b\s+(all\s+)?\bselect\b",
    r"(?i)'\s*(or|and)\s+['0-9a-z]+\s*=\s*['0-9a-z]+",
    r"(?i);\s*(drop|delete|insert|update|alter)\b",
    r"(?i)\b(sleep|benchmark)\s*\(",
)
XSS_PATTERNS = (
    r"(?i)<\s*script\b",
    r"(?i)\bon(error|load|click|mouseover)\s*=",
    r"(?i)javascript\s*:",
)

# The policy's rules by ascending priority.
DEFAULT_PRIORITY = 2147483647
POLICY = (
    (500, "rate_based_ban", "deny(429)"),
    (600, "sqli", "deny(403)"),
    (601, "xss", "deny(403)"),
    (1000, "allow_all", "allow"),
    (DEFAULT_PRIORITY, "default", "allow"),
)


def decoded(path: Column | str) -> Column:
    """URL-decoded text, or the raw text where an escape is malformed."""
    col = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.try_url_decode(col), col)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return F.coalesce(hit, F.lit(False))


def is_sqli(path: Column | str) -> Column:
    return matches_any(decoded(path), SQLI_PATTERNS)


def is_xss(path: Column | str) -> Column:
    return matches_any(decoded(path), XSS_PATTERNS)


def slot(ts: Column | str, seconds: int) -> Column:
    return F.floor(epoch(ts) / seconds)


def rate_bans(requests: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, ban: int = BAN_SECONDS, client: str = "src_ip") -> DataFrame:
    """(client, window, requests, ban_from, ban_until) for every exceeded window."""
    counted = (
        requests.where(F.col(client).isNotNull()).groupBy(client, slot("ts", seconds).alias("slot")).agg(F.count(F.lit(1)).alias("requests"))
    )
    start = F.timestamp_seconds((F.col("slot") + 1) * seconds)
    return counted.where(F.col("requests") > limit).select(
        client, "slot", "requests", start.alias("ban_from"), (start + F.expr(f"interval {ban} seconds")).alias("ban_until")
    )


def mark_banned(requests: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, ban: int = BAN_SECONDS, client: str = "src_ip") -> DataFrame:
    """Requests with ``banned``: sent while a ban of their client was running.

    Bans start on slot borders, so within one slot their union is one span. It is
    kept once per (client, slot) and joined on both, which spreads a hot client
    over its slots and gives each request at most one match.
    """
    bans = rate_bans(requests, limit, seconds, ban, client)
    last = F.ceil(F.lit(ban) / F.lit(float(seconds))).cast("int")
    spans = (
        bans.select(client, F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + last)).alias("slot"), "ban_until")
        .groupBy(client, "slot")
        .agg(F.max("ban_until").alias("ban_until"))
    )
    marked = requests.withColumn("slot", slot("ts", seconds)).join(spans, [client, "slot"], "left")
    return marked.withColumn("banned", F.coalesce(F.col("ts") < F.col("ban_until"), F.lit(False))).drop("slot", "ban_until")


def first_match(marked: DataFrame, path: str = "path", conform_is_final: bool = False) -> DataFrame:
    """The policy rule that decides each request.

    ``conform_is_final=True`` lets a client inside its rate limit pass at the rate
    rule without looking at later rules; by default those rules are still tried.
    """
    tests = {"rate_based_ban": F.col("banned"), "sqli": is_sqli(path), "xss": is_xss(path), "allow_all": F.lit(True), "default": F.lit(True)}

    def outcome(priority: int, rule: str, action: str) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))

    # one chain that yields the whole outcome, so no test runs more than once
    chain = None
    for priority, rule, action in POLICY:
        chain = (F if chain is None else chain).when(tests[rule], outcome(priority, rule, action))
        if rule == "rate_based_ban" and conform_is_final:
            chain = chain.otherwise(outcome(priority, rule, "allow"))
            break
    return marked.withColumn("_match", chain).select(*marked.columns, "_match.priority", "_match.rule", "_match.action")
