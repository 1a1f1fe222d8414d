"""The page's own health: did it load, what did it answer, how did it get there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import let
from ...functions.texts import is_blank, join_lines, trim_space
from .common import explode_issues, found_on, issue, issues_when

CHECK = "http-status"

# How titles of bot-protection pages start.
CHALLENGE_TITLES = (
    "just a moment", "attention required", "checking your browser", "access denied",
    "verify you are human", "verifying you are human", "security check",
)


def is_rate_limited(status: Column) -> Column:
    return status == 429


def detect_block(status: Column, title: Column) -> Column:
    """``struct<kind, evidence>`` when the site refused us, else NULL.

    A 429 says so itself. A 403 or 503 counts only with the title of a known challenge
    page; any other stays the error it is.
    """
    def verdict(t: Column) -> Column:
        challenge = t.rlike("(?i)^(" + "|".join(CHALLENGE_TITLES) + ")")
        code = status.cast("string")
        limited = F.struct(
            F.lit("rate-limited").alias("kind"),
            F.when(t == "", F.lit("HTTP 429")).otherwise(
                F.concat(F.lit('HTTP 429, page titled "'), t, F.lit('"'))).alias("evidence"))
        bot = F.struct(
            F.lit("bot-challenge").alias("kind"),
            F.concat(F.lit("HTTP "), code, F.lit(', bot-protection interstitial titled "'), t,
                     F.lit('"')).alias("evidence"))
        return F.when(is_rate_limited(status), limited).when(
            status.isin(403, 503) & challenge, bot)

    return let(trim_space(F.coalesce(title, F.lit(""))), verdict)


def block_verdict() -> Column:
    return detect_block(F.col("status"), F.col("dom.title"))


def is_blocked() -> Column:
    """Cheap form of ``block_verdict() IS NOT NULL``."""
    title = trim_space(F.coalesce(F.col("dom.title"), F.lit("")))
    return F.coalesce(
        is_rate_limited(F.col("status"))
        | (F.col("status").isin(403, 503)
           & title.rlike("(?i)^(" + "|".join(CHALLENGE_TITLES) + ")")),
        F.lit(False))


def blocked_issue(verdict: Column) -> Column:
    limited = verdict["kind"] == "rate-limited"
    code = F.col("status").cast("string")
    attempts = F.coalesce(F.col("attempts"), F.lit(1))
    advice = F.when(
        limited, "we were asked to slow down — lower concurrency for this site, then re-run"
    ).otherwise("anti-bot protection, not a site defect — but nothing on this page was checked")
    retried = F.when(attempts > 1, F.concat(
        F.lit("still blocked after "), attempts.cast("string"), F.lit(" attempts")))
    return issue(
        CHECK, "warning", "page-blocked",
        F.concat(F.when(limited, "Blocked by rate limiting (").otherwise(
            "Blocked by bot protection ("), code, F.lit(") — page not checked")),
        detail=join_lines(verdict["evidence"], retried, advice, found_on()))


def unread_issue(with_source: bool = True) -> Column:
    return issue(
        CHECK, "error", "dom-extraction-failed",
        "Could not read the page DOM — every content check was skipped for this page",
        detail=join_lines(F.col("domError"), found_on()) if with_source else F.col("domError"))


def http_status_issues(cfg: AuditConfig) -> Column:
    status, chain = F.col("status"), F.col("redirectChain")
    code = status.cast("string")
    hops = F.coalesce(F.array_size(chain), F.lit(0))
    route = F.concat_ws(" -> ", chain, F.col("finalUrl"))
    final = F.concat(F.lit("final URL: "), F.col("finalUrl"))
    returned = F.concat(F.lit("Page returned "), code)
    failed = issue(
        CHECK, "error", "navigation-failed",
        F.concat(F.lit("Page failed to load: "), F.col("navigationError")),
        detail=join_lines(
            F.concat(F.lit("after "), F.col("loadMs").cast("string"), F.lit("ms")), found_on()))
    ordinary = issues_when(
        (~is_blank(F.col("domError")), unread_issue()),
        (status >= 500, issue(CHECK, "error", "server-error", returned,
                              detail=join_lines(final, found_on()))),
        ((status >= 400) & (status < 500),
         issue(CHECK, "error", "client-error", returned, detail=join_lines(final, found_on()))),
        (hops > cfg.setting("maxRedirectHops"),
         issue(CHECK, "warning", "long-redirect-chain",
               F.concat(hops.cast("string"), F.lit(" redirect hops before reaching the page")),
               where="redirect-chain", detail=join_lines(route, found_on()))),
        ((hops > 0) & (status >= 400),
         issue(CHECK, "error", "redirect-to-error",
               F.concat(F.lit("Redirect chain ends in "), code),
               where="redirect-chain", detail=join_lines(route, found_on()))),
    )
    return F.when(~is_blank(F.col("navigationError")), F.array(failed)).otherwise(
        F.when(is_blocked(), F.array(blocked_issue(block_verdict()))).otherwise(ordinary))


def check_http_status(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, http_status_issues(cfg))
