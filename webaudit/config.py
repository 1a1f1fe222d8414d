"""What a run looks for: thresholds, host lists and scopes.

One ``AuditConfig`` holds the policy of a run. A table of per-site overrides can be attached
to the captures (``operators.sites.attach_site_config``); ``AuditConfig.setting`` then reads
the site's value and falls back to the policy's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.urls import host_of

# --- fixed values -------------------------------------------------------------------------

ALL_CHECKS = (
    "http-status", "console-errors", "forbidden-hosts", "seo", "links", "mixed-content",
    "images", "accessibility", "llms-txt", "cross-page", "consent-banner",
)
FORBIDDEN_HOSTS = ("*.ngrok.io", "*.ngrok-free.app")
LOCALHOST_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "*.local")
IGNORE_PATTERNS = (
    "mailto:", "tel:", "javascript:", "#", "/cdn-cgi/", ".pdf", ".zip", ".dmg", ".exe",
)
TRACKING_HOSTS = (
    "fonts.googleapis.com", "fonts.gstatic.com", "bat.bing.net", "google-analytics.com",
    "googletagmanager.com", "googleadservices.com", "doubleclick.net", "facebook.net",
    "facebook.com/tr", "connect.facebook.net", "hotjar.com", "clarity.ms", "linkedin.com/px",
    "px.ads.linkedin.com", "snap.licdn.com", "analytics.tiktok.com", "reddit.com/rp.gif",
    "t.co/i/adsct",
)
BOT_HOSTILE_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "tiktok.com",
    "reddit.com",
)
KNOWN_LOCALES = ("en", "es", "de", "en-us")

# Settings a per-site table may override, with the type each column has there.
SITE_SETTINGS = {
    "baseUrl": "string",
    "titleMin": "int", "titleMax": "int", "descriptionMin": "int", "descriptionMax": "int",
    "slowLinkMs": "bigint", "maxRedirectHops": "int", "maxPages": "int", "maxDepth": "int",
}
SEO_SETTINGS = ("titleMin", "titleMax", "descriptionMin", "descriptionMax")


@dataclass(frozen=True)
class CustomCheck:
    """A check written by the caller.

    ``fn(captures, link_status)`` returns issue rows, best with the ``site`` and ``seq`` of their
    page, or ``fn`` is a Column that yields an array of issue structs for one capture. ``rules``
    maps each rule it emits to ``(priority, category, rationale)``.
    """

    id: str
    fn: Callable[[DataFrame, DataFrame | None], DataFrame] | Column
    rules: dict[str, tuple[str, str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class AuditConfig:
    baseUrl: str | None = None  # None: each capture's own site
    locales: Sequence[str] = ()
    knownLocales: Sequence[str] = KNOWN_LOCALES
    includePaths: Sequence[str] = ()
    excludePaths: Sequence[str] = ()
    extraSitemaps: Sequence[str] = ()
    maxPages: int | None = 10_000  # None: no cap
    maxDepth: int = 5
    respectRobots: bool = True
    blockedRetries: int = 2
    rateLimitBackoffMs: int = 10_000
    maxRateLimitBackoffMs: int = 60_000
    forgetMs: int = 300_000
    forbiddenHosts: Sequence[str] = FORBIDDEN_HOSTS
    localhostHosts: Sequence[str] = LOCALHOST_HOSTS
    ignorePatterns: Sequence[str] = IGNORE_PATTERNS
    trackingHosts: Sequence[str] = TRACKING_HOSTS
    botHostileHosts: Sequence[str] = BOT_HOSTILE_HOSTS
    checks: Sequence[str] | None = None  # None: every builtin and every custom check
    disabledChecks: Sequence[str] = ()
    customChecks: Sequence[CustomCheck] = ()
    rules: Sequence[str] = ()
    priorities: Sequence[str] = ()
    categories: Sequence[str] = ()
    failOn: str = "error"
    runName: str = ""
    titleMin: int = 10
    titleMax: int = 70
    descriptionMin: int = 50
    descriptionMax: int = 160
    slowLinkMs: int = 15_000
    maxRedirectHops: int = 2
    perSite: bool = False  # captures carry a siteConfig column

    def with_(self, **changes: Any) -> AuditConfig:
        return replace(self, **changes)

    def setting(self, name: str) -> Column:
        """A threshold as a column: the site's own value, else this policy's."""
        default = F.lit(getattr(self, name)).cast(SITE_SETTINGS[name])
        if self.perSite:
            return F.coalesce(F.col(f"siteConfig.{name}"), default)
        return default

    def base_url(self) -> Column:
        """Base URL of the audited site, for a row that has a ``site`` column."""
        own = F.concat(F.lit("https://"), F.col("site"))
        return F.coalesce(self.setting("baseUrl"), own) if (self.perSite or self.baseUrl) else own

    def own_host(self) -> Column:
        if not self.perSite and self.baseUrl is None:
            return F.col("site")
        return host_of(self.base_url())

    def enabled_checks(self) -> list[str]:
        """Allow-list, then custom checks, minus the deny-list. Raises on a bad policy."""
        problem = self.problem()
        if problem:
            raise ValueError(problem)
        custom = [c.id for c in self.customChecks]
        ids = list(self.checks) if self.checks is not None else [*ALL_CHECKS, *custom]
        return [c for c in ids if c not in self.disabledChecks]

    def problem(self) -> str | None:
        """Why this policy cannot give a meaningful run, or None."""
        for pattern in (*self.forbiddenHosts, *self.localhostHosts):
            if not pattern.replace("*", "").replace(".", ""):
                return f"Host pattern '{pattern}' matches every host"
        custom = [c.id for c in self.customChecks]
        for name in custom:
            if name in ALL_CHECKS:
                return f"Custom check id '{name}' collides with a builtin check"
        known = {*ALL_CHECKS, *custom}
        chosen = list(self.checks) if self.checks is not None else [*ALL_CHECKS, *custom]
        unknown = [c for c in chosen if c not in known]
        if unknown:
            return f"Unknown check(s): {', '.join(unknown)}"
        unknown = [c for c in self.disabledChecks if c not in known]
        if unknown:
            return f"Unknown disabled check(s): {', '.join(unknown)}"
        if self.disabledChecks and not [c for c in chosen if c not in self.disabledChecks]:
            return "Every check is disabled"
        return None
