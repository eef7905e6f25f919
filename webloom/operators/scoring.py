"""Scores of how hard a page is to collect, as column expressions on a row of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import reasons

# Frameworks of single-page sites.
SPA = ["react", "vue", "angular", "svelte"]
# Paths of challenges, and domains that ask to sign in.
CHALLENGES = "/challenge /verify /fp /setup /perimeterx /akamai /datadome".split()
SIGNIN_DOMAINS = "amazon linkedin facebook twitter instagram".split()
# How reasons are worded, in the order of the signals.
COMPLEX = ["CAPTCHA detected", "Cloudflare detected", "SPA Framework detected", "High DOM mutation rate", "Infinite scroll / Lazy loading"]
SIGNIN = ["Auth-required content blocks found", "Authentication prompts in text", "Blurred/restricted content", "Authentication overlays", "Known auth-heavy platform"]
HOSTILE = "Hostile Bot Defense Detected"
GUIDED = 40


def _on(test: Column, points: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)


def complexity(captcha: Column, cloudflare: Column, framework: Column, mutation_rate: Column, grows: Column) -> Column:
    """struct<score, guided, reasons>."""
    spa, busy = framework.isin(SPA), mutation_rate > 0.5
    score = _on(captcha, 50) + _on(cloudflare, 40) + _on(spa, 20) + _on(busy, 15) + _on(grows, 15)
    why = reasons(*zip((captcha, cloudflare, spa, busy, grows), COMPLEX))
    return F.struct(score.alias("score"), (score >= GUIDED).alias("guided"), why.alias("reasons"))


def is_challenge(url: Column) -> Column:
    return F.lower(url).rlike("|".join(CHALLENGES))


def hostility(cookies: Column, scripts: Column, honeypots: Column, urls: Column, challenged: Column | None = None) -> Column:
    """struct<score, reasons> of known cookies, defence scripts, honeypot count and requested URLs.

    challenged: whether a challenge was met already, where not all URLs are at hand.
    """
    challenge = F.exists(urls, is_challenge)
    if challenged is not None:
        challenge = F.coalesce(challenged, F.lit(False)) | F.coalesce(challenge, F.lit(False))
    tests = (F.size(cookies) > 0, F.size(scripts) > 0, honeypots > 0, challenge)
    score = sum((_on(t, p) for t, p in zip(tests, (50, 30, 20, 30))), F.lit(0))
    named = (
        F.concat(F.lit("Bot Cookies: "), F.array_join(cookies, ", ")), F.lit("Bot Defense Scripts detected"),
        F.format_string("Honeypots detected (%d)", honeypots), F.lit("Challenge/Verification requests detected"),
    )
    return F.struct(score.alias("score"), reasons(*zip(tests, named)).alias("reasons"))


def signin_likelihood(signin: Column, url: Column) -> Column:
    """struct<score, detected, reasons> of the struct that dom.signin makes, and the page's URL."""
    domain = F.coalesce(F.lower(url).rlike("|".join(SIGNIN_DOMAINS)), F.lit(False))
    links = signin["login_links"]
    tests = (signin["auth_blocks"] > 0, signin["auth_text"], signin["blurred"] > 0, signin["overlays"] > 0, domain)
    score = _on(links > 0, 20) + sum((_on(t, p) for t, p in zip(tests, (30, 40, 25, 35, 30))), F.lit(0))
    why = reasons((links > 0, F.format_string("Login buttons detected (%d)", links)), *zip(tests, SIGNIN))
    return F.struct(score.alias("score"), (score >= GUIDED).alias("detected"), why.alias("reasons"))


def merged(complexity: Column, hostility: Column, signin: Column) -> Column:
    """struct<complexity, hostility, guided, reasons>: sign-in raises hostility; hostility raises complexity.

    Reasons keep the order of their signals, those of complexity first unless the defence is hostile.
    """
    none = F.array().cast("array<string>")
    h = F.greatest(hostility["score"], F.when(signin["detected"], signin["score"]).otherwise(0))
    c = F.when(h >= GUIDED, F.greatest(complexity["score"], h)).otherwise(complexity["score"] + h)
    against = F.concat(hostility["reasons"], F.when(signin["detected"], signin["reasons"]).otherwise(none))
    guided = F.array_distinct(F.concat(F.array(F.lit(HOSTILE)), against, complexity["reasons"]))
    why = F.when(h >= GUIDED, guided).otherwise(F.concat(complexity["reasons"], F.when(h > 0, against).otherwise(none)))
    return F.struct(c.alias("complexity"), h.alias("hostility"), ((h >= GUIDED) | complexity["guided"]).alias("guided"), why.alias("reasons"))


def browser_mode(captcha: Column, cloudflare: Column, node_count: Column, requests: Column, shadow_dom: Column, realtime: Column) -> Column:
    headed = captcha | cloudflare | ((node_count < 100) & (requests > 10)) | (shadow_dom & realtime)
    return F.when(F.coalesce(headed, F.lit(False)), "headed").otherwise("headless")


def route(blocked: Column, captcha: Column, interactive: Column) -> Column:
    return F.when(blocked | (captcha & interactive), "solve").otherwise("analysis")


def mode_override(mode: Column, hostility: Column, logged_in: Column) -> Column:
    return F.when((hostility >= GUIDED) | logged_in, "headed").otherwise(mode)
