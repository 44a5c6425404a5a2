"""Configuration tables: taxonomy, aspect map, lexicons, weights.

Lexicons are *parameters* of the operators; the defaults below are the fixed
values that results must agree with. Helpers turn them into small DataFrames
(broadcast-size by construction: a few dozen rows) or Column literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference for identical results.
# ---------------------------------------------------------------------------

# Issue taxonomy labels, in taxonomy order, then the fallback bucket.
TAXONOMY_LABELS = [
    "Subscription & Billing",
    "App Crash & Launch Failure",
    "Video & Streaming Playback",
    "Account & Login",
    "Customer Support",
    "Performance & Speed",
    "Content & Features",
    "Notifications & Spam",
    "UI & Navigation",
    "Bugs & Technical Errors",
    "Privacy & Security",
    "Download & Offline",
]
FALLBACK_LABEL = "General App Feedback"
ALL_LABELS = TAXONOMY_LABELS + [FALLBACK_LABEL]

# What each issue label means, in words: the phrases whose vectors make its centroid.
ISSUE_PHRASES = {
    "Subscription & Billing": [
        "payment failed auto charge subscription money",
        "cancel subscription refund billing plan pay",
        "charged money price expensive pay for feature",
        "forced to pay subscription auto-renew daily monthly fee",
        "pay money watch free premium upsell",
    ],
    "App Crash & Launch Failure": [
        "app crashes keeps closing not opening",
        "cannot open app stuck loading screen",
        "app won't launch keeps crashing",
        "force close reinstall uninstall freezing",
    ],
    "Video & Streaming Playback": [
        "video buffering not playing loading slowly",
        "streaming quality bad pixelated lag",
        "playback error can't watch video content",
        "video freezes keeps buffering poor quality",
    ],
    "Account & Login": [
        "login sign in problem account access",
        "password reset forgot email cannot login",
        "account blocked banned suspended unable access",
        "google facebook sign in login failed",
    ],
    "Customer Support": [
        "support team unhelpful no response",
        "customer service terrible experience bad attitude",
        "no help from support ticket ignored",
        "useless support waste of time response",
    ],
    "Performance & Speed": [
        "app slow lagging unresponsive freezing",
        "takes long time load performance issue",
        "sluggish response lag spike high memory",
        "app not responding hanging slow startup",
    ],
    "Content & Features": [
        "missing feature content not available library",
        "removed content show movie not found",
        "feature request missing functionality wish list",
        "content library quality selection poor",
    ],
    "Notifications & Spam": [
        "too many notifications spam unwanted alerts",
        "notification settings don't work constant alerts",
        "spam messages annoying push notifications",
        "notification permission opt-out can't disable",
    ],
    "UI & Navigation": [
        "confusing navigation interface design bad",
        "hard to find menu button location unclear",
        "user interface ugly layout poor design",
        "search not working result wrong filter broken",
    ],
    "Bugs & Technical Errors": [
        "bug error glitch technical problem",
        "app not working broken feature error code",
        "software bug unexpected behavior malfunction",
        "error message keeps appearing not fixed",
    ],
    "Privacy & Security": [
        "data privacy security personal information",
        "account hacked unauthorized access breach",
        "privacy settings permissions data collection concern",
        "security vulnerability exposed data leak",
    ],
    "Download & Offline": [
        "download not working offline mode saves",
        "cannot download content for offline use",
        "download fails incomplete file storage",
        "offline content expired removed unavailable",
    ],
}

# Aspect -> issue labels (the "General" aspect is excluded from the radar).
ASPECT_MAP = {
    "Performance/Technical": ["App Crash & Launch Failure", "Performance & Speed", "Bugs & Technical Errors"],
    "Content/Library": ["Content & Features", "Download & Offline", "Video & Streaming Playback"],
    "UI/UX Experience": ["UI & Navigation", "Notifications & Spam"],
    "Pricing/Subscription": ["Subscription & Billing", "Account & Login", "Privacy & Security"],
    "General": ["Customer Support", "General App Feedback"],
}
GENERAL_ASPECT = "General"

# Aspect keyword lexicon (substring match on lower-cased text).
ASPECT_KEYWORDS = {
    "Performance/Technical": ["crash", "lag", "buffer", "freeze", "slow", "loading", "error", "bug"],
    "Content/Library": ["movie", "show", "series", "selection", "episodes", "watch", "boring"],
    "UI/UX Experience": ["interface", "design", "navigation", "button", "screen", "search", "easy"],
    "Pricing/Subscription": ["expensive", "price", "money", "subscription", "plan", "cancel", "worth"],
}

# Severity lexicons (whitespace tokens of the lower-cased text).
SEVERITY_5_WORDS = ["scam", "fraud", "lawsuit", "legal", "stolen", "robbed", "cheat", "criminal", "hack", "hacked"]
SEVERITY_4_WORDS = ["terrible", "horrible", "worst", "useless", "disgusting", "outraged", "furious", "demand",
                    "refund", "charged", "unauthorized"]
SEVERITY_3_WORDS = ["broken", "crash", "fail", "error", "bug", "fix", "annoying", "hate", "bad", "poor", "slow", "stuck"]

# Actionability lexicons.
ACTIONABLE_SIGNAL_WORDS = ["button", "click", "screen", "load", "slow", "crash", "bug", "stuck", "error", "missing",
                           "broken", "freeze", "freezing", "login", "password", "payment", "subscribe",
                           "subscription", "feature", "add", "improve", "update", "version", "menu", "tab",
                           "setting", "notification"]
VENTING_ONLY_WORDS = ["stupid", "bad", "worst", "hate", "dumb", "useless", "garbage", "trash", "why"]

# Customer tier weights (lower-case tier name -> weight); unknown tier -> 1.0.
TIER_WEIGHTS = {"enterprise": 5.0, "premium": 4.0, "pro": 2.5, "standard": 1.0, "free": 0.8}
TIER_ALIASES = ["user_tier", "tier", "segment"]
CLV_ALIASES = ["clv", "value", "revenue"]
# Hash tier buckets: (upper bound of md5 mod 100, weight), checked in order.
HASH_TIER_BUCKETS = [(3, 5.0), (15, 4.0), (40, 2.5), (85, 1.0), (100, 0.8)]

# Canned one-thought reviews rejected by the quality filter (anchored, lower-case).
CANNED_PATTERNS = [
    r"^very good( app)?\.?$",
    r"^very bad( app)?\.?$",
    r"^(really )?nice app\.?$",
    r"^worst app ever\.?$",
    r"^i love this app\.?$",
    r"^worse than before\.?$",
]

# Stop words dropped from emerging-cluster keywords.
CLUSTER_STOP_WORDS = ["the", "and", "app", "to", "it", "is", "a", "of", "in", "for", "with", "this"]

# Generic words dropped from keyword-title labels (improved keyword labeler).
TITLE_STOP_WORDS = [
    "app", "netflix", "good", "bad", "great", "excellent", "nice", "ok", "awesome",
    "hai", "hua", "hi", "bhai", "yaar", "kya", "ko", "ki", "he", "it", "very", "is",
    "application", "working", "work", "use", "using", "like", "love", "really",
    "amazing", "super", "useful", "best", "worst", "better", "quality",
]

# Message texts of alerts, report and summary.
TEXT_DOMINANCE = "Dominant Volume: Accounting for %.1f%% of all feedback."
TEXT_ANOMALY_LIMIT = "Statistically out-of-control (Limit: %.1f)"
TEXT_SPIKE = "MoM spike of +"
TEXT_VERSUS = "% mentions vs previous {n}M ("
TEXT_REPORT_ANOMALY_SPIKE = ("Statistically out-of-control with a +", "% MoM spike.")
TEXT_REPORT_ANOMALY = "Statistically out-of-control versus baseline."
TEXT_REPORT_INCREASE = ("Mentions increased by about ", "% compared with the previous window.")
TEXT_VOLATILE = "High volatility detected"
TEXT_STABLE = "Stable emotional range"
ACTION_URGENT = "Urgent: Assign a team to fix this quickly to avoid losing money."
ACTION_SPIKE = "Action: Check recent app updates to see what caused this sudden spike."
ACTION_CRASH = "Action: Check technical logs and consider rolling back the last update."
ACTION_STANDARD = "Standard: Keep an eye on this trend and plan a fix in the next roadmap."

# Thresholds.
CONFIDENCE_THRESHOLD = 0.30
LABEL_THRESHOLD = 0.15
DEDUP_THRESHOLD = 0.85
CORR_TRENDING = 0.80
CORR_ALERTS = 0.85
DRIFT_EVOLVING_PAIR = 0.12
DRIFT_EVOLVING_AVG = 0.10
SHARE_ALERT_PCT = 25.0

# Default "now" for every windowed query (the reference read the wall clock).
DEFAULT_AS_OF = "2001-08-01 00:00:00"

# ---------------------------------------------------------------------------
# Helpers turning config into Spark objects.
# ---------------------------------------------------------------------------


def aspect_map_df(spark: SparkSession, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """(aspect, issue_label) rows; a few dozen rows -> always broadcastable."""
    mapping = mapping or ASPECT_MAP
    rows = [(a, lab) for a, labs in mapping.items() for lab in labs]
    return spark.createDataFrame(rows, "aspect string, issue_label string")


def str_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def label_array(labels=None) -> Column:
    return str_array(labels or ALL_LABELS)
