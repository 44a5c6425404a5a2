"""Text scalar functions (F1–F12, F19, F31, F33, F41) as native Column expressions.

All of them stay inside whole-stage codegen (split / array / regex built-ins);
no Python UDF touches a row. Lexicons are parameters with the fixed defaults
from `vocspark.config`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark import config as C

WS = r"\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(text) -> Column:
    """Python str.strip(): drop leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def words(text, lower: bool = True) -> Column:
    """Python str.split(): whitespace tokens, no empty strings."""
    t = F.lower(_col(text)) if lower else _col(text)
    return F.array_remove(F.split(t, WS), "")


def word_set(text) -> Column:
    return F.array_distinct(words(text))


def _lex(ws) -> Column:
    return C.str_array(ws)


def severity(text, lex5=None, lex4=None, lex3=None, found=None) -> Column:
    """2.0 + lexicon tier (+2.5 / +1.5 / +0.5) + 0.5 if >30 % capitals
    + 0.2 per '!' (max 0.6), 2 dp, capped at 5.0. Tokens keep punctuation (Q13).
    `found` names a column that already holds the text's `word_set`."""
    t = _col(text)
    ws = word_set(t) if found is None else _col(found)
    lex = F.when(F.arrays_overlap(ws, _lex(lex5 or C.SEVERITY_5_WORDS)), F.lit(2.5)) \
        .when(F.arrays_overlap(ws, _lex(lex4 or C.SEVERITY_4_WORDS)), F.lit(1.5)) \
        .when(F.arrays_overlap(ws, _lex(lex3 or C.SEVERITY_3_WORDS)), F.lit(0.5)) \
        .otherwise(F.lit(0.0))
    n = F.length(t)
    caps = F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(n, F.lit(1))
    bang = n - F.length(F.regexp_replace(t, "!", ""))
    score = F.lit(2.0) + lex + F.when(caps > 0.3, F.lit(0.5)).otherwise(F.lit(0.0)) \
        + F.least(bang * F.lit(0.2), F.lit(0.6))
    return F.least(F.round(score, 2), F.lit(5.0))


def actionability(text, signal=None, vent=None, found=None) -> Column:
    """min(0.3 * signal, 0.9) + 0.1 if 50 < len < 300 - min(0.1 * vent, 0.4), clamp [0, 1], 2 dp.
    `found` names a column that already holds the text's `word_set`."""
    t = _col(text)
    ws = word_set(t) if found is None else _col(found)
    sig = F.size(F.array_intersect(ws, _lex(signal or C.ACTIONABLE_SIGNAL_WORDS)))
    ven = F.size(F.array_intersect(ws, _lex(vent or C.VENTING_ONLY_WORDS)))
    n = F.length(t)
    base = F.least(sig * F.lit(0.3), F.lit(0.9)) + F.when((n > 50) & (n < 300), F.lit(0.1)).otherwise(F.lit(0.0))
    pen = F.least(ven * F.lit(0.1), F.lit(0.4))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(base - pen, 2)))
    return F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(s)


def aspects(text, keywords: dict[str, list[str]] | None = None, fallback: str = C.GENERAL_ASPECT) -> Column:
    """aspects whose keyword occurs as a substring of the lower-cased text, else [fallback]."""
    kw = keywords or C.ASPECT_KEYWORDS
    t = F.lower(_col(text))
    hits = []
    for aspect, words_ in kw.items():
        cond = None
        for w in words_:
            c = t.contains(F.lit(w))
            cond = c if cond is None else (cond | c)
        hits.append(F.when(cond, F.lit(aspect)))
    arr = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit(fallback)))


def longest_run(arr: Column) -> Column:
    """Length of the longest run of equal adjacent elements (array must be sorted)."""
    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("r"), F.lit(0).alias("b"))

    def step(acc, x):
        r = F.when(acc["p"] == x, acc["r"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("p"), r.alias("r"), F.greatest(acc["b"], r).alias("b"))

    return F.aggregate(arr, init, step, lambda acc: acc["b"])


def dominant_word_ratio(text) -> Column:
    """F8 helper: share of the most frequent (lower-cased) word; O(n log n) via a sorted fold."""
    ws = words(text)
    return longest_run(F.array_sort(ws)) / F.greatest(F.size(ws), F.lit(1))


def has_majority_word(text, found=None) -> Column:
    """F8: does one (lower-cased) word make up more than half of the words?

    Boyer–Moore majority vote (one O(n) pass, no sort) finds the only possible
    candidate; its exact count is n - size(array_remove(words, candidate)).
    `found` names a column that already holds the text's `words`.
    """
    ws = words(text) if found is None else _col(found)
    init = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("k"))

    def step(acc, x):
        return F.when(acc["k"] == 0, F.struct(x.alias("c"), F.lit(1).alias("k"))) \
                .when(acc["c"] == x, F.struct(acc["c"].alias("c"), (acc["k"] + 1).alias("k"))) \
                .otherwise(F.struct(acc["c"].alias("c"), (acc["k"] - 1).alias("k")))

    cand = F.aggregate(ws, init, step, lambda acc: acc["c"])
    n = F.size(ws)
    cnt = n - F.size(F.array_remove(ws, F.coalesce(cand, F.lit(""))))
    return F.coalesce(cnt * 2 > n, F.lit(False))


def canned(text_lower: Column, patterns=None) -> Column:
    cond = None
    for p in patterns or C.CANNED_PATTERNS:
        c = text_lower.rlike(p)
        cond = c if cond is None else (cond | c)
    return cond


def is_valid_review(text, lang=None, english: str = "en", patterns=None, found=None) -> Column:
    """quality gate = F9 null guard, F5 length (>=15 chars, >=3 words), F6 canned
    phrases, F7 a character repeated 5+ times, F8 one word > 50 % of > 4 words, and
    F4 language (re-aimed: the `lang` column, when given, must be English).
    Cheap predicates come first; Catalyst keeps them in one codegen'd filter. `found` names a column
    that already holds the text's `words`: stripping the text does not change them."""
    t = py_strip(_col(text))
    lw = F.lower(t)
    n_words = F.size(words(t, lower=False) if found is None else _col(found))
    ok = _col(text).isNotNull() & (F.length(t) >= 15) & (n_words >= 3)
    if lang is not None:
        ok = ok & (F.coalesce(_col(lang), F.lit("")) == F.lit(english))
    ok = ok & ~canned(lw, patterns) & ~lw.rlike(r"(.)\1{4,}")
    ok = ok & ~((n_words > 4) & has_majority_word(t, found))
    return F.coalesce(ok, F.lit(False))


# ---------------------------------------------------------------------------
# Cleaning for the ML pipelines (F1–F3; learned lemmas are in operators.lemmas)
# ---------------------------------------------------------------------------

# Our own short English stop-word list (the reference used a library list).
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "so", "of", "at", "by", "for", "with", "about", "to",
    "from", "in", "on", "into", "over", "under", "up", "down", "out", "off", "again", "is", "are", "was",
    "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "it", "its", "this",
    "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "they", "them", "their", "what", "which", "who", "whom", "as", "not", "no", "nor", "too", "very", "can",
    "will", "just", "than", "there", "here", "when", "where", "why", "how", "all", "any", "both", "each",
    "more", "most", "other", "some", "such", "only", "own", "same", "should", "would", "could",
]


def trie_regex(words_) -> str:
    """Alternation of literal words factored as a prefix trie, so the regex
    engine tries ~one branch per position instead of every word."""
    import re as _re
    trie: dict = {}
    for w in set(words_):
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node) -> str:
        alts = []
        end = "" in node
        for ch in sorted(k for k in node if k):
            alts.append(_re.escape(ch) + emit(node[ch]))
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return f"(?:{body})?" if end else body

    return "(?:" + emit(trie) + ")"


def clean_text(text, stop_words=None, suffix_rules: bool = True) -> Column:
    """lower, drop URLs, keep letters and whitespace, drop stop words, lemma, join by space.

    `suffix_rules` are the light rules that need no dictionary; without them the words stay as they
    are, for the learned lemmas of `operators.lemmas`.

    After the letter filter every token is a maximal [a-z]+ run, so stop-word
    removal and the suffix lemma rules are whole-string regex rewrites (one
    codegen'd pass each) instead of per-token lambdas; the result equals the
    token pipeline (split, filter, transform, join).
    """
    t = F.lower(F.coalesce(_col(text).cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"http\S+|www\S+", "")
    t = F.regexp_replace(t, r"[^a-z \t\n\x0B\f\r]+", "")  # [^a-zA-Z\s] of lower-case text, in a class that the regex engine tests quickly
    t = F.regexp_replace(t, r"(?<![a-z])" + trie_regex(stop_words or STOP_WORDS) + r"(?![a-z])", "")
    if suffix_rules:
        t = F.regexp_replace(t, r"(?<![a-z])([a-z]{2,})ies(?![a-z])", "$1y")
        t = F.regexp_replace(t, r"(?<![a-z])([a-z]{2,}[a-hj-rtvwxyz])s(?![a-z])", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def snippet(text, n: int = 180) -> Column:
    """newlines -> spaces, longer than n -> first n-3 chars + '...'."""
    t = F.regexp_replace(_col(text), "\n", " ")
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def ascii_normalise(text) -> Column:
    """curly quotes / dashes / ellipsis -> ASCII, then drop characters outside Latin-1."""
    t = F.translate(_col(text), "‘’“”–—", "''\"\"--")
    t = F.regexp_replace(t, "…", "...")
    return F.regexp_replace(t, r"[^\x00-\xff]", "")


def parse_list_literal(col) -> Column:
    """a list serialised as text ("['a', 'b']", '["it\\'s"]') -> ARRAY<STRING>.

    `from_json` reads single- and double-quoted lists; anything it cannot parse
    falls back to splitting on quote-comma-quote / commas. Blank items are dropped.
    """
    c = _col(col).cast("string")
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    body = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    fallback = F.split(body, r"'\s*,\s*'|\"\s*,\s*\"|,\s*")
    arr = F.coalesce(parsed, F.when(F.trim(body) != "", fallback).otherwise(F.array().cast("array<string>")))
    cleaned = F.transform(arr, lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", ""))
    return F.filter(cleaned, lambda x: x != F.lit(""))
