"""Operators on single texts: BPE, quality counts, language id, HTML, against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocspark.llm import bpe, htmltext, langid, lm, quality

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, corpus, tokenizer):
    path, pattern, plain = tokenizer
    docs = frame(spark, corpus)
    got = {(r.doc_id, r.text): r for r in bpe.encode(docs, path, pattern).collect()}
    assert len(got) == len({(i, t) for i, t, *_ in corpus})
    for (_, text), r in got.items():
        assert r.ids == plain.encode_ordinary(text or "")
    for r in bpe.round_trip(docs.select("doc_id", "text"), path, pattern).collect():
        ids = plain.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.select("doc_id", F.col("text"), F.col("text").alias("was")), path, pattern), path, pattern)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert bpe.round_trip(docs.limit(0), path, pattern).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab e\n\t'sé漢🙂!=0 ", max_size=60))
def test_bpe_any_text(tokenizer, text):
    path, pattern, plain = tokenizer
    assert bpe.codec(path, pattern).encode(text) == plain.encode_ordinary(text)


def plain_counts(text):
    words, lines, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(marked))


def test_quality_counts(spark, corpus):
    rows = [(100, "a a a a\nb\nb\n\nb", "en", "s"), (101, "x | y ## é", "en", "s")] + corpus
    got = quality.with_counts(frame(spark, rows), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text or "")


def test_quality_judges(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(3, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    good = [(i, prose(120), "en", "s") for i in range(60)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(90).split()), "en", "s") for i in range(6)]
    bad += [(200 + i, " ".join(w.upper() + "!!" for w in prose(90).split()), "en", "s") for i in range(6)]
    bad += [(300 + i, " ".join(f"{w} {w} {w} {w} {w} {w}" for w in prose(20).split()), "en", "s") for i in range(6)]
    docs = frame(spark, good + bad + [(900, None, None, None), (901, "short", "en", "s")])
    counted = quality.with_counts(docs)
    out = {r.doc_id: r for r in quality.judge(counted, quality.fit(counted)).collect()}
    assert all(out[i].kept for i, *_ in good)
    assert not any(out[i].kept for i, *_ in bad)
    assert out[900].base_failed and out[901].base_failed and not out[900].kept
    empty = quality.with_counts(docs.limit(0))
    assert quality.judge(empty, quality.fit(empty)).count() == 0


def test_language_is_found_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.fold(F.col("doc_id"), 5) == 0
    counts = langid.train(langid.sample(docs.where(~held)))
    out = langid.predict(docs, counts).where(held).collect()
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_code_lengths(spark):
    """The trees' code lengths against PPM with exclusion written out byte by byte."""
    rows = spark.createDataFrame([("a", "abracadabra"), ("a", "abcab"), ("b", "zzzyzzzy"), ("b", "")], "lang string, text string")
    counts = langid.train(rows, order=2)
    texts = {"a": ["abracadabra", "abcab"], "b": ["zzzyzzzy", ""]}
    seen = set("".join(sum(texts.values(), [])))

    def probability(data, context, symbol):
        if context is None:
            return 1 / 256
        after = Counter()
        for t in data:
            padded = [""] * 2 + list(t)
            for i in range(2, len(padded)):
                if tuple(padded[i - len(context): i]) == context:
                    after[padded[i]] += 1
        shorter = None if not context else context[1:]
        if not after:
            return probability(data, shorter, symbol)
        n, d = sum(after.values()), len(after)
        if symbol in after:
            return after[symbol] / (n + d)
        left = 1 - sum(probability(data, shorter, s) for s in after)
        return d / (n + d) * probability(data, shorter, symbol) / left

    from vocspark.llm.textarrays import Texts
    probe = "abzcq"
    data = np.frombuffer(probe.encode(), np.uint8)
    got = langid.Trees(counts).lengths(Texts(data, np.array([0, len(data)])))[0]
    for k, lang in enumerate("ab"):
        padded = ["", ""] + list(probe)
        want = 0.0
        for i in range(2, len(padded)):
            context = tuple(c if c in seen or c == "" else "q" for c in padded[i - 2: i])
            want -= np.log2(probability(texts[lang], context, padded[i]))
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_language_edge_cases(spark, corpus):
    docs = frame(spark, corpus)
    counts = langid.train(langid.sample(docs))
    out = langid.predict(docs.select("doc_id", "text", "lang"), counts).collect()
    assert len(out) == len(corpus)
    for r in out:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has_letter
    none = langid.train(langid.sample(docs.limit(0)))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_lm_scores(spark, corpus):
    import math
    import zlib

    docs = frame(spark, corpus)
    train = langid.fold(F.col("doc_id"), 7) != 2
    got = lm.score(docs, train, block_bytes=50_000).collect()
    assert len(got) == len(corpus)
    tokens = [(i, [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [0])
              for i, t, *_ in corpus]
    words, pairs, starts = Counter(), Counter(), 0
    for i, t in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            words.update(t)
            pairs.update(zip([1] + t, t))
            starts += 1
    n, v, state, k = sum(words.values()), len(words), Counter(words), lm.PRIOR
    state[1] = starts
    want = []
    for i, t in tokens:
        base = [math.log10((words[w] + 1) / (n + v + 1)) for w in t]
        own = [math.log10((pairs[h, w] + k * 10 ** b) / (state[h] + k)) if pairs[h, w] else math.log10(k / (state[h] + k)) + b
               for h, w, b in zip([1] + t, t, base)]
        want.append((-1 if i is None else i, len(t), sum(words[w] > 0 for w in t), n, round(sum(base), 6), round(sum(own), 6)))
    have = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert [x[:4] for x in sorted(have)] == [x[:4] for x in sorted(want)]
    assert np.allclose([x[4:] for x in sorted(have)], [x[4:] for x in sorted(want)], rtol=1e-9, atol=1e-5)
    assert lm.score(docs.limit(0), train).count() == 0


PAGES = [
    ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>'
     '<div class="ad">Buy now and buy a lot of it today.</div><article><h1>Head</h1><p>First <b>bold<br>line &amp; more.'
     '<p>Second&nbsp;one.</article><footer>Foot</footer>', "Head First bold line & more. Second one."),
    ("<div id=menu><a href=x>A</a><a href=y>B</a></div><div><div class=post><h2>Title</h2><p>Some long text that goes on and on, "
     "with words.<p>Second paragraph of the same kind, long enough.<ul><li>one point<li>two</ul></div>"
     "<div class=comments><p>I liked it very much, thank you for all of this</div></div><form>Your <input name=q> mail</form>",
     "Title Some long text that goes on and on, with words. Second paragraph of the same kind, long enough. one point two"),
    ("<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><p>The story is told here in a row of words that "
     "are not links at all.</p><p>And it goes on for one more paragraph of such words.</p></div></body>",
     "The story is told here in a row of words that are not links at all. And it goes on for one more paragraph of such words."),
    ('<div class="layout has-sidebar"><div class="site-header"><h1>The Daily</h1></div><div class="content"><h1>Story</h1>'
     '<p>It was a long day in the town, and the people went home late.</p><p>See <a href=1>one</a> and <a href=2>two</a>.</p>'
     '<p>Then it rained for hours, as it often does in the autumn months there.</p></div><div class="cookie-notice">We use cookies to '
     'give you the best experience that there is on the web.</div><div id="comments"><h3>Comments</h3><p>First of all, I was there and '
     'saw it all with my own eyes.</p></div></div>',
     "Story It was a long day in the town, and the people went home late. See one and two. "
     "Then it rained for hours, as it often does in the autumn months there."),
    ("just text &lt; here", "just text < here"), ("", ""), (None, ""), ("<nav>only <a href=x>links</a></nav>", ""),
    ("<article><header><h1>H</h1></header><p>Body text of it.</p><aside>side</aside></article><header>Site</header>", "H Body text of it."),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, 3) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars int")
    out = {r.page_id: r for r in htmltext.extract(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert out[i].text == text and out[i].n_chars == len(text)
    assert htmltext.extract(df.limit(0)).count() == 0
    assert htmltext.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


STORY = "<p>It was a long day in the town, and the people went home late.<p>Then it rained for hours, as it often does there."
STORY_TEXT = "It was a long day in the town, and the people went home late. Then it rained for hours, as it often does there."


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input type=hidden><div class=menu><a href=1>x</a></div><div class=text>{STORY}</div>"
    "<select><option>en</select><button>Send</button></form>",
    f"<body><form><article>{STORY}</article></form><form>Your <input name=q> mail</form>",
    f"<body><p>Hi.</p><dialog open><article>{STORY}</article></dialog><form><label>Mail</label></form>"])
def test_html_forms_around_the_story(page):
    assert htmltext.main_text(page) == STORY_TEXT


def test_html_links_in_an_article_stay():
    links = "<ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul>"
    assert htmltext.main_text(f"<body><article>{STORY}{links}</article>{links}") == STORY_TEXT + " First source Second source Third source"


COMMENT = "<p>First of all, I was there and saw it all with my own eyes, and it was not at all as you tell it here, since "\
          "nobody went home before the rain, which came much later and was over soon, as anyone in the town will tell you."


@pytest.mark.parametrize("comments", [
    f"<div id=comments><article class=comment>{COMMENT}</article><article class='comment odd'>{COMMENT}</article></div>",
    f"<ol class=thread><li><article id=div-comment-7 class=comment-body>{COMMENT}</article></ol>"])
@pytest.mark.parametrize("page", ["<body><article>{}{}</article>", "<body><article>{}</article>{}", "<body><div>{}</div>{}"])
def test_html_comments_marked_as_articles(page, comments):
    assert htmltext.main_text(page.format(STORY, comments)) == STORY_TEXT


def test_html_an_article_of_opinion_is_no_comment():
    assert htmltext.main_text(f"<body><article class=comment><h1>Head</h1>{STORY}</article>") == "Head " + STORY_TEXT


RIVER = "<p>" + "The river rose and the old mill stood by its bank for years, quite alone. " * 6 + "</p>"


@pytest.mark.parametrize("name", ["content no-sidebar", "entry has-sidebar", "ad-free", "menu-open", "page with-comments search"])
def test_html_wrappers_with_boilerplate_names(name):
    page = (f'<html><body><header><h1>A title</h1><a href="/">Home</a></header><div class="{name}">{RIVER * 3}</div>'
            '<div class="sidebar"><a href=x>one</a> <a href=y>two</a> aside words</div></body></html>')
    assert htmltext.main_text(page) == " ".join(re.sub("<.*?>", " ", RIVER * 3).split())


@pytest.mark.parametrize("wrapper", ["post", "page has-sidebar"])
def test_html_long_comments_of_a_short_story_go(wrapper):
    remark = RIVER.replace("river", "REMARK") * 4
    page = f'<html><body><div class="{wrapper}"><div class="post">{RIVER}</div><div class="comments">{remark}</div></div></body></html>'
    assert "REMARK" not in htmltext.main_text(page) and "river" in htmltext.main_text(page)


def test_html_unmatched_end_tags_take_linear_time():
    import time
    start = time.process_time()
    assert htmltext.main_text("<div>" * 40_000 + "some words" + "</span>" * 40_000) == "some words"
    assert time.process_time() - start < 5
