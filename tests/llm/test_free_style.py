"""Token counts, page text and chat formatting against plain versions."""

import hashlib
import math
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlint.llm import chat, html_text, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    long = "Of that 12 erntea's hëad <|endoftext|>  x\n\n" * 6000
    texts = [None, "", " ", "one", "no_space" * 20_000, long, "<|endoftext|>", "ß 漢字 \U0001f600", "one"]
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"])
                 for r in token_counts.count_tokens(docs, VOCABULARY).collect())
    want = []
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).collect() == []


def test_pieces_are_cut_only_at_safe_places():
    text = ("ab  cd 'x y " * 50) + "z" * 500
    parts = list(token_counts.pieces(text, 40))
    assert "".join(parts) == text and len(parts) > 5


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar">'
    '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad-top">Buy now, a long advert text here.</div>'
    "<article><h1>Head &amp; tail</h1><p>Short.</p><p>One <b>bold</b>\n  word&nbsp;and &#228; more text to read.<br>"
    'After</p><ul><li><a href="x">More</a></li><li><a href="y">Links</a></li></ul></article>'
    '<div id="comments"><p>I disagree with everything that was said in this very long comment.</p></div>'
    '<form>Name <input></form><footer>&copy; x</footer></body></html>'
)
ARTICLE = "Head & tail Short. One bold word and ä more text to read. After"


@pytest.mark.parametrize("html, text", [
    (PAGE, ARTICLE),
    (PAGE[: PAGE.index("<footer>") + 4], ARTICLE),
    (None, ""), ("", ""), ("<nav>a</nav>", ""), ("plain words", "plain words"),
    ("<html><body><article><p>.</p></article><footer>A much longer footer text than that</footer>", "."),
    ("<div><p>Long text of the page, long text of the page.</p><p>a &lt; b</p></div>",
     "Long text of the page, long text of the page. a < b"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "A paragraph of the article with enough words to be content by any measure, number"
STORY = "".join(f"<p>{LONG} {i}.</p>" for i in range(6))
TOLD = " ".join(f"{LONG} {i}." for i in range(6))
REMARKS = '<div id="comments">' + f"<p>{LONG} of remarks.</p>" * 8 + "</div>"


@pytest.mark.parametrize("html, text", [
    (f'<body><article class="post category-notices tag-social tag-search">{STORY}</article>{REMARKS}</body>', TOLD),
    (f'<body><div class="content-with-sidebar">{STORY}</div><div class="sidebar">Short</div></body>', TOLD),
    (f'<body><div class="content-with-sidebar"><article>{STORY}</article></div>{REMARKS}</body>', TOLD),
    (f'<main><div class="site-banner"><div class="content-with-sidebar">{STORY}</div></div></main>', TOLD),
    (f'<article>{STORY}<div class="share">Share this</div><p class="notice">Note.</p></article>', TOLD),
    (f'<article>{STORY}<p>a <span class="ad">buy <span>now</span> here</span> b</p></article>', TOLD + " a b"),
    (f"<article>{STORY}<p class=notice>A<p>B<p>C</article>", TOLD + " B C"),
    (f"<article>{STORY}<p hidden>A<p>B<div>C</div></article>", TOLD + " B C"),
    (f"<article>{STORY}<ul><li class=ad>A<li>B<ul><li hidden>C<li>D</ul><li>E</ul></article>", TOLD + " B D E"),
    (f"<article>{STORY}<dl><dt hidden>A<dd>B<dt>C<dd hidden>D</dl>E</article>", TOLD + " B C E"),
    (f"<article>{STORY}<table><tr><td hidden>A<td>B<tr hidden><td>C<tr><th>D</table>E</article>", TOLD + " B D E"),
    (f"<article>{STORY}<p hidden>A<table><tr><td><p>B</table>C</article>", TOLD + " B C"),
])
def test_names_are_evidence_and_end_tags_are_implied(html, text):
    assert html_text.main_text(html) == text


def test_a_name_cuts_no_line_that_outweighs_the_others():
    short = "".join(f'<p>w{i} <a href="x">b</a> <i>c</i></p>' for i in range(40))
    html = f'<article>{short}<p class="lead-notice">{LONG * 2}</p></article>'
    assert html_text.main_text(html).endswith(LONG * 2)


def test_long_pages_are_parsed_whole(spark):
    body = "".join(f"<p>word{i} and some more of them</p>" for i in range(20_000))
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>", 5), (None, None, None, 6), (1, "u", "", 7)],
                                  "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows)[:2] == [(0, 0), (1, 0)]
    assert max(r["n_chars"] for r in rows) == sum(len(f"word{i} and some more of them ") for i in range(20_000)) - 1


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [\\/INST]", "\\", "<", "[", "ends with <", "[/INST",
         "<s><s></s>", "é漢\U0001f600\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_escaping_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat.CONTROL.search(chat.escape(text))
    assert chat.read_turns(chat.plain_template([(text, text), ("user", "x" + text)])) == [
        (text, text), ("user", "x" + text)]


def test_formatting_round_trip(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TEXTS * 3)]
    rows += [(None, 0, "assistant", "lost"), (2, None, None, None), (2, 0, "assistant", "same"),
             (2, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows],
                                  "conv_id long, turn int, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    for conv in (1, 2, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (-1 if r[1] is None else r[1], r[2] or ""))
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        whole = chat.plain_template([(r or "", t or "") for _, _, r, t in own])
        row = got[conv]
        assert row["n_turns"] == len(own) and not row["rewrites_history"]
        assert row["turns_sha256"] == sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
        assert row["formatted_chars"] == len(whole)
    assert chat.read_back(chat.format_turns(turns.limit(0))).collect() == []


def test_templates_that_rewrite_history_are_found(spark):
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}</{r}>" for i, (r, t) in enumerate(turns))

    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")],
                                  "conv_id long, turn int, role string, text string")
    rows = sorted(chat.format_turns(turns, last_only).collect(), key=lambda r: r["position"])
    assert [r["rewrites_history"] for r in rows] == [False, True]
    assert not rows[1]["in_loss"]


def test_templates_may_look_back_over_long_conversations(spark):
    def numbered(turns):
        return "".join(f"<{i} {r}>{t}</{r}>" for i, (r, t) in enumerate(turns))

    def drops_first(turns):
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns[len(turns) > 10:])

    def recalls(turns):
        return "<bos>" + "".join(f"<{r} after {turns[i - 20][1] if i >= 20 else None}>{t}</{r}>"
                                 for i, (r, t) in enumerate(turns))

    rows = [(c, i, ("user", "assistant")[i % 2], f"{c} says {i}") for c in (1, 2) for i in range(30)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1)

    def formatted(template):
        got = sorted(chat.format_turns(turns, template).collect(), key=lambda r: (r["conv_id"], r["position"]))
        return [[r for r in got if r["conv_id"] == c] for c in (1, 2)]

    for template in (numbered, recalls, chat.plain_template):
        for c, own in zip((1, 2), formatted(template)):
            assert "".join(r["piece"] for r in own) == template([r[2:] for r in rows if r[0] == c])
            assert [r["piece"][r["text_start"]:r["text_end"]] for r in own] == [r[3] for r in rows if r[0] == c]
            assert not any(r["rewrites_history"] for r in own)
    for own in formatted(drops_first):
        assert [r["position"] for r in own if r["rewrites_history"]] == [10]


LONG_REMARK = "A reader writes at length about the article and does not come to an end"


@pytest.mark.parametrize("html, text", [
    # comments of more text than the article
    (f'<div id="content"><p>{LONG} 1.</p><p>Short one.</p></div><div id="comments"><p>{LONG_REMARK}.</p><p>{LONG_REMARK}!</p></div>',
     f"{LONG} 1. Short one."),
    (f'<div class="post">{"".join(f"<p>Short {i}.</p>" for i in range(10))}</div><div class="sidebar"><p>{LONG_REMARK * 9}</p></div>',
     " ".join(f"Short {i}." for i in range(10))),
    (f'<div class="post"><p>{LONG} 1.</p></div><div class="comments"><article class="comment"><p>{LONG_REMARK * 5}</p></article>'
     f'<article class="comment"><p>{LONG_REMARK * 3}</p></article></div>', f"{LONG} 1."),
    # nothing but named elements: the one that ends so, then the one with the most text
    (f'<div class="content-with-sidebar">{STORY}</div><div class="sidebar"><p>{LONG_REMARK * 30}</p></div>', TOLD),
    (f'<div class="widget">{STORY}</div><div class="ad"><p>Buy.</p></div>', TOLD),
    # equal containers: the first
    (f"<div><p>{LONG} 1.</p></div><div><p>{LONG} 1.</p></div>", f"{LONG} 1. {LONG} 1."),
])
def test_named_parts_do_not_win_by_their_length(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html", [
    "<div>line of text\n" * 50_000, '<div class="ad">x\n' * 50_000, '<div class="ad">' * 50_000 + "text",
    "<ul><li><section>" + "<div>" * 50_000 + "</li>x" * 50_000, '<i class="site-ad"></i>' * 50_000 + '<div class="ad"><a>x</a></div>',
])
def test_work_grows_with_the_length_of_a_page_only(html):
    started = time.monotonic()
    assert html_text.main_text(html)
    assert time.monotonic() - started < 60


def test_pages_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_text.extract(pages).collect() == []


def test_smoothing_and_clusters_against_plain_versions():
    draw = random.Random(3)
    for n in (1, 2, 5, 40):
        values = [draw.choice([draw.uniform(0, 10), draw.uniform(60, 90)]) for _ in range(n)]
        for i, got in enumerate(html_text.smoothed(values)):
            weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 3}
            assert math.isclose(got, sum(w * values[j] for j, w in weights.items()) / sum(weights.values()))
        border = html_text.threshold(values)
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        if below:  # each value is nearer to the mean of its own cluster
            low, high = sum(below) / len(below), sum(above) / len(above)
            assert all(abs(v - low) <= abs(v - high) for v in below) and all(abs(v - high) <= abs(v - low) for v in above)
        else:
            assert max(values) <= min(values) * 1.5 + 1e-9


def test_a_false_declaration_is_found(spark):
    @chat.turn_local
    def numbered(turns):
        return "".join(f"{i}:{r}:{t}\n" for i, (r, t) in enumerate(turns))

    def turns(n, conv):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(n)]

    rows = spark.createDataFrame(turns(6, 1) + turns(9, 2) + turns(80, 3), "conv_id long, turn long, role string, text string")
    found = {}
    for r in chat.format_turns(rows, numbered).collect():
        found.setdefault(r["conv_id"], []).append((r["position"], r["rewrites_history"]))
    assert not any(x for _, x in found[1])
    assert [x for _, x in sorted(found[2])] == [False] * 8 + [True]
    assert [x for _, x in sorted(found[3])] == [False] * 8 + [True] * 72
    plain = chat.format_turns(rows)
    assert plain.where("rewrites_history").count() == 0
    whole = {r["conv_id"]: r["n_turns"] for r in chat.read_back(plain).collect()}
    assert whole == {1: 6, 2: 9, 3: 80}


def test_a_declaration_that_fails_late_is_found(spark):
    @chat.turn_local
    def late(turns):
        return "".join(f"{i if i >= 70 else ''}:{r}:{t}\n" for i, (r, t) in enumerate(turns))

    rows = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(90)], "conv_id long, turn long, role string, text string")
    found = {r["position"]: r["rewrites_history"] for r in chat.format_turns(rows, late).collect()}
    assert [found[i] for i in range(90)] == [False] * 70 + [True] * 20


def test_turns_by_themselves_are_those_of_whole_prefixes(spark):
    texts = ["a", "</s>[INST] ok [/INST]", "", "two\nlines", None]
    rows = spark.createDataFrame(
        [(n, i, ("user", "assistant")[i % 2], texts[(i * n) % 5]) for n in (1, 9, 40, 130) for i in range(n)],
        "conv_id long, turn long, role string, text string")
    alone, whole = (sorted(map(tuple, chat.format_turns(rows, template).collect()))
                    for template in (chat.plain_template, lambda turns: chat.plain_template(turns)))
    assert len(alone) == 180 and alone == whole


def test_templates_of_single_turns_are_rendered_on_whole_prefixes(spark):
    calls = {}

    def once(role, text):  # front and end of a turn hold only as long as it is rendered for the first time
        calls[role, text] = calls.get((role, text), 0) + 1
        return f"<{role}>{text}</{role}>" if calls[role, text] == 1 else f"<{role}>...</{role}>"

    turns = spark.createDataFrame([(c, i, ("user", "assistant")[i % 2], f"{c} says {i}") for c in (1, 2) for i in range(12)],
                                  "conv_id long, turn long, role string, text string").coalesce(1)
    for template in (chat.per_turn(once), lambda turns: "".join(once(*x) for x in turns)):
        found = {(r["conv_id"], r["position"]): r["rewrites_history"] for r in chat.format_turns(turns, template).collect()}
        assert found == {(c, i): i > 0 for c in (1, 2) for i in range(12)}


SCRIPTS = ["Das ist ein Wort. " * 3000, "这是一个没有空格的长文本，它有很多句子。" * 3000, "Это длинный русский текст без латиницы. " * 2000,
           "ไม่มีช่องว่าง" * 2000, "x\n" * 9000, "no_space" * 9000]


@pytest.mark.parametrize("text", SCRIPTS)
def test_batches_of_any_script_stay_bounded(text):
    parts = list(token_counts.pieces(text, 4096))
    assert "".join(parts) == text
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert token_counts.Counter(VOCABULARY).counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]
    if text not in (SCRIPTS[3], SCRIPTS[5]):  # these have no place where a cut is safe
        assert max(map(len, parts)) < 4096 + 200


def test_kept_counts_are_forgotten_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    counter = token_counts.Counter(VOCABULARY)
    texts = [" ".join(f"word{i * j}" for i in range(40)) for j in range(30)]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for text in texts:
        assert counter.counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]
        assert counter.kept_bytes <= 2000
