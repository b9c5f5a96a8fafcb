"""Brute force and edge cases for operators on pages, conversations and vectors."""

import fnmatch

import numpy as np
import pytest

from zonewright.llm.chat_format import FORGERY, escape, format_conversations, marked, parse, render, unescape
from zonewright.llm.topk import top_k
from zonewright.llm.url_filter import ShiftAnd, filter_urls


def test_url_filter(spark):
    rows = [(1, "https://A.Example.NET/en/x"), (2, "http://net/"), (3, "http://net"), (4, None), (5, "no scheme"), (6, "https://x.example.com/de/1?q"), (7, "https://u.org/fr/"), (8, "https://notnet/"), (9, "http://h.net?/x"), (10, "http://a.net/" + "y" * 5000), (10, "http://a.net/"), (11, "")]
    pages = spark.createDataFrame([(i, u, "x", "z") for i, u in rows], "page_id long, url string, rule string, html string").drop("rule")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in filter_urls(pages).collect())
    assert got == [(1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "", "allow"), (4, "", "allow"), (5, "", "allow"), (6, "example.com/de/", "block"), (7, "org/fr/", "allow"), (8, "", "allow"), (9, "", "allow"), (10, "net/", "block"), (10, "net/", "block"), (11, "", "allow")]
    assert filter_urls(pages.limit(0)).count() == 0


def test_automaton_against_globs():
    rng = np.random.default_rng(5)
    letters = list("ab./")
    rules = [("block", "".join(rng.choice(list("ab*?"), rng.integers(1, 5))) + "/" + "".join(rng.choice(list("ab*?"), rng.integers(0, 5)))) for _ in range(60)]
    texts = ["." + "".join(rng.choice(list("ab."), rng.integers(1, 6))) + "/" + "".join(rng.choice(letters, rng.integers(0, 6))) for _ in range(400)]
    got = ShiftAnd(rules).matches(texts)
    for text, won in zip(texts, got, strict=True):
        host, _, path = text.partition("/")
        fits = []
        for i, (_, rule) in enumerate(rules):
            h, _, p = rule.partition("/")
            if fnmatch.fnmatchcase(host, "*." + h) and fnmatch.fnmatchcase(path, p + "*"):
                fits.append((-len(rule), -len(h), i))
        assert won == (min(fits)[2] if fits else -1), (text, won, fits)


@pytest.mark.parametrize("text", ["", "<|", "\\", "\\<|", "<\\|", "a\nb", FORGERY, "<|im_start|>user\n\\", "<<||>>", "\\\\<|\n"])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    turns = [("user", text), ("as\n<|sist", text), ("assistant", text)]
    out, spans, rewrites = render(turns)
    assert parse(out) == turns and not rewrites
    assert [unescape(out[s[2] : s[3]]) for s in spans] == [text] * 3


def test_rewriting_templates_are_found():
    def forgetful(messages):
        return "".join(f"[{r}]{t if i + 1 == len(messages) else ''}" for i, (r, t) in enumerate(messages))

    out, spans, rewrites = render([("user", "hi"), ("assistant", "yo"), ("user", "")], forgetful)
    assert (spans, rewrites) == ([], [1, 2]) and out == "[user][assistant][user]"


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, 0, None, "c"), (1, None, "assistant", "first")]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")).collect()}
    assert parse(got[1].formatted) == [("assistant", "first"), ("user", "a"), ("assistant", ""), ("assistant", "b")]
    assert "".join(got[1].formatted[s.start : s.end] for s in got[1].loss) == "firstb"
    assert parse(got[None].formatted) == [("", "c")] and marked([("", "c")]) == got[None].formatted
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_top(vectors, k, step):
    out = []
    q = [(i, v) for i, v in vectors if i is not None and i % step == 0]
    for i, v in {(i, tuple(v)) for i, v in q}:
        a = np.floor(np.array(v, float) * 64)
        s = sorted((-int(a @ np.floor(np.array(w, float) * 64)), j) for j, w in vectors if j is not None and j != i and len(w) == len(v))
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0, 20.0])
def test_top_k_against_brute_force(spark, spread):
    rng = np.random.default_rng(6)
    lengths = np.exp(rng.normal(0, spread, 900) / 4)
    centres = rng.normal(0, 1, (6, 12))
    v = [(int(i), ((centres[i % 6] + rng.normal(0, 0.1, 12)) * lengths[i]).astype(np.float32).tolist()) for i in range(900)]
    v += [(1000 + i, v[3][1]) for i in range(40)] + [(2000, [1.0, 2.0]), (2001, [3.0, -1.0]), (2020, []), (2040, [])]
    bad = [(40, None), (41, [None] * 12), (42, [float("nan")] * 12), (60, [float("inf")] * 12), (None, v[0][1])]
    v = [x for x in v if x[0] not in (40, 60)]
    table = spark.createDataFrame([(i, x, 1) for i, x in v + bad], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k(table, "vec_id % 20 = 0", k=7).collect()))
    assert got == brute_top(v, 7, 20)
    assert top_k(table.limit(0), "vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("size", [3e5, 4e8, 3e15])
def test_top_k_of_long_vectors(spark, size):
    """Scores past 2**53, which a double doesn't hold, and self products past 2**63."""
    rng = np.random.default_rng(7)
    v = [(i, (rng.normal(0, 1, 6) * size * (0.001 if i % 3 else 1)).tolist()) for i in range(120)] + [(500, [1e308] * 6)]
    table = spark.createDataFrame([*v, v[20], v[20]], "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(x * 64)) if abs(x * 64) < 2**53 else int(x * 64) for x in a] for i, a in v[:-1]}
    want = []
    for q in range(0, 120, 20):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[j], strict=True)))), j) for j in whole for _ in range(3 if j == 20 else 1) if j != q)[:9]
        want += [(q, r + 1, j, -x) for r, (x, j) in enumerate(scores)]
    got = sorted(map(tuple, top_k(table, "vec_id % 20 = 0", k=9, bucket=16, block=3).collect()))
    assert got == want


def test_top_k_in_many_shares(spark):
    rng = np.random.default_rng(9)
    v = [(int(i), (rng.normal(0, 1, 5) * np.exp(rng.normal(0, 2))).astype(np.float32).tolist()) for i in range(1500)]
    table = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k(table, "vec_id % 20 = 0", k=7, bucket=20, block=6).collect()))
    assert got == brute_top(v, 7, 20)
