"""Brute force and edge cases for operators on documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.llm import registry
from zonewright.llm.decontaminate import contamination, remove_contaminated, remove_spans
from zonewright.llm.line_dedup import LineRuns, dedup_lines
from zonewright.llm.lm_score import encode, fit, score, start_params
from zonewright.llm.mixing import mix, mixed, targets
from zonewright.llm.ngram_join import jaccard_classes, one_of_each_class, prefix_depth
from zonewright.llm.token_output import Encoder, WaveletMatrix, byte_bpe, token_output
from zonewright.llm.toxicity import toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(name, agrees):
    agrees(registry.queries()[name], registry.oracle_sql()[name])


def test_every_number_has_a_query():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}


TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_contamination(spark, broadcast):
    rows = [(1, "x " + TEXT.upper() + " y", "a"), (2, "short one. SHORT, one!", "a"), (3, None, "a"), (4, "", "a"), (None, TEXT, "a"), (1, "other text", "a"), (5, "clean " * 30, "a"), (5, "clean " * 30, "a")]
    bench = spark.createDataFrame([(7, TEXT), (8, "short one"), (9, None), (10, ""), (None, TEXT)], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in contamination(docs_of(spark, rows), bench, broadcast_bytes=broadcast).collect())
    assert got == Counter({(1, 14, 12, ("7",)): 1, (2, 4, 4, ("8",)): 1, (3, 0, 0, ()): 1, (4, 0, 0, ()): 1, (None, 12, 12, ("7",)): 1, (1, 2, 0, ()): 1, (5, 30, 0, ()): 2})
    left = remove_contaminated(docs_of(spark, rows), bench, broadcast_bytes=broadcast)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and left.count() == 5
    cut = {r.doc_id: r.text for r in remove_spans(docs_of(spark, rows[:4]), bench).collect()}
    assert cut == {1: "x y", 2: "", 3: None, 4: ""}


def test_contamination_of_empty_tables(spark):
    none, bench = docs_of(spark, []), spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert contamination(none, bench).count() == 0
    assert not contamination(docs_of(spark, [(1, TEXT, "a")]), bench.limit(0)).first().contaminated


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_line_dedup(spark, broadcast):
    rows = [(i, f"own {i}\n  Shared Line\t\nlast", "a") for i in range(4)] + [(9, None, "a"), (10, "", "a"), (11, "shared line", "a"), (11, "shared line", "a")]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs_of(spark, rows), min_docs=5, broadcast_bytes=broadcast).collect())
    want = Counter((i, 3, 1, f"own {i}\nlast") for i in range(4)) + Counter({(9, 1, 0, ""): 1, (10, 1, 0, ""): 1, (11, 1, 1, ""): 2})
    assert got == want


def test_line_runs_are_compacted(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for b in range(4):
        runs.add(docs_of(spark, [(b, "common\nline %d" % b, "a")]), 1)
    assert [len(level) for level in runs.levels] == [0, 0, 1] and runs.common().count() == 1


def test_wavelet_matrix_against_arrays():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 50257), (5000, 3), (600, 2**20)):
        ids = rng.integers(0, top, n).astype("<u4")
        w = WaveletMatrix.build(ids)
        assert (w.decode() == ids).all()
        for i in rng.integers(0, n, min(n, 30)) if n else []:
            v, k = int(ids[i]), int((ids[:i] == ids[i]).sum())
            assert (w.access(i), w.rank(v, i), w.select(v, k), w.count(v)) == (v, k, i, int((ids == v).sum()))
        assert w.count(top + 1) == 0 and w.select(top + 1, 0) == -1


def test_encoder_equals_whole_texts():
    e = Encoder(byte_bpe(), keep=50)
    rng = np.random.default_rng(1)
    parts = ["a", "é", "The", " ", "\n", "\t", "  ", "1", "!", ".", ",", "<|endoftext|>", "'s", "\x1c", "\0", "日本", "-", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(1500)]
    assert e.encode(texts) == [np.array(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_on_long_words_wide_blanks_and_growth():
    e = Encoder(byte_bpe())
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyzäéßñ×’…")
    pieces = ["".join(rng.choice(letters, rng.integers(1, 25))) + str(rng.choice(["", ",", ".", "...", "!,"])) for _ in range(20000)]
    texts = [" ".join(rng.choice(pieces, 40)).replace(" a", "\na", 1) for _ in range(900)]
    texts += ["a\u00a0b c", "x\u2003y, z", "q\u3000", "“quoted” – dash… end.", "é.", "×.", "’.", "don't, won't.", "", "<|endoftext|> a", "a <b, c", "1, 22. 3,"]
    for some in (texts, [None, *texts[:3], None], [""] * 3):
        assert e.encode(some) == [np.array(e.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert e.known.n > 5000 and len(e.known.entry) > 1 << 12


def test_token_output_round_trip(spark):
    rows = [(3, "hello world", "a"), (1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x", "a"), (5, "long text " * 3000, "a")]
    got = sorted(token_output(docs_of(spark, rows), byte_bpe(), shard_tokens=5).collect(), key=lambda r: r.start)
    tok, at = Encoder(byte_bpe()).tok, 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output(docs_of(spark, []), byte_bpe()).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    calm, rude = [f"w{i}" for i in range(300)], ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(calm, 60))
        if i % 2:
            for at in rng.integers(0, 60, 4):
                words[at] = str(rng.choice(rude))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, i % 2))
    d = docs_of(spark, [*rows, (None, None, "a"), (9999, "", "a")])
    table = spark.createDataFrame([*labels, (None, 1), (0, None)], "doc_id long, toxic int")
    got = toxicity(d, table).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == r.doc_id % 2 for r in held if r.doc_id < 600) > 0.97 * len(held)
    assert {r.score for r in toxicity(d, table.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity(d, table.limit(0)).collect()} == {0.0}


def test_rare_toxic_words_count(spark):
    """Each toxic word is in few texts: none follows 16 different words, as the four-sigma discount asked for."""
    rng = np.random.default_rng(5)
    calm, rude = [f"w{i}" for i in range(300)], [f"slur{i}" for i in range(16)]
    rows, labels = [], []
    for i in range(1200):
        words, toxic = list(rng.choice(calm, 60)), int(i % 8 == 0)
        if toxic:
            words[rng.integers(60)] = words[rng.integers(60)] = rude[i // 8 % 16]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, toxic))
    got = [r for r in toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.held_out]
    assert sum(r.predicted for r in got if r.doc_id % 8 == 0) > 0.8 * sum(r.doc_id % 8 == 0 for r in got)
    assert sum(r.predicted for r in got if r.doc_id % 8) < 0.02 * len(got)


def test_models_against_brute_force(spark):
    """Interpolated bigrams, continuation counts, shared backoff and mixture by dictionaries and loops, with the shipped constants."""
    import zonewright.llm.toxicity as T

    rng = np.random.default_rng(15)
    texts = []
    for i in range(240):
        w = [int(x) for x in rng.integers(1, 60, 25)]
        at = sorted(int(x) for x in rng.choice(23, 2, replace=False))
        if i % 3 == 0:
            w[at[0]], w[at[1]], w[at[1] + 1] = 100 + i % 4, 7, 8  # a word that marks the class, and a pair of plain words
        else:
            w[at[0]], w[at[1] + 1] = 7, 8
        texts.append((int(i % 3 == 0), w))
    got = T._models(T._pairs(spark.createDataFrame(texts, "t int, h array<long>")))

    runs = {(t, z, a, b) for t, w in texts for z, a, b in zip([0, 0, *w], [0, *w], w, strict=False)}
    d = [Counter((a, b) for t, z, a, b in runs if t == c) for c in (0, 1)]
    n = [Counter(b for a, b in d[c]) for c in (0, 1)]
    kinds, pairs = sorted(set(n[0]) | set(n[1])), sorted(set(d[0]) | set(d[1]))

    def discount(count):
        ones, twos = (sum(v == k for v in count.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.75

    def beta(x, y):
        return math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)

    def marks(x, shares, width):
        """Chance of each of x's counts to mark a class, and the likelihood of all."""
        odds, large = [], []
        for (k0, k1), s in zip(x, shares, strict=True):
            large.append(beta(k1 + s * width, k0 + (1 - s) * width) - beta(s * width, (1 - s) * width))
            odds.append(math.exp(beta(k1 + 0.5, k0 + 0.5) - beta(0.5, 0.5) - large[-1]))
        prior = 0.01
        for _ in range(3000):
            prior = (1 + sum(prior * o / (prior * o + 1 - prior) for o in odds)) / (len(odds) + 2)
        chance = [prior * o / (prior * o + 1 - prior) for o in odds]
        return chance, sum(g + math.log(1 - prior + prior * o) for g, o in zip(large, odds, strict=True))

    total = [sum(x.values()) for x in n]
    share = [total[1] / sum(total)] * len(kinds)
    given = [(n[0][w], n[1][w]) for w in kinds]
    width = max(np.geomspace(10, 1e6, 26), key=lambda v: marks(given, share, v)[1])
    chance = dict(zip(kinds, marks(given, share, width)[0], strict=True))
    own = [{w: max(0, n[c][w] - discount(n[c])) * chance[w] for w in kinds} for c in (0, 1)]
    left = Counter()
    for c in (0, 1):
        left.update({w: n[c][w] - own[c][w] for w in kinds})
    back = [1 - sum(own[c].values()) / total[c] for c in (0, 1)]

    def word(c, w):
        return own[c].get(w, 0) / total[c] + back[c] * (left[w] + 0.5) / (sum(left.values()) + 0.5 * (len(kinds) + 1))

    context = [Counter() for _ in d]
    for c in (0, 1):
        for (a, _), k in d[c].items():
            context[c][a] += k
    part = sum(context[1].values()) / (sum(context[0].values()) + sum(context[1].values()))

    def expected(a, b):
        odds = (context[1][a] + part) / (context[0][a] + 1 - part) * word(1, b) / word(0, b)
        return odds / (1 + odds)

    weight = dict(zip(pairs, marks([(d[0][p], d[1][p]) for p in pairs], [expected(*p) for p in pairs], width)[0], strict=True))
    taken = [{p: max(0, d[c][p] - discount(d[c])) * weight[p] for p in pairs} for c in (0, 1)]

    def p_of(c, a, b):
        here = max(1, context[c][a])
        rest = 1 - sum(v for p, v in taken[c].items() if p[0] == a) / here
        return taken[c].get((a, b), 0) / here + rest * word(c, b)

    assert len(got.words) == len(kinds) + 1 and len(got.pairs) == len(pairs) and min(chance.values()) > 0
    assert chance[100] > 0.9 and weight[7, 8] > 0.9 and chance[8] < 0.5
    for w in [w for _, w in texts[:20]] + [[7, 8, 999], [999, 7], [], [8]]:
        want = sum(np.log(p_of(1, a, b) / p_of(0, a, b)) for a, b in zip([0, *w], w, strict=False)) / max(1, len(w))
        assert abs(got.differences(np.array(w, np.uint64), np.array([len(w)]))[0] - want) < 1e-6
    # Probabilities of all words and of any other, behind a word of either class, sum to one.
    for c in (0, 1):
        assert abs(sum(p_of(c, 7, b) for b in [*kinds, -1]) - 1) < 1e-9


def test_toxicity_learns_whole_texts_within_its_bound(spark):
    """Texts that don't fit are left out as a whole; where no text fits, every score is the class's share."""
    from zonewright.llm.toxicity import Model, learn

    rows = [(i, ("calm " if i % 2 else "rude ") * (5000 if i == 2 else 20), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(400)], "doc_id long, toxic int")
    assert isinstance(learn(docs_of(spark, rows), labels, max_words=4500), Model)
    assert 0.4 < learn(docs_of(spark, rows), labels, max_words=10) < 0.6


def test_toxic_pairs_of_plain_words(spark):
    rng = np.random.default_rng(16)
    calm = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(calm, 50))
        a, b = sorted(int(x) for x in rng.choice(48, 2, replace=False))
        words[a], words[b + 1] = "drop", "dead"
        if i % 3 == 0:
            words[a + 1], words[b + 1] = "dead", str(rng.choice(calm))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(i % 3 == 0)))
    got = [r for r in toxicity(docs_of(spark, [*rows, *rows[:3]]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.9


def test_masked_model_learns_order(spark):
    rows = [(i, "a b c d e f g h " * 12, "a") for i in range(60)] + [(100, "h c a f b g d e " * 12, "a"), (101, None, "a"), (102, "", "a")]
    enc, counts = encode(docs_of(spark, rows), frequent=20, buckets=4)
    assert counts.sum() == 61 * 96
    got = {r.doc_id: r for r in score(enc, fit(enc, counts)).collect()}
    assert got[0].mean_log_prob > got[100].mean_log_prob + 0.5
    assert (got[101].n_tokens, got[101].log_prob, got[101].mean_log_prob) == (0, 0.0, None)
    p, flat = counts / counts.sum(), start_params(counts)
    uni = {r.doc_id: r for r in score(enc, flat).collect()}
    assert got[0].mean_log_prob > (p[p > 0] * np.log(p[p > 0])).sum() and abs(uni[0].mean_log_prob) < 3
    none, zero = encode(docs_of(spark, []))
    assert score(none, fit(none, zero)).count() == 0


def test_network_against_brute_force():
    from zonewright.llm.lm_score import _windows, gradients, log_probabilities

    rng = np.random.default_rng(17)
    v, ids, ends = 9, rng.integers(0, 9, 40), np.array([7, 7, 8, 30, 40])
    for scale in (1.0, 400.0):
        p = {k: (x * (scale if k == "u" else 1)).astype(np.float32) for k, x in start_params(rng.integers(1, 50, v).astype(float), dim=4).items()}

        def around(i):
            text = int(np.searchsorted(ends, i, side="right"))
            low, high = (ends[text - 1] if text else 0), ends[text]
            return [ids[j] if low <= j < high else v for j in (i - 2, i - 1, i + 1, i + 2)]

        def log_p(q, i):
            hidden = np.tanh(q["b"].astype(float) + sum(q["e"][k][w] for k, w in enumerate(around(i))))
            logits = hidden @ q["u"] + q["c"]
            top = logits.max()
            return logits[ids[i]] - top - np.log(np.exp(logits - top).sum())

        want = [log_p(p, i) for i in range(40)]
        near = log_probabilities(p, ids, ends)
        assert np.allclose(near, np.maximum(want, near.min()), atol=2e-3 * scale**0.5)
    p = {k: x.astype(float) for k, x in start_params(rng.integers(1, 50, v).astype(float), dim=4).items()}
    windows = _windows(ids, ends, 2, v)
    assert (windows == [around(i) for i in range(40)]).all() and (_windows(ids, ends, 2, v, np.arange(3, 40, 4)) == windows[3::4]).all()
    got, h = gradients({k: x.astype(np.float32) for k, x in p.items()}, ids, windows), 1e-5
    for name, x in p.items():
        for at in list(np.ndindex(x.shape))[:: 1 + x.size // 25]:
            up, down = ({**p, name: x.copy()} for _ in range(2))
            up[name][at] += h
            down[name][at] -= h
            slope = -np.mean([log_p(up, i) - log_p(down, i) for i in range(40)]) / (2 * h)
            assert abs(got[name][at] - slope) < 1e-4


def test_bucketed_words_share_their_bucket(spark):
    rows = [(i, "a " * 9 + "rare", "a") for i in range(3)] + [(7, "a common common common", "a"), (7, "once " + "a " * 3, "a"), (None, "common", "a"), (8, None, "a")]
    enc, counts = encode(docs_of(spark, rows), frequent=1, buckets=1)
    assert counts.tolist() == [31, 8]
    own = sorted((r.doc_id or 0, round(r.own, 9)) for r in enc.collect())
    log = lambda n, k=1: round(float(k * np.log(n / 8)), 9)
    assert own == sorted([*[(i, log(3)) for i in range(3)], (7, log(4, 3)), (7, log(1)), (0, log(4)), (8, 0.0)])
    got = {r.n_tokens: r.log_prob for r in score(enc, start_params(counts)).collect() if r.doc_id is None or r.doc_id == 8}
    flat = {r.n_tokens: r.log_prob for r in score(enc.withColumn("own", enc.own * 0), start_params(counts)).collect() if r.doc_id is None or r.doc_id == 8}
    assert abs(got[1] - flat[1] - np.log(4 / 8)) < 1e-9 and got[0] == 0


def test_vocabulary_is_not_cut():
    from zonewright.llm.lm_score import BUCKETS, FREQUENT

    assert FREQUENT >= 192 and BUCKETS >= 64


def brute_classes(rows, n=5, t=0.8):
    sets = []
    for _, text, _ in rows:
        w = WORD.findall((text or "").lower())
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    kinds = sorted({s for s in sets if s}, key=lambda s: min(i for i, x in enumerate(sets) if x == s))
    near = {a: [b for b in kinds if a != b and len(a & b) * 10 >= 8 * len(a | b)] for a in kinds}
    cls = {}
    for a in kinds:
        if a in cls:
            continue
        todo, seen = [a], {a}
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(r[0] for r, s in zip(rows, sets, strict=True) if s in seen)
        cls |= dict.fromkeys(seen, least)
    return sorted((r[0], cls.get(s, r[0]), len(near.get(s, []))) for r, s in zip(rows, sets, strict=True))


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = list(rng.choice(vocab, 120))
        for c in range(8):
            words = list(base)
            for at in rng.integers(0, 120, c):
                words[at] = str(rng.choice(vocab))
            rows.append((g * 100 + c, " ".join(words), "a"))
    return [*rows, (5001, None, "a"), (5002, "", "a"), (5003, "two words", "a"), (5004, "Two, words!", "a"), (5005, "!!!", "a")]


def test_jaccard_classes_against_brute_force(spark, monkeypatch):
    import zonewright.llm.ngram_join as J

    rows = near_copies()
    want = brute_classes(rows)
    assert sorted(map(tuple, jaccard_classes(docs_of(spark, rows)).select("doc_id", "class_id", "n_links").collect())) == want
    # Blocks of three sets and prefixes of two: groups are split and merged again.
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "PREFIX_BLOCK", 2)
    assert sorted(map(tuple, jaccard_classes(docs_of(spark, rows)).select("doc_id", "class_id", "n_links").collect())) == want
    kept = one_of_each_class(docs_of(spark, [*rows, rows[0]]).withColumn("h", F.lit(1)).withColumn("sid", F.lit(2)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want}) and kept.columns[-2:] == ["h", "sid"]


def test_recall_near_the_threshold(spark, monkeypatch):
    """600 pairs of exact similarity 176/216, each in a family of its own, and hubs that are split."""
    import zonewright.llm.ngram_join as J

    rng = np.random.default_rng(11)
    rows = []
    for g in range(600):
        base = [f"g{g}w{i}" for i in range(200)]
        other = list(base)
        for k in range(4):
            other[10 + 40 * k + int(rng.integers(20))] = f"other{k}"
        rows += [(2 * g, " ".join(base), "a"), (2 * g + 1, " ".join(other), "a")]
    monkeypatch.setattr(J, "HUB", 1)
    got = jaccard_classes(docs_of(spark, rows)).collect()
    linked = sum(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got)
    assert linked >= 0.99 * len(rows) and all(r.n_links <= 1 for r in got)


def test_hubs_have_components(spark, monkeypatch):
    import zonewright.llm.ngram_join as J

    monkeypatch.setattr(J, "HUB", 5)
    name = lambda i: i.to_bytes(4, "big")
    edges = [(name(50), name(i)) for i in range(40) if i != 50] + [(name(100 + i), name(101 + i)) for i in range(30)] + [(name(7), name(200))]
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in J.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {i: 0 for i in [*range(40), 50, 200]} | {100 + i: 100 for i in range(31)}


@pytest.mark.parametrize("hub", [1, 1000])
def test_common_prefixes(spark, monkeypatch, hub):
    """A group of 60 near copies beside pairs: with hub 1 its prefixes are common ones, the pairs' aren't."""
    import zonewright.llm.ngram_join as J

    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:i] + [f"v{i}"] + base[i + 1 :]) for i in range(0, 300, 5)]
    texts += [" ".join([f"p{g}w{i}" for i in range(100)] + [f"end{k}"]) for g in range(20) for k in range(2)]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(grams) if j != i) for i, a in enumerate(grams)]
    monkeypatch.setattr(J, "HUB", hub)
    got = jaccard_classes(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    want = [(i, 0 if i < 60 else i - i % 2, n) for i, n in enumerate(links)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_recall_in_families():
    """A document at 0.8 of another that has five copies at 0.995: in the trees nearly all find a partner, whichever it is."""
    from zonewright.llm.ngram_join import DEPTH, RECALL, THRESHOLD, TREES, _walk, prefix_depth

    rng, m, groups, size = np.random.default_rng(13), TREES * DEPTH, 400, 7
    shortest, lost = prefix_depth(), 0

    def like(sig, similarity):
        return np.where(rng.random(m) < similarity, sig, rng.integers(0, 256, m)).astype(np.uint8)

    for _ in range(groups):
        first = rng.integers(0, 256, m).astype(np.uint8)
        sig = np.stack([first, *[like(first, 0.995) for _ in range(size - 2)], like(first, 0.8)])
        found = False
        for t in range(TREES):
            branch = sig[:, t * DEPTH : (t + 1) * DEPTH]
            order = np.lexsort(branch.T[::-1])
            subtree = np.unique(branch[order][:, :shortest], axis=0, return_inverse=True)[1].ravel()
            a, b = _walk(sig[order], branch[order], subtree, np.full(size, -1), shortest, THRESHOLD, RECALL, 166)
            found |= bool(((order[a] == size - 1) | (order[b] == size - 1)).any())
        lost += not found
    assert lost <= 0.01 * groups


def test_walk_stops_where_all_is_alike():
    from zonewright.llm.ngram_join import DEPTH, TREES, _walk, met

    rng = np.random.default_rng(12)
    sig = np.repeat(rng.integers(0, 256, (1, TREES * DEPTH), np.uint8), 6, axis=0)
    sig[3:, DEPTH - 1] += 1  # three rows part from the others at the last byte of the first tree
    walk = lambda threshold, recall: _walk(sig, sig[:, :DEPTH], np.zeros(6, int), np.full(6, -1), 6, threshold, recall, 170)
    assert len(walk(0.8, 0.9999)[0]) == 6  # 3 pairs on either side; the rest meet in other trees
    assert len(walk(0.8, 1.1)[0]) == 15  # a recall out of reach walks on to the shortest prefix
    assert met(0.8, 6) > 0.9999 > met(0.8, 8)


def test_jaccard_edge_cases(spark):
    assert jaccard_classes(docs_of(spark, [])).count() == 0
    got = jaccard_classes(docs_of(spark, [(1, "a b c d e f", "a"), (1, "a b c d e f", "a"), (None, "a b c d e f", "a"), (None, None, "a")])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id) == [(1, 1, 0)] * 2
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert prefix_depth(0.8, 0.9999) >= 5 and prefix_depth(0.1, 0.9999) == 1


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), str(rng.choice(["b", "a", "c"]))) for i in range(400)] + [(900, None, None), (901, "x y z " * 40, None), (902, "dup", "a"), (902, "dup", "a")]
    d = docs_of(spark, rows)
    got = mix(d, group=30).collect()
    assert sorted(got) == sorted(mix(d, group=30).collect()) and len(got) == len(rows)
    by = {r.source: r for r in targets(d.select("source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("size"))).collect()}
    assert abs(sum(r.target for r in by.values()) - 1.5 * sum(r.source_size for r in by.values())) < 1e-6
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in by.values())
    taken, source = Counter(), {i: s for i, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - r.target) <= 60 for s, r in by.items() if s)
    out = mixed(d, group=30)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in got)
    assert mix(docs_of(spark, [])).count() == 0 and mixed(docs_of(spark, [])).count() == 0


def test_targets_against_resharing_step_by_step(spark):
    rng = np.random.default_rng(13)
    for trial in range(6):
        sizes = {None if i == 0 else f"s{i:02d}": int(rng.integers(0, 400) ** (1 + trial % 2)) for i in range(int(rng.integers(1, 12)))}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
        while free:
            total = sum(weights[s] for s in free)
            over = {s for s in free if left * weights[s] / total > 2 * sizes[s]}
            for s in over or free:
                want[s] = 2.0 * sizes[s] if over else left * weights[s] / total
            left -= sum(want[s] for s in over)
            free = free - over if over else set()
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in targets(table).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_rounding_keeps_expectations(spark):
    d = docs_of(spark, [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)])
    seen = Counter()
    for seed in range(12):
        for r in mix(d, seed=seed, group=9).collect():
            seen[r.doc_id] += r.copies
    rate = {s: t for s, t in ((r.source, r.target / r.source_size) for r in targets(d.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("size"))).collect())}
    for s in "ab":
        mean = np.mean([seen[i] / 12 for i in range(60) if "ab"[i % 2] == s])
        assert abs(mean - rate[s]) < 0.12


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(P.STAGES)
    clean = stages["toxicity"](spark, d, sf_dir)
    assert clean.columns == d.columns
    single = stages["near_duplicates"](spark, clean, sf_dir)
    rows = [(r.doc_id, r.text, "") for r in clean.collect()]
    want = {c for _, c, _ in brute_classes(rows)}
    assert ids(single) == Counter(want)
    free = stages["decontamination"](spark, single, sf_dir)
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1) if w}
    bad = set()
    for r in single.collect():
        w = WORD.findall((r.text or "").lower())
        if any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1)):
            bad.add(r.doc_id)
    assert ids(free) == ids(single) - Counter(bad)
    mixture = stages["mixing"](spark, free, sf_dir)
    assert mixture.columns == d.columns and set(ids(mixture)) <= set(ids(free)) and max(ids(mixture).values()) <= 2
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and ids(out) == ids(mixture)
