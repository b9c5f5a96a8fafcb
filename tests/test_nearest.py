"""The nearest names by edit distance, and encoded names row by row, against brute force."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from zonewright.functions import idna as I
from zonewright.operators import candidates as C
from zonewright.plans import catalogue, search
from zonewright.plans import views as V


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    label = lambda n: "".join(rng.choice(list("abcd-"), n))
    names = [(f"xn--{label(rng.integers(0, 30))}", ("com", "net", "org")[i % 3], int(20240101 + rng.integers(9))) for i in range(400)]
    names = list({f"{x}.{t}": (f"{x}.{t}", t, x, d) for x, t, d in names}.values()) + [("null.com", "com", None, 1)]
    brands = [(1, "abcab"), (2, "ddddddddddddddddddd"), (3, "a"), (4, ""), (5, None), (6, "xn--abcd")]
    n = spark.createDataFrame(names, "name string, tld string, label string, added_day int")
    b = spark.createDataFrame(brands, "brand_id int, brand_label string")
    for most in (1, 5, 40, 500):
        limit = lambda tld: F.when(tld == "com", most).otherwise(3)  # noqa: B023, E731
        got = C.nearest_by_edits(n, b, limit)
        want = set()
        for i, brand in brands:
            for tld in ("com", "net", "org"):
                if brand is not None:
                    rows = sorted((edits(x, brand), -d, name) for name, t, x, d in names if t == tld and x is not None)
                    want |= {(i, name, dist) for dist, _, name in rows[: most if tld == "com" else 3]}
        rows = [(r.brand_id, r.name, r.distance) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert C.nearest_by_edits(n.limit(0), b, limit).collect() == []
    assert C.nearest_by_edits(n, b.limit(0), limit).collect() == []


def test_steps_end_early_and_join_on_keys(spark, monkeypatch):
    """Where the limit is reached within a short distance, longer names are never paired."""
    n = spark.createDataFrame([(f"{'a' * k}{i}.com", "com", f"{'a' * k}{i}", 1) for i in range(10) for k in (3, 50)], "name string, tld string, label string, added_day int")
    b = spark.createDataFrame([(1, "aaa")], "brand_id int, brand_label string")
    made = []
    real = C.Z.stored
    monkeypatch.setattr(C.Z, "stored", lambda df, name: made.append((name, plan_of(df))) or real(df, name))
    assert {r.distance for r in C.nearest_by_edits(n, b, lambda t: F.lit(10)).collect()} == {1}
    assert [m[0] for m in made].count("nearest") == 1
    assert all("NestedLoop" not in p and "Cartesian" not in p for _, p in made)


def test_known_seeds_and_look_alikes_row_by_row(spark, sf_dir):
    """GEN04 and JOB03 against plain loops over the codec."""
    brands = V.company(spark, sf_dir).collect()
    want = set()
    for r in brands:
        made = 0
        for i, c in enumerate(r.brand_label):
            looks = [x for x, letter in I.LOOKALIKES.items() if letter == c]
            if made < 30:
                want |= {(r.brand_id, v) for x in looks if (v := I._encode(r.brand_label[:i] + x + r.brand_label[i + 1 :])).startswith("xn--")}
            made += len(looks)
    got = catalogue.queries()["GEN04_homograph_seeds"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)

    zone = search.zone_idn(spark, sf_dir).collect()
    found = {(r.brand_id, r.name): r for r in catalogue.queries()["JOB03_ring_c_punycode"](spark, sf_dir).collect()}
    limits = {"com": 2000, "net": 1500, "org": 1500}
    pairs = set()
    for brand_id, brand, _, _ in V.BRANDS:
        for tld in V.TLDS:
            rows = sorted((edits(r.label, brand), -r.added_day, r.name) for r in zone if r.tld == tld)
            pairs |= {(brand_id, name) for _, _, name in rows[: limits.get(tld, 1200)]}
    assert set(found) == pairs
    labels = {r.name: r.label for r in zone}
    for brand_id, brand, _, _ in V.BRANDS:
        base = I.plain_letters(brand)
        for (b, name), r in found.items():
            if b == brand_id:
                plain = I.plain_letters(I._decode(labels[name]))
                far = max(len(plain), len(base))
                assert abs(r.score_homograph - (1 - edits(plain, base) / far if far else 0)) < 1e-9
                assert ("homograph_attack" in r.reasons) <= (r.score_homograph >= 0.95)


def test_far_names_are_paired_twice_whatever_their_distance(spark, monkeypatch):
    """Counted, then put in order; not anew for each step of a growing reach."""
    n = spark.createDataFrame([(f"{'b' * (20 + i % 9)}{i}.com", "com", f"{'b' * (20 + i % 9)}{i}", i % 3) for i in range(90)], "name string, tld string, label string, added_day int")
    b = spark.createDataFrame([(1, "aaa"), (2, "a" * 30)], "brand_id int, brand_label string")
    made = []
    real = C.Z.stored
    monkeypatch.setattr(C.Z, "stored", lambda df, name: made.append(name) or real(df, name))
    got = {(r.brand_id, r.name) for r in C.nearest_by_edits(n, b, lambda t: F.lit(20)).collect()}
    rows = n.collect()
    assert got == {(i, x) for i, brand in ((1, "aaa"), (2, "a" * 30)) for _, _, x in sorted((edits(r.label, brand), -r.added_day, r.name) for r in rows)[:20]}
    assert made.count("nearest") == 1


def test_encoded_labels_as_the_codec_has_them():
    def whole(label):
        try:
            return label.encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    parts = [chr(i) for i in range(0xA0, 0x3100, 7)] + ["a", "ss", "ß", "́", "­", "。", "ا", "xn--"]
    labels = [x + y for x in parts for y in ("", "b", "́")] + ["é" * k for k in (40, 56, 57, 58, 59, 60, 63, 64)]
    assert [I._encode(x) for x in labels] == [whole(x) for x in labels]
