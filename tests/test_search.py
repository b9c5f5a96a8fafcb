import pytest

from zonewright.operators.search import Search, search_page, search_results
from zonewright.plans.names import KEYS

NAMES = "name string, tld string, label string, added_day int"


def names(spark, *rows):
    return spark.createDataFrame([(f"{label}.{tld}", tld, label, day) for label, tld, day in rows], NAMES)


def test_encoded_look_alike_is_found_as_it_is_read(spark):
    zone = names(spark, ("xn--brdesco-3fg", "com", 20260101), ("bradesco", "com", 20260101), ("other", "com", 20260101))
    got = {r.domain: r for r in search_results(zone, Search("bradesco.com.br", min_score=0.5), KEYS).collect()}
    assert set(got) == {"xn--brdesco-3fg.com", "bradesco.com"}
    assert "homograph_attack" in got["xn--brdesco-3fg.com"].reasons
    assert got["xn--brdesco-3fg.com"].score >= 0.5 and got["xn--brdesco-3fg.com"].source == "czds"
    assert str(got["bradesco.com"].observed_at) == "2026-01-01" and got["bradesco.com"].ownership == "third_party_unknown"


def test_arguments(spark):
    zone = names(spark, ("google", "com.br", 20260101), ("google-login", "net", 20260101), ("a.google", "net", 20260102), ("google", "org", None), ("giogle", "com", 20250101), ("xyzgooglexyzxyz", "net", 20250102))
    found = lambda **kw: {r.domain for r in search_results(zone, Search("Google.com.br", min_score=0.4, **kw), KEYS).collect()}
    assert found() == {"google.com.br", "google-login.net", "google.org", "giogle.com"}
    assert found(include_subdomains=True, tld_allowlist=("net", "org")) >= {"google-login.net", "a.google.net", "google.org"}
    assert "google.com.br" not in found(exclude_official=True)
    assert found(sources=("openintel",)) == set()
    assert found(sources=("czds", "openintel")) == found()
    # Typos alone: the label itself is no typo of its own.
    assert {r.domain for r in search_results(zone, Search("google.com", ("typo",), 0.5), KEYS).collect()} == {"giogle.com"}
    with pytest.raises(ValueError):
        search_results(zone, Search("google.com", ("vector",)), KEYS)
    with pytest.raises(ValueError):
        search_results(zone, Search("no domain"), KEYS)


def test_pages(spark):
    zone = names(spark, *[(f"google{i:03}", "com", 20240101 + i % 20) for i in range(70)])
    whole = [r.domain for r in search_page(zone, Search("google.com", min_score=0.1, max_results=100), KEYS).collect()]
    assert len(whole) == 70
    page = search_page(zone, Search("google.com", min_score=0.1, max_results=20, offset=30), KEYS).collect()
    assert [r.domain for r in page] == whole[30:50]
    assert {(r.total, r.has_more) for r in page} == {(70, True)}


def test_scans_are_bounded_and_newest_encoded_names_come_first(spark):
    zone = names(spark, *[(f"xn--a{i}-_", "com", 20240101 + i % 3) for i in range(700)], ("xn--brdesco-3fg", "com", 20200101))
    two = "br\u00e4desc\u00f6".encode("idna").decode()
    zone = zone.unionByName(names(spark, (two, "com", 20200101)))
    # The encoded scan stops at 600 newer names; the lexical one still finds what is a typo in letters beyond ASCII.
    found = lambda z: {r.domain for r in search_results(z, Search("bradesco.com", ("typo",), 0.5), KEYS).collect()}
    assert found(zone) == {"xn--brdesco-3fg.com"}
    assert found(zone.filter("added_day < 20240101")) == {"xn--brdesco-3fg.com", f"{two}.com"}
