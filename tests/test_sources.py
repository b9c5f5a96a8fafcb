"""Zone files, resuming by file, and suffix rules."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from zonewright.functions import labels as L
from zonewright.operators import lake as O
from zonewright.operators.suffixes import registrable_parts
from zonewright.sources import zones as Z


def test_gzipped_zone_files(spark, tmp_path):
    folder = tmp_path / "tld=com"
    folder.mkdir()
    lines = [b"; comment", b"", b"COM. 1 in soa x", b"  Bank.COM. 86400 in ns a.", b"*.bank.com. 1 in a x", b"a.b.com.\t1 in ns x", b"caf\xe9.com. 1 in ns x", b"other.net. 1 in ns x"]
    (folder / "part-1.txt.gz").write_bytes(gzip.compress(b"\n".join(lines)))
    (folder / "part-2.txt").write_bytes(b"bank.com. 1 in ns b.\nsecond.com.")
    rows = Z.read_zone_files(spark, str(tmp_path))
    assert {r.tld for r in rows.collect()} == {"com"}
    names = Z.zone_names(rows, F.col("tld"))
    assert sorted(r.name for r in names.collect()) == ["a.b.com", "bank.com", "café.com", "second.com"]
    Z.stage_buckets(names, str(tmp_path / "staged"), 4, L.stable_shard)
    staged = spark.read.parquet(str(tmp_path / "staged"))
    assert sorted((r.name, r.shard) for r in staged.collect()) == sorted((r.name, r.s) for r in names.withColumn("s", L.stable_shard(F.col("name"), 4)).collect())
    assert len(list((tmp_path / "staged").glob("shard=*/*.parquet"))) == staged.select("shard").distinct().count()


def test_written_zone_files_come_back(spark, tmp_path):
    lines = spark.createDataFrame([("a.com. 1 in ns x", "com"), ("b.com.br. 1 in ns x", "com.br")], "value string, tld string")
    Z.write_zone_files(lines, str(tmp_path / "z"))
    assert list((tmp_path / "z" / "tld=com").glob("*.gz"))
    assert sorted(map(tuple, Z.read_zone_files(spark, str(tmp_path / "z")).collect())) == sorted(map(tuple, lines.collect()))


def test_files_loaded_within_a_day_are_left_out(spark, tmp_path):
    now = datetime.datetime(2024, 1, 31, 12)
    key = ("czds", "com", "2024-01-31", "domain_com")
    files = spark.createDataFrame([(*key, s) for s in "abcde"], "source string, tld string, snapshot_date string, partition string, shard_key string")
    loads = [("a", "completed", 23), ("b", "completed", 25), ("c", "failed", 1), ("d", "completed", 24), ("a", "failed", 1), ("e", "completed", 2)]
    done = [(*key, s, status, now - datetime.timedelta(hours=h)) for s, status, h in loads[:-1]]
    # The same file for another partition says nothing.
    done.append(("czds", "com", "2024-01-31", "domain_removed_com", "e", "completed", now - datetime.timedelta(hours=2)))
    left = Z.pending_files(files, spark.createDataFrame(done, Z.CHECKPOINT), F.lit(now))
    assert sorted(r.shard_key for r in left.collect()) == ["b", "c", "d", "e"]
    assert Z.pending_files(files, spark.createDataFrame([], Z.CHECKPOINT), F.lit(now)).count() == 5


def test_files_are_listed_unopened(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "f"))
    (tmp_path / "f" / "broken.parquet").write_bytes(b"no parquet")
    rows = Z.list_files(spark, str(tmp_path / "f")).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} >= {"broken.parquet"} and all(r.bytes > 0 and r.modified for r in rows)


def test_partial_loads(spark, tmp_path):
    added, removed, target = (str(tmp_path / n) for n in ("added", "removed", "target"))
    spark.createDataFrame([(f"{n}.{t}", n, t) for n in "ab" for t in ("com", "net", "org")] + [(None, None, "com")], O.ADDED_FILE).write.partitionBy("tld").parquet(added)
    report = lambda: {r.tld: (r.added_loaded, r.removed_loaded, r.status, r.recovery_type) for r in O.load_delta_files(spark, added, removed, target, 20240131).collect()}
    gone = lambda: sorted((r.name, r.removed_day) for r in spark.read.parquet(f"{target}/domain_removed").collect())
    assert report() == {t: (2, 0, "ok", None) for t in ("com", "net", "org")}
    days = [("x.com", "20240130", "com"), ("y.com", None, "com"), ("x.net", "20240130", "net"), ("y.net", "soon", "net"), ("x.org", "20240130", "org"), ("x.de", "20240130", "de")]
    spark.createDataFrame(days, O.REMOVED_FILE).write.partitionBy("tld").parquet(removed)
    (tmp_path / "removed" / "tld=org" / "broken.parquet").write_bytes(b"no parquet")
    want = {"com": (2, 2, "ok", None), "net": (2, 2, "recovered", "removed_sanitised_retry"), "org": (2, 0, "partial", "removed_unrecoverable"), "de": (0, 1, "ok", None)}
    rows = [("x.com", 20240130), ("x.de", 20240130), ("x.net", 20240131), ("y.com", 20240131), ("y.net", 20240131)]
    for _ in range(2):
        assert report() == want and gone() == rows
    # Once the file is mended the rest comes, and nothing twice.
    (tmp_path / "removed" / "tld=org" / "broken.parquet").unlink()
    assert report()["org"] == (2, 1, "ok", None) and gone() == sorted([*rows, ("x.org", 20240130)])
    assert spark.read.parquet(f"{target}/domain").count() == 6


RULES = ["com", "br", "com.br", "*.ck", "!www.ck", "uk", "co.uk", "github.io", "io", "*.compute.example", "// note", "", " net  extra"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("www.ck", ("www.ck", "www", "ck")),
        ("a.www.ck", ("www.ck", "www", "ck")),
        ("a.b.ck", ("a.b.ck", "a", "b.ck")),
        ("b.ck", ("b.ck", "b", "ck")),
        ("x.y.co.uk", ("y.co.uk", "y", "co.uk")),
        ("co.uk", ("co.uk", "co", "uk")),
        ("me.github.io", ("me.github.io", "me", "github.io")),
        ("github.io", ("github.io", "github", "io")),
        ("a.eu.compute.example", ("a.eu.compute.example", "a", "eu.compute.example")),
        ("a.b.net", ("b.net", "b", "net")),
        ("a.co.nz", ("a.co.nz", "a", "co.nz")),
        ("a.b.unknown", ("b.unknown", "b", "unknown")),
        ("xcom.br", ("xcom.br", "xcom", "br")),
        ("single", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_suffix_rules(spark, name, want):
    d = spark.createDataFrame([(name,)], "name string")
    rules = spark.createDataFrame([(r,) for r in [*RULES, "com"]], "rule string")
    r = registrable_parts(d, rules).first()
    assert (r.registrable_domain, r.registrable_label, r.public_suffix) == want
    # Without rules the library's own rule stands.
    r = registrable_parts(d, rules.limit(0)).first()
    plain = d.select(L.registrable_domain(F.col("name")), L.registrable_label(F.col("name")), L.public_suffix(F.col("name"))).first()
    assert (r.registrable_domain, r.registrable_label, r.public_suffix) == tuple(plain)
