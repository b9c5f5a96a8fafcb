"""Nulls, repeated and very long rows, and clashing columns, through the operators and their SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zonewright.llm import decontaminate, line_dedup
from zonewright.llm.chat_format import format_conversations, parse
from zonewright.llm.lm_score import encode, fit, score
from zonewright.llm.mixing import mix, mixed
from zonewright.llm.ngram_join import jaccard_classes, one_of_each_class
from zonewright.llm.token_output import byte_bpe, token_output
from zonewright.llm.toxicity import toxicity, without_toxic

TEXT = "one two three four five six seven eight nine ten eleven twelve"
LONG = "w" * 100_000 + " " + " ".join(f"x{i}" for i in range(30_000))
# The SQL takes time in the square of a text's length.
MID = "w" * 20_000 + " " + " ".join(f"x{i}" for i in range(1_500))
ODD = [(1, TEXT), (1, TEXT), (1, "other words of it"), (None, TEXT), (None, None), (2, ""), (3, MID), (3, MID + " " + TEXT), (4, "Line\n line \nlast"), (None, "line\nlast")]


def table(spark, rows=ODD, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({k: F.lit(v) for k, v in more.items()})


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return Counter(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in got.fetchall())


def in_order(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def arrow(rows, names):
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})


def test_op1_and_its_sql_on_odd_rows(spark, tmp_path):
    items = [(7, TEXT), (8, "of it"), (9, None), (10**15, TEXT + " thirteen")]
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = in_order(decontaminate.op1_decontaminate(spark, str(tmp_path)))
    assert got == by_sql(decontaminate.OP1_SQL, documents=arrow(ODD, ["doc_id", "text"]), benchmark=arrow(items, ["item_id", "text"]))
    assert got.total() == len(ODD)
    left = decontaminate.remove_contaminated(table(spark, key=1, gram=2, w=3), spark.createDataFrame([("i" * 5000, TEXT)], "item_id string, text string"))
    assert left.columns == ["doc_id", "text", "key", "gram", "w"] and left.count() == 6


def test_op2_and_its_sql_on_odd_rows(spark, tmp_path):
    rows = ODD + [(5, "deep\n" + "y" * 200_000)] * 11 + [(None, "deep")] * 2
    table(spark, rows, h=1, n=2).write.parquet(f"{tmp_path}/documents.parquet")
    got = in_order(line_dedup.op2_line_dedup(spark, str(tmp_path)))
    assert got == by_sql(line_dedup.OP2_SQL, documents=arrow(rows, ["doc_id", "text"])) and sum(r[2] > 0 for r in got.elements()) == 13


def test_op3_on_repeated_rows_of_many_partitions(spark):
    rows = table(spark, [(3, "same text")] * 40 + [(None, None)] * 3 + [(1, LONG)], part=1, seq=2).repartition(9)
    got = sorted(token_output(rows, byte_bpe(), shard_tokens=20_000).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 3 + [1] + [3] * 40
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert len({(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 3}) == 1 and got[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def test_op5_on_repeated_and_long_rows(spark):
    rows = [(i, ("calm words here " if i % 2 else "you fool ") * (i % 7 + 1)) for i in range(80)] * 2 + [(None, LONG), (500, LONG * 3), (501, None)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(80)] * 2, "doc_id long, toxic int")
    d = table(spark, rows, t=1, h=2)
    got = toxicity(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(len({r.score for r in got if r.doc_id == i}) == 1 for i in range(80))
    assert without_toxic(d, labels).columns == ["doc_id", "text", "t", "h"]


def test_op6_on_a_conversation_numbered_as_the_forgery(spark):
    rows = [(-1, 0, "user", "hello"), (-1, 1, "assistant", "x" * 200_000), (None, 0, "user", None)] + [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]
    got = {r.conv_id: parse(r.formatted) for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[-1] == [("user", "hello"), ("assistant", "x" * 200_000)] and len(got[5]) == 300 and got[None] == [("user", "")]


def test_op7_on_odd_rows(spark):
    rows = [*ODD, *[(i, f"a b c d{i % 3} e f") for i in range(30)] * 2]
    encoded, counts = encode(table(spark, rows, ids=1, own=2, block=3))
    got = score(encoded, fit(encoded, counts)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and sum(r.n_tokens for r in got) == counts.sum()
    assert all(len({round(r.log_prob, 6) for r in got if r.doc_id == i}) == 1 for i in range(10, 30))


def test_op9_on_odd_rows(spark):
    d = table(spark, sid=1, hash=2, h=3, root=4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(d).collect())
    assert got[(1, 1, 0)] == 3 and got[(None, 1, 0)] == 1 and got.total() == len(ODD)
    assert got[(3, 3, 1)] == 2  # the long texts are alike
    kept = one_of_each_class(d)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, None, 2, 3, 4, None])


def test_op10_on_odd_rows(spark):
    d = table(spark, ODD, x=1, u=2, grp=3).withColumn("source", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise("s"))
    got = mix(d).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert max(r.size for r in got) == 1_513 and mixed(d).columns == d.columns
