"""Operator 4: URL filters by a bit-parallel wildcard automaton.

All rules are packed into multiword Shift-And masks: one bit per matched prefix of each rule. A step over
one byte is D = ((D << 1) & B[byte]) | (D & S[byte]), where S lets the states before a wildcard stay. The
steps run over whole Arrow batches of URLs at once, each URL leaving when its bytes end.

A rule is `host/path`: it fits the host and all its subdomains when the path starts with the rule's. In
the host `*` stands for any run of bytes without `/`, in the path for any run; `?` is one such byte. The
longest fitting rule wins, then the longer host, then block, then the earlier one.

Defined results: a null URL or one without `://` has empty host and path and gets the default verdict;
very long URLs are matched whole; repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read

Rule = tuple[str, str]  # (allow or block, host/path)
RULES: list[Rule] = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


class ShiftAnd:
    """Masks of all rules; matches() gives the winning rule of each text, or -1."""

    def __init__(self, rules: Sequence[Rule]):
        order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), -len(rules[i][1].split("/")[0]), rules[i][0] != "block", i))
        self.order = order
        states: list[tuple[int | None, str | None]] = []  # the byte that enters it (-1 any, -2 any but /), the wildcard after it
        starts, ends = [], []
        for i in order:
            host, slash, path = rules[i][1].partition("/")
            starts.append(len(states))
            states.append((None, "host"))
            for text, kind in (("." + host, "host"), (slash + path, "path")):
                for byte in text.encode():
                    if byte == ord("*"):
                        states[-1] = (states[-1][0], kind)
                    else:
                        any_byte = -2 if kind == "host" else -1
                        states.append((any_byte if byte == ord("?") else byte, None))
            states[-1] = (states[-1][0], "path")  # the rule's path is a prefix
            ends.append(len(states) - 1)
        self.width = max(1, -(-len(states) // 64))
        enter, stay = np.zeros((256, self.width), np.uint64), np.zeros((256, self.width), np.uint64)
        for s, (byte, star) in enumerate(states):
            word, bit = s // 64, np.uint64(1 << s % 64)
            if byte is not None:
                enter[slice(None) if byte < 0 else byte, word] |= bit
                if byte == -2:
                    enter[ord("/"), word] &= ~bit
            if star:
                stay[:, word] |= bit
                if star == "host":
                    stay[ord("/"), word] &= ~bit
        self.enter, self.stay = enter, stay
        self.start = np.zeros(self.width, np.uint64)
        for s in starts:
            self.start[s // 64] |= np.uint64(1 << s % 64)
        self.ends = ends

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        if not len(raw):
            return np.zeros(0, np.int64)
        by_size = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        at = (np.cumsum(size) - size)[by_size]
        size = size[by_size]
        d = np.tile(self.start, (len(raw), 1))
        # Texts stand by falling length, so those that still have a byte are a prefix.
        left = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if size[0] else []
        for step, n in enumerate(left):
            byte, now = data[at[:n] + step], d[:n]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:n] = (shifted & self.enter[byte]) | (now & self.stay[byte])
        won = np.full(len(raw), -1, np.int64)
        for rule, s in zip(reversed(self.order), reversed(self.ends), strict=True):
            won[(d[:, s // 64] >> np.uint64(s % 64)) & np.uint64(1) == 1] = rule
        out = np.empty_like(won)
        out[by_size] = won
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (the rule's, else `default`)."""
    texts, verdicts = [r for _, r in rules], [v for v, _ in rules]

    @F.pandas_udf("int")
    def winner(canonical: pd.Series) -> pd.Series:
        return pd.Series(ShiftAnd(rules).matches(canonical.tolist()), dtype="int32")

    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    out = out.withColumn("__won", winner(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    pick = lambda values: F.get(F.array(*map(F.lit, values)).cast("array<string>"), F.col("__won"))
    return out.withColumn("rule", pick(texts)).withColumn("verdict", F.coalesce(pick(verdicts), F.lit(default))).drop("__won")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
w AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM w
"""
