"""URL filters: a Bloom filter cascade over the corpus's whole key universe, DataFrame functions only.

Level 0 holds the listed keys; level 1 the other keys of the universe that level 0 takes for listed; level 2 the listed
keys that level 1 takes for its own, and so on until a level errs on nothing. Membership is then exact for every key of
the universe, and probing is arithmetic on literals: no join. With a first error rate near listed / others and one half
from then on, all levels together hold a few bits per listed key, however large the corpus is.

Nulls: a null url has empty host and path, fits no rule and is allowed. Empty tables give empty results. Repeated rows
are judged alike. Other columns pass through unread; results carry only the columns named by the operator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm.shared import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: m bits in 64-bit words, k probes; `seed` keeps levels independent."""

    seed: int
    m: int
    k: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.m))
        step = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.m))
        return [F.pmod(first + step * i, F.lit(self.m)) for i in range(self.k)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # a literal after constant folding
        tests = [F.getbit(F.element_at(words, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.holds(key) & ~out
        return F.coalesce(out, F.lit(False))

    @property
    def bits(self) -> int:
        return sum(x.m for x in self.levels)


def _level(keys: DataFrame, n: int, error: float, seed: int, max_bytes: int) -> Level:
    m = max(64, math.ceil(n * math.log(1 / error) / math.log(2) ** 2))
    if m > 8 * max_bytes:
        raise ValueError(f"a level of {n} keys needs {m // 8} bytes; at most {max_bytes} are sent to executors: split the list by a hash of the key")
    empty = Level(seed, m, max(1, round(math.log2(1 / error))), ())
    rows = (
        keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
        .groupBy((F.col("p") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        .collect()  # at most m / 64 words, checked above
    )
    words = [0] * (m // 64 + 1)
    for r in rows:
        words[r.w] = r.b
    return Level(seed, m, empty.k, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 4 << 20, max_levels: int = 60) -> Cascade:
    """Cascade of the column `key` of `listed` that errs on no `key` of `universe`. Null keys are left out.

    No listed keys: a cascade that contains nothing. What reaches the driver, and is a literal of the plan, is the filters,
    at most `max_bytes` a level (ValueError beyond it) and little more in all, as each level holds fewer keys.
    """
    inside = cut_lineage(listed.select("key").where("key IS NOT NULL").distinct())
    n = inside.count()
    if not n:
        return Cascade(())
    outside = cut_lineage(universe.select("key").where("key IS NOT NULL").distinct().join(inside, "key", "left_anti"))
    others = outside.count()
    levels: list[Level] = []
    error = min(0.5, math.sqrt(0.5) * n / max(others, 1))
    while n:
        if len(levels) == max_levels:
            raise ValueError("the cascade does not end; keys may not be distinct")
        levels.append(_level(inside, n, error, len(levels) + 1, max_bytes))
        wrong = cut_lineage(outside.where(levels[-1].holds(F.col("key"))))
        inside, outside, n, error = wrong, inside, wrong.count(), 0.5
    return Cascade(tuple(levels))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; then up to `?`, `#` or the end."""
    part = lambda i: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], hosts: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url", max_bytes: int = 4 << 20) -> DataFrame:
    """Verdict on each url: columns id, host, path, rule, verdict.

    `rules` are (action, host, path) with action block or allow; a rule fits its host and all subdomains when the path
    starts with the rule's. The longest fitting rule (host and path together; of equally long ones the greater string)
    wins. Where none fits, a url whose host is one of `hosts`, or a subdomain of one, is blocked, and others are allowed.
    Each list becomes a cascade over all keys that the corpus's urls can be probed with.
    """
    spark = df.sparkSession
    host, path = split_url(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    probes = [F.when(F.length("path") >= q, F.concat(_suffix(F.col("host"), n), F.substring("path", 1, q))) for n, q in shapes]
    tails = [F.when(F.col("host") != "", _suffix(F.col("host"), n)) for n in sorted({h.count(".") + 1 for h in hosts})]

    # the short keys that urls can be probed with, each once, for all lists
    asked = parts.select(F.explode(F.array(*[F.struct(F.lit(True).alias("ruled"), p.alias("key")) for p in probes], *[F.struct(F.lit(False).alias("ruled"), p.alias("key")) for p in tails])).alias("k")) if probes or tails else None
    universe = cut_lineage(asked.select("k.ruled", "k.key").where("key IS NOT NULL").distinct()) if asked is not None else None

    def cascade(keys: Sequence[str], ruled: bool) -> Cascade:
        return build_cascade(_keys(spark, keys), universe.where(F.col("ruled") == ruled), max_bytes) if keys else Cascade(())

    lists = {a: cascade(sorted({h + p for x, h, p in rules if x == a}), True) for a in ("block", "allow")}
    banned = cascade(sorted(set(hosts)), False)
    listed = lambda k: lists["block"].contains(k) | lists["allow"].contains(k)
    fits = F.transform(F.filter(F.array(*probes), listed), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule")))
    rule = F.array_max(fits)["rule"] if probes else F.lit(None).cast("string")
    bad = F.exists(F.array(*tails), banned.contains) if tails else F.lit(False)
    verdict = F.when(F.col("rule").isNotNull(), F.when(lists["block"].contains(F.col("rule")), "block").otherwise("allow")).when(bad, "block").otherwise("allow")
    return parts.withColumn("rule", rule).select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def _keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
