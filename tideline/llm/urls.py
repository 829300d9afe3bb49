"""URL filters: rules by longest fit, and a Bloom filter cascade over the corpus's hosts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, written

BITS_PER_KEY = 12
PROBES = 4
# Bits of all levels of one cascade, sent to the tasks (8 MB); a larger universe is cut by a hash of its keys.
MAX_CASCADE_BITS = 1 << 26
# Cuts of the universe that ever follow one another; each halves it.
MAX_CUTS = 12


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (the first listed of equally long ones), or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits)) for i in range(PROBES)]


def _bits(keys: DataFrame, level: int, n_bits: int) -> bytes:
    """The level's bit array, 64-bit words or-ed together by partial aggregates; at most n_bits / 64 rows come back."""
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), level, n_bits))).alias("bit"))
    words = spots.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(n_bits // 64, "<i8")
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def _in_level(key: Column, level: int, bits: bytes) -> Column:
    """Whether all of the key's bits are set. The array is one binary literal, named once in the expression."""
    table = F.lit(bits)

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(table, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0

    return F.forall(F.array(*_positions(key, level, len(bits) * 8)), is_set)


@dataclass(frozen=True)
class Cascade:
    """Levels of bits. A key of the universe is listed if the first level that lacks it is an even one."""

    levels: tuple[bytes, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over; null is not listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            answer = F.when(_in_level(key, level, self.levels[level]), answer).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def build_cascade(universe: DataFrame, max_bits: int = MAX_CASCADE_BITS) -> Cascade | None:
    """From ``universe`` (key, listed; distinct keys): level 0 holds the listed keys, level 1 the unlisted
    ones that level 0 lets pass, level 2 the listed ones that level 1 lets pass, until none pass.

    Only bits reach the driver, a dozen per listed key. None if they exceed ``max_bits``.
    """
    universe = written(universe.where(F.col("key").isNotNull()))
    levels: list[bytes] = []
    inside, outside = universe.where("listed"), universe.where(~F.col("listed"))
    spent = 0
    while True:
        n_keys = inside.count()
        if n_keys == 0:
            return Cascade(tuple(levels))
        n_bits = max(1, -(-n_keys * BITS_PER_KEY // 64)) * 64
        spent += n_bits
        if spent > max_bits:
            return None
        level = len(levels)
        levels.append(_bits(inside, level, n_bits))
        inside, outside = outside.where(_in_level(F.col("key"), level, levels[level])), inside


def _cut(key: Column, cuts: int) -> Column:
    """Which of 2^cuts parts of the universe a key is in; null is in the first."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit("cut"), key), F.lit(1 << cuts)), F.lit(0))


def mark_listed(rows: DataFrame, universe: DataFrame, key_col: str, max_bits: int = MAX_CASCADE_BITS) -> DataFrame:
    """The rows with ``listed``: whether ``universe`` (key, listed) lists their key, by cascades and without a join.

    A universe whose bits exceed ``max_bits`` is cut by a hash of the keys until each part's
    cascade fits. Rows are then written by part, hot keys in as many files as there were tasks,
    and each part is judged by its own cascade alone, so no task holds more than one.
    """
    whole = build_cascade(universe, max_bits)
    if whole is not None:
        return rows.withColumn("listed", whole.contains(F.col(key_col)))
    # A cascade has one word at least.
    max_bits = max(max_bits, 64)
    part = fresh("part", rows.columns)
    bits = universe.where("listed").count() * BITS_PER_KEY
    cuts = max(1, (-(-bits // max_bits) - 1).bit_length())
    while cuts <= MAX_CUTS:
        pieces = written(universe.where(F.col("key").isNotNull()).withColumn("cut", _cut(F.col("key"), cuts)), "cut")
        held = [build_cascade(pieces.where(F.col("cut") == i), max_bits) for i in range(1 << cuts)]
        if None not in held:
            break
        cuts += 1
    else:
        raise ValueError("keys can't be told apart by so few bits")
    stored = written(rows.withColumn(part, _cut(F.col(key_col), cuts)), part)
    judged = [written(stored.where(F.col(part) == i).withColumn("listed", cascade.contains(F.col(key_col)))) for i, cascade in enumerate(held)]
    return reduce(DataFrame.unionByName, judged).drop(part)


def listed_hosts(hosts: DataFrame, names: list[str]) -> DataFrame:
    """The universe: every distinct host (``key``), listed if one of its labels is a listed name."""
    labels = F.split(F.col("key"), r"\.")
    return hosts.distinct().select("key", F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names])).alias("listed"))


def judge(pages: DataFrame, rules: list[Rule], names: list[str], id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_CASCADE_BITS) -> DataFrame:
    """Per page: page_id, host, path, rule, listed, verdict.

    A rule's verdict comes first; else a page is blocked if its host is listed,
    which the cascade answers exactly without a join; for more hosts than one cascade
    may hold there are several.

    Defined for odd input: a null url or one without ``://`` has empty host and
    path, fits no rule and is allowed; repeated rows are judged alike.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = listed_hosts(parts.select(F.col("host").alias("key")), names)
    marked = mark_listed(parts, universe, "host", max_bits)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", name.alias("rule"), "listed", F.coalesce(verdict, by_method).alias("verdict"))
