"""URL filter by a Bloom filter cascade, with DataFrame functions only.

A list holds keys host + path (`example.org/es/`).  A key fits its host and all subdomains, if the url's
path starts with the key's.  So a url's candidate keys are its host's endings with as many labels as
listed hosts have, each with its path's beginnings as long as listed paths are; the url is
listed if one of them is.  Those candidates over the whole corpus are the key universe.

Level 1 of the cascade is a Bloom filter of the listed keys.  Its false positives over the complete
universe go into level 2, the listed keys that level 2 wrongly holds into level 3, and so on until a
level errs on nothing: membership is then exact for every key of the corpus, by bit tests in the row,
without joins.  Level 1's size follows from |listed| and the (approximate) size of the universe such
that about as many false positives as listed keys are left; all levels together take some
|listed| * log2(|universe| / |listed|) bits, at most MAX_BYTES, which is checked: that is the bound of
what is sent to the tasks.  The universe is never shuffled, only what passes level 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import stored

MAX_BYTES = 64 << 20
BUCKET_BITS = 32_768  #: of Spark's bitmap functions
RATE = 1 / 16  #: of false positives of the levels after the first

#: The rules of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The query's list: host and path of every url of the table whose query holds this mark of a referral.
LISTED_BY = "ref="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to / ? # or the end, A-Z lower-cased.  Path: from there up to ? # or the
    end.  Both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_key(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host, slash + path


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The url's candidate keys, an array in which each comes once."""
    parts = F.split(host, r"\.", -1)
    ends = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: path.substr(F.lit(1), k))
    keys = F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat(e, b)))))
    return F.when((host != "") & F.lit(bool(labels and lengths)), keys).otherwise(F.array().cast("array<string>"))


class Level:
    """A Bloom filter: its bits as a binary value, tested by built-in functions."""

    def __init__(self, bits: bytes, size: int, hashes: int, salt: int):
        self.bits, self.size, self.hashes, self.salt = bits, size, hashes, salt

    def places(self, key: Column, use) -> Column:
        """use(number) for the places of a key, from 1 on as Spark's bitmap functions count them: two hashes, and steps of the second."""
        size = F.lit(self.size).cast("long")
        start, step = (F.pmod(F.xxhash64(key, F.lit(2 * self.salt + i)), size - i) + i for i in (0, 1))
        steps = F.sequence(F.lit(0), F.lit(self.hashes - 1))
        return F.transform(F.array(F.struct(start.alias("a"), step.alias("b"))), lambda h: use(steps, lambda i: F.pmod(h["a"] + i * h["b"], size) + 1))[0]

    @classmethod
    def build(cls, keys: DataFrame, count: int, rate: float, salt: int) -> Level:
        """keys(key) into a filter with about this false-positive rate."""
        size = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
        size = -(-size // 8) * 8
        if size // 8 > MAX_BYTES:
            raise ValueError(f"a filter of {size // 8} bytes is above the bound; split the list")
        level = cls(b"", size, max(1, min(24, round(size / max(count, 1) * math.log(2)))), salt)
        place = F.explode(level.places(F.col("key"), F.transform))
        rows = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        rows = rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # size / 8 bytes at most
        bits = bytearray(-(-size // BUCKET_BITS) * (BUCKET_BITS // 8) + BUCKET_BITS // 8)
        for r in rows:
            begin = (r["bucket"] - 1) * (BUCKET_BITS // 8)
            bits[begin : begin + len(r["bits"])] = r["bits"]
        level.bits = bytes(bits[: -(-size // 8) + 1])
        return level

    def holds(self, key: Column) -> Column:
        bits = F.lit(self.bits)

        def set_(place: Column) -> Column:
            bit, bucket = F.bitmap_bit_position(place), F.bitmap_bucket_number(place)
            byte = ((bucket - 1) * (BUCKET_BITS // 8) + F.floor(bit / 8) + 1).cast("int")
            value = F.conv(F.hex(F.substring(bits, byte, F.lit(1))), 16, 10).cast("int")
            return F.getbit(value, (bit % 8).cast("int")) == 1

        return self.places(key, lambda steps, place: F.forall(steps, lambda i: set_(place(i))))


class Cascade:
    """Exact membership in the list for every key of the universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed(key), universe(key); both may repeat keys and hold nulls, which count as no keys."""
        listed = stored(listed.filter("key is not null").distinct(), "listed")
        count = listed.count()
        if not count:
            return cls([])
        others = universe.filter("key is not null")
        size = others.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        rate = min(0.5, max(count, 1) * math.sqrt(0.5) / max(size, 1))
        level = Level.build(listed, count, rate, 1)
        levels = [level]
        wrong = others.filter(level.holds(F.col("key"))).groupBy("key").agg(F.lit(1).alias("one")).select("key")
        wrong = stored(wrong.join(listed, "key", "left_anti"), "wrong")  # building only; lookups join nothing
        inside, outside = listed, wrong
        while True:
            found = outside.count()
            if not found:
                return cls(levels)
            level = Level.build(outside, found, RATE, len(levels) + 1)
            levels.append(level)
            inside, outside = outside, stored(inside.filter(level.holds(F.col("key"))), "wrong")

    def holds(self, key: Column) -> Column:
        """Listed if the first level that doesn't hold the key is an even one, or none and their number is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """The pages with host, path, rule (the longest fitting one, else null) and verdict (its own, else block
    if a key of listed(key) fits and allow if none does).  Columns of these names are replaced; others may have any name.

    Rules are few and their verdicts a literal map; the list may be large.  One cascade holds the keys of both.
    Null urls and urls without `://` have an empty host and path, fit nothing and are allowed.  Of two rules of one
    length that fit, the one with the longer path wins; repeated rules, keys and rows change nothing; null keys and keys
    without a `/` fit nothing."""
    spark = pages.sparkSession
    verdicts = dict((k, v) for v, k in rules)
    own = spark.createDataFrame([(k,) for k in verdicts], "key string")
    keys = stored(listed.select("key").union(own).filter("instr(key, '/') > 0").distinct(), "keys")
    at = F.instr("key", "/")
    shape = keys.agg(F.collect_set(F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))).alias("labels"), F.collect_set(F.length("key") - at + 1).alias("lengths")).first()  # numbers below an url's length
    host, path = host_and_path(F.col("url"))
    fits = candidates(host, path, sorted(shape["labels"]), sorted(shape["lengths"]))
    cascade = Cascade.build(keys, pages.select(F.explode(fits).alias("key")))
    # tests stand in a lambda: the generated code holds the cascade once, however many keys an url has
    held = F.filter(fits, cascade.holds)
    words = F.create_map(*(F.lit(x) for kv in verdicts.items() for x in kv)) if verdicts else F.create_map().cast("map<string,string>")
    ruled = F.filter(held, lambda k: F.map_contains_key(words, k))
    rule = F.array_max(F.transform(ruled, lambda k: F.struct(F.length(k).alias("length"), (F.length(k) - F.instr(k, "/")).alias("rest"), k.alias("rule"))))["rule"]
    others = F.struct(*(f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict")))
    out = pages.select(others.alias("page"), host.alias("host"), path.alias("path"), held.alias("held"), rule.alias("rule"))
    verdict = F.coalesce(F.try_element_at(words, F.col("rule")), F.when(F.size("held") > 0, "block").otherwise("allow"))
    return out.select("page.*", "host", "path", "rule", verdict.alias("verdict"))


def listed_urls(pages: DataFrame, mark: str = LISTED_BY) -> DataFrame:
    """(key): host and path of every url whose query holds the mark; a host or path that is empty gives none."""
    host, path = host_and_path(F.col("url"))
    query = F.regexp_extract(F.col("url"), r"\?([^#]*)", 1)
    rows = pages.select(host.alias("host"), path.alias("path"), query.alias("query"))
    return rows.filter(F.contains("query", F.lit(mark)) & (F.col("host") != "") & F.startswith("path", F.lit("/"))).select(F.concat("host", "path").alias("key")).distinct()


def url_digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), list(RULES), listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def url_sql() -> str:
    """The same result for DuckDB."""

    def fits(key: str) -> str:
        host, path = split_key(key)
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    rules = sorted(RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(k)} THEN '{k}'" for _, k in rules)
    verdict = " ".join(f"WHEN rule = '{k}' THEN '{v}'" for v, k in rules)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
b AS (SELECT page_id, query, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {rule} END AS rule FROM b),
listed AS (SELECT DISTINCT host, path FROM b WHERE contains(query, '{LISTED_BY}') AND host <> '' AND starts_with(path, '/')),
held AS (SELECT DISTINCT page_id FROM b JOIN listed l ON (b.host = l.host OR ends_with(b.host, '.' || l.host)) AND starts_with(b.path, l.path))
SELECT page_id, host, path, rule, CASE {verdict} WHEN page_id IN (SELECT page_id FROM held) THEN 'block' ELSE 'allow' END AS verdict FROM c"""
