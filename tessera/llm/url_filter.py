"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A URL's canonical form is its host and path. A listed entry fits the URLs of just that form. A rule is a host and
the beginning of a path: it fits the host and its subdomains, where the path begins so; the longest decides
before any listed entry. Of every URL the keys that could be listed are formed: its canonical form, and for each
end of its host that some rule names, the path's beginnings of just the lengths that this host's rules have. A
blocked Bloom filter (512 bits a block, six bits a key in one block) of all listed keys and rules passes
possible hits, and an exact join on host and path removes its false positives. The filter is bounded by
``MAX_BLOCKS`` whatever the lists' size; longer lists only let more keys through to the join.

DataFrame functions only.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits nothing;
repeated rows are judged alike, one result each; an empty table gives an empty result; empty
lists allow everything; of equally long rules, or entries of one form, the smaller verdict by name wins; entries
without a host are ignored, a null path is empty; further columns pass through, and result columns replace
input columns of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

BITS = 6
WORDS = 8
KEYS_PER_BLOCK = 32
MAX_BLOCKS = 1 << 17


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _place(key: Column, j: int) -> Column:
    """The j-th bit of a key in its block: 0 to 511."""
    return F.shiftright(F.xxhash64(key, F.lit("bits")), 9 * j).bitwiseAND(F.lit(511))


def bloom(listed: DataFrame, blocks: int) -> Column:
    """The filter's words as one array, built once and then a scalar subquery over one written row; ``listed`` has a column ``key``."""
    spark = listed.sparkSession
    places = F.array(*[_place(F.col("key"), j) for j in range(BITS)])
    bits = listed.select(_block(F.col("key"), blocks).alias("block"), F.explode(places).alias("place"))
    word = F.col("block") * WORDS + F.shiftright("place", 6)
    # 1 << b through shiftleft's own wrap-around, so the sign bit needs no arithmetic
    mask = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = bits.groupBy(word.cast("long").alias("id")).agg(F.bit_or(mask).alias("bits"))
    dense = spark.range(blocks * WORDS).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    array = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words"))
    return materialize(array, "bloom").scalar()


def may_contain(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter passes the key."""
    first = _block(key, blocks) * WORDS
    test = None
    for j in range(BITS):
        place = _place(key, j)
        word = F.element_at(words, (first + F.shiftright(place, 6) + 1).cast("int"))
        # masks of one bit differ from zero exactly where the bit is set
        hit = F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        test = hit if test is None else test & hit
    return test


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    rules and listed: ``host``, ``path`` and ``verdict``. The longest fitting rule decides; without one, a URL that is
    listed gets its entry's verdict, and any other URL is allowed.
    """
    made = {"host", "path", "rule", "verdict", "listed"}
    passed = [c for c in urls.columns if c not in made]
    parts = urls.select(*passed, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def entries(df: DataFrame, kind: str) -> DataFrame:
        held = df.filter("host <> ''").select(F.col("host").alias("e_host"), F.coalesce("path", F.lit("")).alias("e_path"), "verdict")
        return held.groupBy("e_host", "e_path").agg(F.min("verdict").alias("verdict")).withColumn("is_rule", F.lit(kind == "rule"))

    both = entries(rules, "rule").unionByName(entries(listed, "listed"))
    key = F.concat(F.col("is_rule").cast("string"), "e_host", "e_path")
    n, most_labels = both.agg(F.count("*"), F.max(F.when(F.col("is_rule"), _labels(F.col("e_host"))))).first()
    if not n:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow"), "listed": F.lit(False)})
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2

    pairs = parts.select("host", "path").filter("host <> ''").distinct()
    keys = pairs.select("host", "path", F.col("host").alias("e_host"), F.col("path").alias("e_path"), F.lit(False).alias("is_rule"))
    if most_labels:
        lengths = both.filter("is_rule").groupBy("e_host").agg(F.collect_set(F.char_length("e_path")).alias("lengths"))
        numbers = F.sequence(F.lit(1), F.least(_labels(F.col("host")), F.lit(most_labels)))
        ends = F.transform(numbers, lambda m: F.call_function("substring_index", F.col("host"), F.lit("."), -m))
        ruled = pairs.select("host", "path", F.explode(ends).alias("e_host")).join(lengths, "e_host")
        fitting = F.filter("lengths", lambda m: m <= F.char_length("path"))
        keys = keys.unionByName(ruled.withColumn("__n", F.explode(fitting)).select("host", "path", "e_host", F.expr("substring(path, 1, __n)").alias("e_path"), F.lit(True).alias("is_rule")))
    words = bloom(both.select(key.alias("key")), blocks)
    hits = keys.filter(may_contain(words, key, blocks)).join(both, ["e_host", "e_path", "is_rule"])
    length = F.char_length("e_host") + F.char_length("e_path")
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.when(F.col("is_rule"), F.struct(F.concat("e_host", "e_path").alias("rule"), "verdict")), F.when(F.col("is_rule"), F.struct(length, F.when(F.col("verdict") == "allow", 1).otherwise(0), "e_host"))).alias("__by_rule"),
        F.min(F.when(~F.col("is_rule"), F.col("verdict"))).alias("__by_list"),
    )
    out = parts.join(best, ["host", "path"], "left")
    return out.select(
        *passed, "host", "path", F.col("__by_rule.rule").alias("rule"),
        F.coalesce("__by_rule.verdict", "__by_list", F.lit("allow")).alias("verdict"), F.col("__by_list").isNotNull().alias("listed"),
    )


#: Rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def campaign_links(urls: DataFrame, url: str = "url") -> DataFrame:
    """A list for the registered query: the canonical URLs that occur with a campaign's parameters, as blocked."""
    marked = urls.filter(F.contains(F.col(url), F.lit("utm_")))
    return marked.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit("block").alias("verdict")).distinct()


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
campaigns AS (
  SELECT DISTINCT host, path FROM parts WHERE contains(url, 'utm_') AND host <> ''),
ruled AS (
  SELECT page_id, p.host, p.path, CASE
    WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(p.path, '/en/') THEN 'example.net/en/'
    WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(p.path, '/de/') THEN 'example.com/de/'
    WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(p.path, '/fr/') THEN 'org/fr/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/') THEN 'net/' END AS rule, c.host IS NOT NULL AS listed
  FROM parts p LEFT JOIN campaigns c ON c.host = p.host AND c.path = p.path)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM ruled
"""
