"""URL filters: prefix rules, and behind them exact membership in a list by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 takes for listed and aren't, level 3 the
listed ones that level 2 wrongly takes, and so on until a level has no false positives over the corpus's whole key
universe. A key's first level that doesn't hold it then tells exactly whether it is listed; no join is needed. Each
level is a pass over the written table of distinct keys; its bits are OR-ed by a pre-aggregated bit_or.

Level 1 has the more bits a key the more unlisted keys there are for a listed one, so that about as many keys are
falsely taken as are listed, and level 2 is no larger. What is broadcast at once is at most about MOST_BITS: where all
levels together need more, keys are dealt by hash into shards, each with a cascade of its own, and pages probe the one
of their key, a pass over the urls for each shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, materialize

#: Bits of a shard's cascade, 64 MB.
MOST_BITS = 1 << 29
#: Bits and hashes a key of the levels behind the first, and most bits of the first.
BITS, HASHES, FIRST_BITS = 8, 5, 64
MOST_LEVELS = 64
ALLOW, BLOCK = "allow", "block"

#: Verdict and rule (host and path prefix); a rule holds for its host and all subdomains.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: The default list: the junk sites of the pages. Each domain holds for its subdomains, as a rule's host does.
LISTED_DOMAINS = tuple(f"{site}.example.{end}" for site in ("cheap-pills", "casino-win", "free-bets", "ads-track", "spam-farm", "adult-x") for end in ("com", "net", "org"))

#: The bits of a level as 64-bit words, and the hashes of a key.
Level = tuple[np.ndarray, int]


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    behind = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(behind, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    behind = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    path = F.regexp_extract(behind, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return own & F.startswith(F.col("path"), F.lit(slash + path))


def _positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit places of each 64-bit hash, [keys, hashes]."""
    h = h.view(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def _holds(level: Level, h: np.ndarray) -> np.ndarray:
    words, hashes = level
    at = _positions(h, 64 * len(words), hashes)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(1)


def first_bits(listed: int, others: int) -> int:
    """Bits a key of level 1, by which about as many others as there are listed ones pass it."""
    return min(max(math.ceil(1.4427 * math.log2(max(others, 1) / max(listed, 1) + 1)), BITS), FIRST_BITS)


def _level_hash(level: int) -> Column:
    return F.xxhash64("key", F.lit(level))


def _encoded(keys: DataFrame, level: int, n: int, per_key: int) -> Level:
    """One level of n keys."""
    size, hashes = max(math.ceil(n * per_key / 64), 1), max(round(per_key * math.log(2)), 1) if per_key != BITS else HASHES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(batch.column("h").to_numpy(), 64 * size, hashes).ravel()
            word = (at >> np.uint64(6)).astype(np.int64)
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    words = keys.select(_level_hash(level).alias("h")).mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = words.toArrow()  # at most `size` rows
    bits = np.zeros(size, np.int64)
    bits[table["word"].to_numpy()] = table["mask"].to_numpy()
    return bits.view(np.uint64), hashes


def _passing(keys: DataFrame, level: int, bits: Level) -> DataFrame:
    """The keys that a level takes for its own."""
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key")], ["key"]).filter(pa.array(_holds(shared.value, batch.column("h").to_numpy())))

    return keys.select("key", _level_hash(level).alias("h")).mapInArrow(probe, "key string")


def build_cascade(keys: DataFrame, per_key: int = BITS) -> list[Level]:
    """The levels for a table of all distinct keys: key and whether it is listed. per_key: bits a key of level 1."""
    encode, other = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    levels: list[Level] = []
    while n := encode.count():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"{n} keys are not told apart after {MOST_LEVELS} levels")
        levels.append(_encoded(encode, len(levels), n, BITS if levels else per_key))
        wrong = materialize(_passing(other, len(levels) - 1, levels[-1]), "cascade")
        encode, other = wrong, encode
    return levels


def member(levels: list[Level], hashes: list[np.ndarray]) -> np.ndarray:
    """Whether keys are listed: an odd number of levels holds them before one doesn't."""
    n = len(hashes[0]) if hashes else 0
    inside, depth = np.ones(n, bool), np.zeros(n, np.int64)
    for level, h in zip(levels, hashes, strict=True):
        inside[inside] = _holds(level, h[inside])
        depth += inside
    return depth % 2 == 1


def hosts_under(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The hosts (column `key`) that are a listed domain (column `domain`) or a subdomain of one, as a rule's hosts are."""
    labels = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    wanted = domains.select(F.translate("domain", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("end")).where("end <> ''").distinct()
    return hosts.select("key", F.explode(ends).alias("end")).join(wanted, "end", "left_semi").select("key").distinct()


def judge_urls(pages: DataFrame, domains: DataFrame | None = None, *, listed: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, most_bits: int = MOST_BITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row.

    domains: table of listed domains (column `domain`), each holding for its subdomains; None takes LISTED_DOMAINS.
    listed: instead, a table of the listed hosts themselves (column `key`). The longest fitting rule decides, of equally
    long ones a block; without one a listed host is blocked and any other allowed. A null url, or one without ://, has
    empty host and path and is judged so; urls of any length go whole; repeated rows are judged alike and ids may be
    null; an empty table gives no row; other columns are not read.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct()
    if domains is None:
        domains = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "domain string")
    wanted = hosts_under(universe, domains) if listed is None else listed.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    marked = universe.select("key", F.lit(False).alias("listed")).union(wanted.select("key", F.lit(True).alias("listed")))
    keys = materialize(marked.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    n, others = (keys.where(which).count() for which in ("listed", "NOT listed"))
    per_key = first_bits(n, others)
    # Behind level 1 stand about as many keys as are listed, and ever fewer.
    shards = max(math.ceil(n * (per_key + 2 * BITS) / most_bits), 1)
    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards))
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[0] != BLOCK))
    ruled = rows.withColumns({
        "rule": F.coalesce(*(F.when(_fits(r), F.lit(r)) for _, r in by_length)) if rules else F.lit(None).cast("string"),
        "ruled": F.coalesce(*(F.when(_fits(r), F.lit(v)) for v, r in by_length)) if rules else F.lit(None).cast("string"),
        "key": F.col("host"),
    })
    out = None
    for k in range(shards):
        levels = build_cascade(keys.where(shard == k) if shards > 1 else keys, per_key)
        part = ruled.where(shard == k) if shards > 1 else ruled
        probed = _probed(part, levels)
        out = probed if out is None else out.union(probed)
    verdict = F.coalesce("ruled", F.when(F.col("listed"), BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def _probed(rows: DataFrame, levels: list[Level]) -> DataFrame:
    if not levels:
        return rows.select("page_id", "host", "path", "rule", "ruled", F.lit(False).alias("listed"))
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    names = [f"h{k}" for k in range(len(levels))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = member(shared.value, [batch.column(h).to_numpy() for h in names])
            own = ["page_id", "host", "path", "rule", "ruled"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(inside)], [*own, "listed"])

    hashes = [_level_hash(k).alias(h) for k, h in enumerate(names)]
    return rows.select("page_id", "host", "path", "rule", "ruled", *hashes).mapInArrow(probe, "page_id long, host string, path string, rule string, ruled string, listed boolean")


def _oracle(listed: str) -> str:
    host, path = "translate(regexp_extract(behind, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "regexp_extract(behind, '^[^/?#]*([^?#]*)', 1)"
    by_length = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != BLOCK))

    def fits(rule: str) -> str:
        name, slash, rest = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}'))"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in by_length) + " WHEN listed THEN 'block' ELSE 'allow' END"
    return f"""
        WITH parts AS (SELECT page_id, contains(url, '://') AS ok, substr(url, strpos(url, '://') + 3) AS behind FROM pages),
        split AS (SELECT page_id, CASE WHEN ok THEN {host} ELSE '' END AS host, CASE WHEN ok THEN {path} ELSE '' END AS path FROM parts),
        known AS (SELECT *, {listed} AS listed FROM split)
        SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, listed FROM known"""


ORACLE = _oracle("(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED_DOMAINS) + ")")
