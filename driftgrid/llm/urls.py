"""URL filters: a blocked Bloom filter in front of an exact hash join.

The list is a table of canonical urls: a host, which stands for its subdomains too, and
a path prefix, with a verdict. Rules are entries of their own kind and go before the
rest; they speak of host and path as they stand, while the listed sites are met by the
canonical form: no user, port or closing dots in the host, no empty or ``.`` steps in
the path. From each url come the few keys it could match: its last m host labels for
every label count m in the list, with every path prefix length in the list. A key is
probed in a split-block Bloom filter, eight 32-bit words a block, one bit in each; only
the urls with a possible hit go on to the hash join with the list itself, which removes
the false positives, and the longest matching rule, else the longest listed entry, wins.

The filter has a block for every 16 entries and at most ``MAX_BLOCKS`` (8 MB as the
array that tasks get); a list that outgrows it makes more false positives for the join
to remove, and nothing else changes. The pages are read once: what was parsed from them
is stored, with a number for each row, so equal urls are never one key of a join.

Defined cases: a null url or one without ``://`` has empty host and path and
matches nothing; repeated rows and null or repeated ids are judged row by row; a long
url is cut into keys no longer than the list's; an empty table gives an empty result;
an empty list allows everything; other columns stay, those named host, path, rule or
verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.columns import unused
from driftgrid.scratch import materialize

#: The rules of the task (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Sites the method blocks, under each of the domains.
SITE_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SITE_DOMAINS = ("example.com", "example.net", "example.org")
SITES = tuple((f"{name}.{domain}", "", "block") for name in SITE_NAMES for domain in SITE_DOMAINS)

#: Odd multipliers that pick one bit in each of a block's eight words.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
MAX_BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def listed(spark: SparkSession, rules=RULES, sites=SITES) -> DataFrame:
    """The list as a table (host, path, verdict, is_rule), built without Python rows."""
    rows = [(*r, True) for r in rules] + [(*s, False) for s in sites]
    if not rows:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict, false AS is_rule").where("false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}', {r})" for h, p, v, r in rows) + " AS t(host, path, verdict, is_rule)")


def read_listed(spark: SparkSession, path: str, rules=RULES) -> DataFrame:
    """A stored table of listed urls (url, verdict), together with the rules, as entries."""
    parted = split_url(spark.read.parquet(path).select("url", "verdict"))
    sites = parted.select(canonical_host(F.col("host")).alias("host"), canonical_path(F.col("path")).alias("path"), "verdict", F.lit(False).alias("is_rule"))
    return sites.where("host <> ''").unionByName(listed(spark, rules, ()))


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+(:[0-9]*)?$", "")


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/+(\./+)*", "/")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    (a, b) = unused(df, "__rest", "__host")
    out = df.withColumn(a, rest).withColumn(b, F.regexp_extract(a, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substring(F.col(a), F.length(b) + 1, F.length(a)), r"^[^?#]*", 0)
    return out.withColumns({"host": F.translate(b, UPPER, LOWER), "path": path}).drop(a, b)


def shapes(entries: DataFrame) -> dict[bool, tuple[list[int], list[int]]]:
    """Label counts and path lengths of the rules (True) and of the other entries: short sorted lists, whatever the list's length."""
    found = entries.groupBy("is_rule").agg(F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("m"), F.array_sort(F.collect_set(F.length("path"))).alias("n"))
    return {r.is_rule: (list(r.m), list(r.n)) for r in found.collect()}


def candidate_keys(labels: list[int], lengths: list[int], kind: str, host: Column, path: Column) -> list[Column]:
    """The keys of one kind a url could match; null where it is too short for them."""
    parts = F.split(host, r"\.")
    keys = []
    for m in labels:
        tail = F.when(F.size(parts) >= m, F.array_join(F.slice(parts, F.size(parts) - m + 1, F.lit(m)), "."))
        keys += [F.when(F.length(path) >= n, F.concat(F.lit(kind), tail, F.lit("|"), F.substring(path, 1, n))) for n in lengths]
    return keys


def _word(h: Column, i: int, blocks: int) -> Column:
    return (F.pmod(h, F.lit(blocks)) * 8 + i).cast("int")


def _bit(h: Column, i: int) -> Column:
    mixed = (F.shiftrightunsigned(h, 33) * F.lit(SALTS[i])).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 27).cast("int"))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter's words for the column ``key``."""
    h = F.xxhash64("key")
    sets = F.array(*[F.struct(_word(h, i, blocks).alias("w"), _bit(h, i).alias("b")) for i in range(8)])
    words = keys.select(F.explode(sets).alias("s")).groupBy("s.w").agg(F.bit_or("s.b").alias("b"))
    every = keys.sparkSession.range(blocks * 8).select(F.col("id").cast("int").alias("w"))
    filled = every.join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return filled.agg(F.expr("transform(array_sort(collect_list(struct(w, b))), x -> x.b)").alias("words"))


def might_contain(words: Column, key: Column, blocks: int) -> Column:
    h, out = F.xxhash64(key), F.lit(True)
    for i in range(8):
        out = out & (F.get(words, _word(h, i, blocks)).bitwiseAND(_bit(h, i)) != 0)
    return out


def possible(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path and the ``keys`` that pass the filter, for ``entries`` with their ``key``."""
    blocks = max(1, min(MAX_BLOCKS, -(-entries.count() // 16)))
    words = materialize(bloom(entries.select("key"), blocks), "bloom")
    parted = split_url(pages, url)
    host, path, keys = F.col("host"), F.col("path"), []
    for is_rule, (labels, lengths) in shapes(entries).items():
        keys += candidate_keys(labels, lengths, "r|", host, path) if is_rule else candidate_keys(labels, lengths, "s|", canonical_host(host), canonical_path(path))
    (filled,) = unused(parted, "__words")
    parted = parted.withColumns({filled: words.scalar(), "keys": F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")})
    return parted.withColumn("keys", F.filter("keys", lambda k: might_contain(F.col(filled), k, blocks))).drop(filled)


def judge(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    entries = entries.withColumn("key", F.concat(F.when(F.col("is_rule"), F.lit("r|")).otherwise(F.lit("s|")), "host", F.lit("|"), "path"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # Columns go by numbers meanwhile, so that no name can clash.
    numbered = pages.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(own)])
    parted = materialize(possible(numbered, entries, f"own_{own.index(url)}").withColumn("row", F.monotonically_increasing_id()), "parted")
    some = parted.where(F.size("keys") > 0)
    hits = some.select("row", F.explode("keys").alias("key")).join(entries.select("key", "verdict", "is_rule", F.concat("host", "path").alias("name")), "key")
    rank = F.struct("is_rule", F.length("name"), "name", "verdict")
    best = hits.groupBy("row").agg(F.max_by(F.struct("is_rule", "name", "verdict"), rank).alias("best"))
    found = some.join(best, "row", "left").withColumns({"rule": F.when(F.col("best.is_rule"), F.col("best.name")), "verdict": F.coalesce(F.col("best.verdict"), F.lit("allow"))})
    clear = parted.where(F.size("keys") == 0).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    columns = [*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], "host", "path", "rule", "verdict"]
    return found.select(*columns).unionByName(clear.select(*columns))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed(spark)).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules=RULES, sites=SITES) -> str:
    """DuckDB SQL of :func:`op8_url_filter`: every rule tried on every url."""
    rows = ", ".join(f"('{h}', '{p}', '{v}', {r})" for group, r in ((rules, True), (sites, False)) for h, p, v in group)
    return f"""
WITH l(lh, lp, v, is_rule) AS (VALUES {rows}),
p AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
c AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\\.+(:[0-9]*)?$', '', 'g') AS ch, regexp_replace(path, '/+(\\./+)*', '/', 'g') AS cp FROM s),
m AS (SELECT k, arg_max({{'r': is_rule, 'n': lh || lp, 'v': v}}, (is_rule::INT * 100000 + length(lh || lp))) AS b
      FROM c JOIN l ON ends_with('.' || CASE WHEN is_rule THEN host ELSE ch END, '.' || lh) AND starts_with(CASE WHEN is_rule THEN path ELSE cp END, lp) GROUP BY k)
SELECT page_id, host, path, CASE WHEN b.r THEN b.n END AS rule, coalesce(b.v, 'allow') AS verdict FROM s LEFT JOIN m USING (k)"""
