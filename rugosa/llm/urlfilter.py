"""URL filters by Bloom filter cascades: exact membership over the corpus's keys, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most words of a level's bit array that are put into a plan as a literal; longer ones are read through a scalar subquery.
LITERAL_WORDS = 4096


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.coalesce(F.substring(rest, F.nullif(F.instr(rest, "/"), F.lit(0)), F.length(rest)), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


class Level:
    """A Bloom filter: its bits as 64-bit words, from a DataFrame with the column key."""

    def __init__(self, keys: DataFrame, n: int, depth: int, rate: float, tag: int):
        import math

        self.tag, self.depth = tag, depth
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2)))
        words = -(-self.bits // 64)
        at = keys.select(F.explode(self.places(F.col("key"))).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v"))
        made = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(at, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
        self.table = None
        if words <= LITERAL_WORDS:
            got = {r.w: r.v for r in made.collect()}
            self.words = F.array(*[F.lit(got[i]).cast("long") for i in range(words)])
        else:
            self.table = common.written(made.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")), "bloom-level")
            self.words = self.table.scalar()

    def places(self, key: Column) -> Column:
        """The key's bits: h1 + i h2 of two 64-bit hashes, which the level's place in the cascade salts."""
        h1, h2 = (F.xxhash64(F.lit(self.tag), F.lit(self.depth), F.lit(i), key) for i in (0, 1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(1 << 40)) + i * F.pmod(h2, F.lit(1 << 40)), F.lit(self.bits)))

    def has(self, key: Column) -> Column:
        return F.forall(self.places(key), lambda p: F.call_function("shiftright", F.element_at(self.words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


class Cascade:
    """Exact membership of any key of the universe in the listed keys.

    Level 0 holds the listed keys, level 1 those of the universe's other keys that level 0 takes, level 2 the
    listed keys that level 1 takes, and so on until a level takes none wrongly. A key is listed if the first level that
    refuses it is an odd one, or if it passes all of an odd number of levels. universe: a DataFrame with the
    column key, which may repeat keys; it is read once, for the false positives of level 0.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, tag: int, rate: float = 0.004, inner_rate: float = 0.5):
        listed = common.written(listed.select("key").where("key IS NOT NULL").distinct(), "listed-keys")
        self.levels: list[Level] = []
        self.n = listed.count()
        inside, n, outside = listed, self.n, None
        while n:
            level = Level(inside, n, len(self.levels), rate if not self.levels else inner_rate, tag)
            self.levels.append(level)
            if outside is None:  # of the whole universe only what level 0 takes wrongly is kept
                wrong = universe.select("key").where(level.has(F.col("key"))).distinct().join(listed, "key", "left_anti")
            else:
                wrong = outside.where(level.has(F.col("key")))
            outside, inside = inside, common.written(wrong, "false-positives")
            n = inside.count()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, key string")


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys (host's last labels + beginning of the path) that a rule could have, longest first.

    labels: the numbers of labels that rules' hosts have; lengths: of characters of rules' paths. So a url has at most as
    many keys as the rules have shapes, however long it is.
    """
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    hosts = F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels])
    paths = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])
    keys = F.flatten(F.transform(F.filter(hosts, lambda h: h.isNotNull() & (h != "")), lambda h: F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))
    return F.array_sort(keys, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rules: (verdict allow or block, key host/path).

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule's
    verdict holds, else `default` (the url is not listed). Null urls and those without :// have empty host and path and fit
    no rule. If a key is listed with both verdicts, block holds. Rows are kept as they are, repeats included.
    """
    shape = F.length(F.substring_index("key", "/", 1)), F.length("key")
    got = rules.where("key LIKE '%/%'").select((F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))).alias("labels"), (shape[1] - shape[0]).alias("path")).distinct().collect()  # the rules' shapes, not the rules
    labels, lengths = sorted({r.labels for r in got}), sorted({r.path for r in got})
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not got:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = base.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    allow = Cascade(rules.where("verdict = 'allow'"), universe, 1)
    block = Cascade(rules.where("verdict = 'block'"), universe, 2)
    kind = F.transform("keys", lambda k: F.struct(k.alias("key"), F.when(block.has(k), F.lit("block")).when(allow.has(k), F.lit("allow")).alias("verdict")))
    hit = F.get(F.filter(kind, lambda x: x["verdict"].isNotNull()), F.lit(0))
    out = keyed.withColumn("hit", hit)
    return out.select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


# The rules of op3.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(common.read_table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE_SQL = {
    "op3_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), f AS (
  SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
}
QUERIES = {"op3_url_filter": op3_url_filter}
