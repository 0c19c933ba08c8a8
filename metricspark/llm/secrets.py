"""Secrets by multipart credential linking, in DataFrame functions only.

Patterns propose parts of three roles: access identifiers, secrets and endpoints.  The base kinds
(assign, access, hex) stand on their own.  The weak kinds (ident, key, endpoint) are reported only
when a complementary part lies within SCOPE code points in the same text: an interval join on
(row, position bucket), where a part is in every bucket that it covers and the partners of a bucket are
first reduced to their least start and greatest end, so that no pairs of a crowded scope are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Code points between the end of a part and the start of the next that belong together.
SCOPE = 200

#: kind: role, pattern, group whose length is checked, least length.  In the order of equal starts.
KINDS = {
    "assign": ("secret", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
                         r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
                         r"""([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": ("id", r"AKIA[A-Z0-9]+", 0, 20),
    "hex": ("secret", r"[0-9a-f]{24,}", 0, 24),
    "ident": ("id", r"""(?i:\b(?:user|username|login|account|account_id|client_id|access_key_id))["']?\x20*[:=]"""
                    r"""\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    "key": ("secret", r"(?<![A-Za-z0-9+/=])(?=[a-z+/0-9]*[A-Z])(?=[A-Z+/0-9]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    "endpoint": ("endpoint", r"""\b[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+|(?<![0-9.])[0-9]{1,3}"""
                             r"""(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""", 0, 7),
}
BASE = ("assign", "access", "hex")
PARTNERS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Per match: code points before it since the last match, of the match and of the group."""
    p = F.lit(pattern)
    return F.when(text.rlike(pattern), F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length).alias("part")))


def spans(docs: DataFrame) -> DataFrame:
    """Spans of each distinct (doc_id, text): ``doc_id``, ``text_hash``, ``kind``, ``rank``, ``start``,
    ``end``.  Positions are code points, the end is exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = F.lit(False)
    for _, p, _, _ in KINDS.values():
        some = some | text.rlike(p)
    d = docs.filter(some).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                                 *[_lengths(text, p, g).alias(k) for k, (_, p, g, _) in KINDS.items()])
    d = d.dropDuplicates(["doc_id", "text_hash"])
    found = d.select("doc_id", "text_hash", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.lit(least).alias("least"), F.col(k).alias("hits"))
        for i, (k, (_, _, _, least)) in enumerate(KINDS.items())])).alias("f"))
    found = found.select("doc_id", "text_hash", "f.rank", "f.kind", "f.least", F.posexplode("f.hits").alias("pos", "h"))
    before = Window.partitionBy("doc_id", "text_hash", "rank").orderBy("pos")
    found = found.select("doc_id", "text_hash", "rank", "kind", "least", F.col("h.size").alias("size"),
                         F.col("h.part").alias("part"),
                         F.sum(F.col("h.gap") + F.coalesce(F.col("h.size"), F.lit(0))).over(before).alias("end"))
    return found.filter(F.col("size").isNotNull() & (F.col("part") >= F.col("least"))).select(
        "doc_id", "text_hash", "rank", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """Base spans, and weak spans with a complementary part at most SCOPE before or behind them."""
    role = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])]), F.col("kind"))
    wants = F.element_at(F.create_map(*[x for k, v in PARTNERS.items() for x in (
        F.lit(k), F.array(*[F.lit(p) for p in v]))]), F.col("role"))
    parts = found.withColumn("role", role).withColumn("low", F.floor(F.col("start") / SCOPE)).withColumn(
        "high", F.floor(F.col("end") / SCOPE))
    per = ["doc_id", "text_hash", "role", "bucket"]
    reach = parts.withColumn("bucket", F.explode(F.sequence("low", "high"))).groupBy(*per).agg(
        F.min("start").alias("first"), F.max("end").alias("last"))
    reach = reach.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"),
                         F.col("role").alias("p_role"), F.col("bucket").alias("p_bucket"), "first", "last")
    weak = parts.filter(~F.col("kind").isin(*BASE))
    near = weak.withColumn("p_role", F.explode(wants)).withColumn(
        "p_bucket", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)))
    hit = near.join(reach, near["doc_id"].eqNullSafe(reach["p_id"]) & (near["text_hash"] == reach["p_hash"])
                    & (near["p_role"] == reach["p_role"]) & (near["p_bucket"] == reach["p_bucket"])
                    & (F.col("last") >= F.col("start") - SCOPE) & (F.col("first") <= F.col("end") + SCOPE), "left_semi")
    cols = ["doc_id", "text_hash", "rank", "kind", "start", "end"]
    return found.filter(F.col("kind").isin(*BASE)).select(*cols).unionByName(hit.select(*cols).distinct())


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of the base spans and all spans.

    A missing text counts as empty; rows without ``doc_id`` are matched by their text; repeated rows
    each get their row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct("start", "rank", "end", name.alias("name"))
    found = T.written(docs.sparkSession, spans(docs), "secret-spans")  # read twice below, scanned once
    per = linked(found).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(item)).alias("all"))
    per = per.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "all")
    both = rows.join(per, rows["doc_id"].eqNullSafe(per["s_id"]) & (rows["text_hash"] == per["s_hash"]), "left")
    every = F.coalesce(F.col("all"), F.expr(
        "cast(array() as array<struct<start:bigint,rank:int,end:bigint,name:string>>)"))
    base = F.filter(every, lambda s: s["rank"] < len(BASE))

    def text_of(a):
        return F.array_join(F.transform(a, lambda s: s["name"]), ",")

    def count_of(rank):
        return F.size(F.filter(every, lambda s: s["rank"] == rank)).cast("long")

    return both.select("doc_id", *[count_of(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                       F.sha2(text_of(base), 256).alias("base_sha256"), text_of(every).alias("spans"))
