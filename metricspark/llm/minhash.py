"""Near-duplicates by min-max hashing, banding, and confirmation on whole shingle sets.

Each of PERMUTATIONS hash functions is evaluated once per shingle and yields two signature values,
its minimum and its maximum.  Documents with equal sets are one node.  Nodes that share a band stand
in a bucket; links are sought in stars first (each member with the most copied node), and only buckets
whose members are not yet in one component are looked at again: pair by pair across components where
one component holds all but a few members, else after being split by their members' other bands.  The
splits only join components early: what they leave of such a bucket is compared pair by pair at the end,
in blocks, so every two nodes that share a band are in one component or have been compared.
Every link is confirmed on the full sets before it counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components, merged

SHINGLE = 5
#: Link when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
PERMUTATIONS = 64
#: Signature values in a band.  A pair at the threshold shares none of the 32 bands with probability 5e-6.
BAND_VALUES = 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Unsettled buckets with up to this many members outside their largest component are compared across
#: components pair by pair; others are split by further bands first.  A split writes and shuffles 31 rows
#: for each member, which costs about as much as this many comparisons in memory.
MINORITY = 1024
#: After so many splits the unsettled buckets of the first round are compared pair by pair.
SPLITS = 2
#: Members of a bucket in a block of those comparisons: a task compares two blocks at a time.
BLOCK = 2048
#: Candidate ids are broadcast up to this many (8 MB of ids), else joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a text of fewer words has its whole sequence."""
    out: list[np.ndarray] = []
    for lo, hi in T.groups(texts):
        words, offsets = T.word_hashes(texts[lo:hi], lower=True)
        grams = T.ngram_hashes(words, SHINGLE)
        for s, e in zip(offsets[:-1], offsets[1:]):
            if e - s >= SHINGLE:
                out.append(np.unique(grams[s:e - SHINGLE + 1]))
            else:
                out.append(T.ngram_hashes(words[s:e], e - s) if e > s else words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Two values per permutation (minimum, maximum) of each non-empty set."""
    offsets = np.cumsum([0, *map(len, sets)])
    x = np.concatenate(sets)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        v = x * _A[k] + _B[k]
        out[:, 2 * k] = np.minimum.reduceat(v, offsets[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(v, offsets[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for each band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros(
        (len(signature), 1), np.uint64)
    for k in range(BAND_VALUES):
        keys = T.mix(keys ^ signature[:, k::BAND_VALUES])
    return keys


def parities(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an odd number of the set's members fall on each of some places (bits of 64-bit words), and
    the same for half as many places.  There are 4 to 8 places for a member, and 64 at least.

    Members of both sets cancel out, so two sets of equally many places differ in at least as many
    members as they have places of different parity.
    """
    words = 1 << max(0, (len(grams) - 1) // 16).bit_length()
    odd = np.bincount((T.mix(grams) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    out = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
    return out, out[:words // 2] ^ out[words // 2:] if words > 1 else out


def odd_places(a: str, b: str) -> str:
    """SQL for the number of places of different parity; sizes within the similarity differ at most twofold
    in places."""
    def differ(x, y):
        return f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"

    return (f"CASE WHEN size(parity_{a}) = size(parity_{b}) THEN {differ(f'parity_{a}', f'parity_{b}')} "
            f"WHEN size(parity_{a}) > size(parity_{b}) THEN {differ(f'half_{a}', f'parity_{b}')} "
            f"ELSE {differ(f'parity_{a}', f'half_{b}')} END")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``n_shingles``, ``digest`` of the set (null if empty) and ``bands``."""
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist())
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, has = [np.empty((0, BANDS), np.uint64)], np.zeros(len(sets) + 1, np.int64)
            for lo in range(0, len(full), 1000):
                keys.append(band_keys(signatures([sets[k] for k in full[lo:lo + 1000]])))
            has[np.array(full, int) + 1] = 1
            offsets = np.cumsum(has)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                          pa.binary()),
                 T.lists(np.concatenate(keys).ravel().view(np.int64), offsets * BANDS, pa.int64())],
                names=["doc_id", "node", "n_shingles", "digest", "bands"])

    d = T.doc_columns(docs)
    return d.select("doc_id", "text", T.row_id().alias("node")).mapInArrow(
        run, "doc_id long, node long, n_shingles long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, its sorted shingle hashes and their parities, for the given nodes."""
    def joined(parts):
        flat = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
        return T.lists(flat, np.cumsum([0, *map(len, parts)]), pa.int64())

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist())
            odd = [parities(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), joined(sets), joined([p for p, _ in odd]), joined([h for _, h in odd])],
                names=["node", "grams", "parity", "half"])

    d = T.doc_columns(docs).select("text", T.row_id().alias("node"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    return d.join(wanted, "node", "left_semi").mapInArrow(
        run, "node long, grams array<long>, parity array<long>, half array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    two = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - both
    # A node that stands in very many pairs has its pairs dealt to several tasks, each with its set.
    often_a, often_b = T.frequent(pairs, "a"), T.frequent(pairs, "b")
    first = T.join_spread(pairs, one, "b", "a", often_b)
    return T.join_spread(first, two, "a", "b", often_a).filter(100 * both >= SIMILARITY * union).select("a", "b").distinct()


def crowded(buckets: DataFrame) -> DataFrame:
    """The members (key, node, n, copies) of buckets of two nodes or more, with the most copied node."""
    centre = buckets.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"),
                                        F.max_by("node", "copies").alias("centre")).filter("least <> most")
    return buckets.join(centre.select("key", "centre"), "key")


def stars(members: DataFrame) -> DataFrame:
    return members.filter("node <> centre").select(
        F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with their label, of buckets in more than one component: ``main`` is the label of the
    largest, ``minority`` counts the members outside it and ``total`` all."""
    placed = members.join(labels, "node", "left").select("key", "node", "n", "copies",
                                                         F.coalesce("label", "node").alias("label"))
    sizes = placed.groupBy("key", "label").count().groupBy("key").agg(
        (F.sum("count") - F.max("count")).alias("minority"), F.sum("count").alias("total"),
        F.max_by("label", F.struct("count", "label")).alias("main")).filter("minority > 0")
    return placed.join(sizes, "key")


def across(rest: DataFrame, nodes: DataFrame, sets: DataFrame, first_bands: bool, blocks: bool = False) -> DataFrame:
    """Pairs (a, b) of different components in a bucket (key, node, n, label, main) that may be similar.
    With ``blocks`` (and columns minority, total) each bucket's two sides are dealt to blocks of BLOCK
    members, and every block meets every other in a task of its own.

    Members of the bucket's largest component, ``main``, meet only those outside it.  Where the key is a
    band, a pair comes from the first band that it shares, so it is made once.  The bound by parities loses
    no link.  Without blocks a bucket costs its minority times its members in memory, MINORITY times the
    members at most; in blocks the same product is spread over as many tasks as pairs of blocks.
    """
    rest = rest.join(sets.select("node", "parity", "half"), "node")
    if first_bands:
        rest = rest.join(nodes.select("node", "bands"), "node")
    cols = [c for c in rest.columns if c not in ("key", "minority", "total")]
    x, y, place = rest.filter("label <> main"), rest, ["key"]
    if blocks:
        some, whole = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("minority", "total"))
        x = x.withColumn("i", F.pmod(F.xxhash64("node"), some).cast("int")).withColumn(
            "j", F.explode(F.sequence(F.lit(0), whole - 1)))
        y = y.withColumn("j", F.pmod(F.xxhash64("node"), whole).cast("int")).withColumn(
            "i", F.explode(F.sequence(F.lit(0), some - 1)))
        place = ["key", "i", "j"]
    x = x.select(*place, *[F.col(c).alias(f"{c}_a") for c in cols])
    y = y.select(*place, *[F.col(c).alias(f"{c}_b") for c in cols])
    once = (F.col("label_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    fit = (once & (F.col("label_a") != F.col("label_b"))
           & (100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")))
    fit = fit & F.expr(f"(100 + {SIMILARITY}) * {odd_places('a', 'b')} <= (100 - {SIMILARITY}) * (n_a + n_b)")
    if first_bands:
        fit = fit & (F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == x["key"])
    for c in place:
        fit = (x[c] == y[c]) & fit
    pairs = x.join(y, fit)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Labels (node, label) of all nodes with a link; ``nodes``: node, n, copies, bands, one row per set."""
    spark = docs.sparkSession
    members = T.written(spark, crowded(nodes.select("node", "n", "copies", F.explode("bands").alias("key"))),
                        "near-members")
    if members.isEmpty():
        return None
    sets = T.written(spark, sets_of(docs, members.select("node").distinct()), "near-sets")
    tested = T.written(spark, stars(members), "near-pairs")
    labels = components(T.written(spark, confirmed(tested, sets), "near-links"))
    buckets, large = members, None
    for split in range(SPLITS + 1):
        rest = T.written(spark, unsettled(members, labels), "near-unsettled")
        if rest.isEmpty():
            break
        few = F.col("minority") <= MINORITY
        pairs = across(rest.filter(few).select("key", "node", "n", "label", "main"), nodes, sets,
                       first_bands=split == 0)
        many = rest.filter(~few)
        if split == 0:
            large = T.written(spark, many.select("key").distinct(), "near-large")
        if split == SPLITS:
            many = many.limit(0)
        finer = many.select("key", "node", "n", "copies").join(nodes.select("node", "bands"), "node").select(
            "node", "n", "copies", F.col("key").alias("was"), F.explode("bands").alias("band")).filter(
            "was <> band").select(F.xxhash64(F.least("was", "band"), F.greatest("was", "band")).alias("key"),
                                  "node", "n", "copies").distinct()
        members = T.written(spark, crowded(finer), "near-members")
        pairs = pairs.unionByName(stars(members)).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = T.written(spark, pairs, "near-pairs")
        tested = tested.unionByName(pairs)
        labels = merged(labels, T.written(spark, confirmed(pairs, sets), "near-links"))
        if members.isEmpty():
            break
    if large is None or large.isEmpty():
        return labels
    rest = T.written(spark, unsettled(buckets.join(large, "key", "left_semi"), labels), "near-unsettled")
    if rest.isEmpty():
        return labels
    pairs = across(rest.select("key", "node", "n", "label", "main", "minority", "total"), nodes, sets,
                   first_bands=True, blocks=True).join(tested, ["a", "b"], "left_anti")
    return merged(labels, T.written(spark, confirmed(T.written(spark, pairs, "near-pairs"), sets), "near-links"))


def labelled(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``n_shingles`` and ``label``, the least node of the component."""
    spark = docs.sparkSession
    T.prepared(spark)
    rows = T.written(spark, sketches(docs), "near-sketches")
    nodes = T.written(spark, rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("node").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.count(F.lit(1)).alias("copies")), "near-nodes")
    labels = near_links(docs, nodes)
    by_set = nodes.select("digest", F.col("node").alias("label"))
    if labels is not None:
        by_set = nodes.select("digest", "node").join(labels, "node", "left").select(
            "digest", F.coalesce("label", "node").alias("label"))
    return rows.drop("bands").join(by_set, "digest", "left").select(
        "doc_id", "node", "n_shingles", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Texts without a word have no shingles and stand alone.  Rows with one doc_id are one document.  A
    row without doc_id counts as the last document of its component: its component_id is null if no
    other document is in it, and it is kept then.  Other columns are ignored.
    """
    label, last = F.col("label"), F.lit(T.LAST_ID - 2**40)
    return labelled(docs).select("doc_id", "n_shingles", F.when(label <= last, label).alias("component_id"),
                                 (F.col("node") == label).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are kept; of repeated rows (one doc_id and text), one stays.

    Texts without a word are like no other and stay, once for each doc_id; rows without doc_id are judged as in
    ``near_duplicates``.  Names of inner columns give way to those of ``docs``."""
    node, digest = T.free_name(docs.columns, "node"), T.free_name(docs.columns, "digest")
    gone = T.written(docs.sparkSession, labelled(docs).filter("node <> label").select(
        F.col("node").alias(node)).distinct(), "near-gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(node, T.row_id()).withColumn(digest, F.xxhash64(text))
    return keyed.join(gone, node, "left_anti").dropDuplicates([node, digest]).select(*docs.columns)
