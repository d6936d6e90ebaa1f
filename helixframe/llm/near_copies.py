"""Groups of near copies: min-hash bands give candidates, exact Jaccard similarity of shingle sets decides.

A *node* is a distinct set of word shingles. Two nodes are candidates if one of ``BANDS`` bands of ``ROWS`` min-hashes is
equal. A pair of similarity s is missed with probability (1 - s^ROWS)^BANDS: 2.2e-5 at 0.8, less above. Candidates link
if their sets, compared in full, are similar enough; groups are the connected components of the links.

Pairs inside one component need no comparison, so a large group of near copies never becomes all its pairs: first each
bucket's least and greatest node are compared with all others, then, in large buckets, the node that most of these linked to; last,
the nodes of a bucket that still lie in different components, a pair of blocks of about ``BLOCK`` at a time. That last step is whole,
whatever the first ones found. A task of it reads *sketches*, a byte of each of the node's min-hashes, and names the pairs that agree in so many
of them as a pair of the least similarity does but for a probability of ``MISS``; only those are compared in full. So what is shuffled
grows with the nodes of a bucket and not with its pairs.

Pairs are compared by streaming: a task holds the set of one node and reads the other sets of its pairs one by one; a node with
many pairs is dealt over several places of about ``CHUNK`` pairs.

Edge cases: texts without words (null ones too) are one node; fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, freed, materialise, shuffle_width, stored
from .graph import components
from .simhash import SEED, by_key, shingle_hashes

ROWS, BANDS = 5, 27
CHUNK = 1024
BLOCK = 1024
MISS = 1e-6
#: Buckets of more nodes are compared with a third node before all pairs that are left.
LARGE = 16


def _minima(hashes: np.ndarray, count: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, count, 1), np.uint64)
    factors |= np.uint64(1)
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        out = np.minimum(out, ((hashes[None, i : i + 2048] ^ flips) * factors).min(axis=1))
    return out


def signature(hashes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> tuple[np.ndarray, bytes]:
    """Name of a set of shingle hashes, and its bands, as signed 64-bit integers; a byte of each min-hash. The empty set has neither bands nor bytes."""
    from xxhash import xxh64_intdigest

    names, sketch = [xxh64_intdigest(hashes.tobytes(), SEED)], b""
    if len(hashes):
        low = _minima(hashes, rows * bands)
        names += [xxh64_intdigest(low[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
        sketch = low.astype(np.uint8).tobytes()
    return np.array(names, np.uint64).view(np.int64), sketch


def with_signature(keyed: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, text_key, node, bands and sketch of rows (doc_id, text_key, text)."""

    @F.pandas_udf("names array<long>, sketch binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        found = [signature(np.unique(shingle_hashes(t if isinstance(t, str) else None, shingle)), rows, bands) for t in texts]
        return pd.DataFrame({"names": [names for names, _ in found], "sketch": [sketch for _, sketch in found]})

    found = keyed.select("doc_id", "text_key", signed("text").alias("signed")).select("doc_id", "text_key", "signed.*")
    return found.select("doc_id", "text_key", F.get("names", F.lit(0)).alias("node"), F.slice("names", 2, bands).alias("bands"), "sketch")


def fewest(count: int, similarity: float, miss: float = MISS) -> int:
    """In so many of ``count`` min-hashes sets of the given similarity agree, but for a probability of ``miss`` at most."""
    below = 0.0
    for k in range(count):
        below += comb(count, k) * similarity**k * (1 - similarity) ** (count - k)
        if below > miss:
            return k
    return count


def shingle_sets(keyed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and its sorted shingle hashes as bytes, of ``wanted`` (node, doc_id, text_key)."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t if isinstance(t, str) else None, shingle)).tobytes() for t in texts])

    small = bounded(wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    met = keyed.join(small, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["text_key"] == F.col("_key")))
    return met.select("node", packed("text").alias("shingles")).groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the given Jaccard similarity."""
    least = Fraction(str(similarity))
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("parts"))
    placed = materialise(pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part")))
    visitors = placed.join(sets, placed["v"] == sets["node"]).select("u", "part", F.lit(True).alias("visits"), "v", "shingles")
    homes = placed.select("u", "part").distinct().join(sets, F.col("u") == sets["node"]).select("u", "part", F.lit(False).alias("visits"), F.col("u").alias("v"), "shingles")
    rows = homes.unionByName(visitors).repartition(shuffle_width(pairs.sparkSession), "u", "part").sortWithinPartitions("u", "part", "visits")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for u, visits, v, raw in zip(batch["u"], batch["visits"], batch["v"], batch["shingles"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not visits:
                    home = own
                    continue
                few, many = sorted((len(home), len(own)))
                if least.denominator * few >= least.numerator * many:
                    common = len(np.intersect1d(home, own, assume_unique=True))
                    if least.denominator * common >= least.numerator * (few + many - common):
                        found.append((u, v))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return freed(materialise(rows.mapInPandas(compare, "u long, v long")))


def likely(left: DataFrame, sketches: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v), u < v, of one bucket and two roots whose sketches agree often enough. ``left``: bucket, node, root and n, the bucket's nodes.

    The nodes of a bucket are dealt to blocks by their hash; each pair of blocks, and each block with itself, is one place.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = left.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    sent = own.select("bucket", "node", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    place = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    away = F.col("mine") > F.col("other")
    rows = sent.select(place.alias("place"), "node", "root", away.alias("away"), (F.col("mine") == F.col("other")).alias("within"))
    rows = rows.join(bounded(sketches.withColumnRenamed("node", "_node")), F.col("node") == F.col("_node")).drop("_node")

    def compare(x: dict[str, np.ndarray]) -> pd.DataFrame | None:
        away, within = x["away"].astype(bool), x["within"].astype(bool)
        node, root = x["node"], x["root"]
        sketch = np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(len(node), -1)
        least = fewest(sketch.shape[1], similarity)
        theirs = np.flatnonzero(away | within)
        found = []
        mine = np.flatnonzero(~away)
        step = max(1, (16 << 20) // max(1, len(theirs) * sketch.shape[1]))
        for i in range(0, len(mine), step):
            at = mine[i : i + step]
            a, b = np.nonzero(root[at, None] != root[None, theirs])
            if not len(a):
                continue
            agree = (sketch[at, None, :] == sketch[None, theirs, :]).sum(axis=2)
            a, b = at[a], theirs[b]
            # Inside a block each pair is met from both its nodes.
            keep = (agree[root[at, None] != root[None, theirs]] >= least) & ((node[a] < node[b]) | ~within[b])
            found.append(np.stack([node[a[keep]], node[b[keep]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"u": pairs.min(axis=0), "v": pairs.max(axis=0)}) if pairs.shape[1] else None

    return by_key(rows, ["place"], compare, "u long, v long").distinct()


def _with_root(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the root of their component, of buckets that hold several components."""
    known = components(found).withColumnRenamed("node", "_node")
    rooted = members.join(bounded(known), members["node"] == F.col("_node"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted)
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b").select("bucket", "n")
    return rooted.join(open_, "bucket")


def groups(keyed: DataFrame, nodes: DataFrame, similarity: float, shingle: int, alike: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that link to another. ``nodes``: node, bands, sketch, and doc_id and text_key of one of its rows; ``alike``: pairs (u, v) that are compared too, before others."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = freed(materialise(buckets.join(shared, "bucket")))
    asked = members.select("node")
    if alike is not None:
        alike = freed(materialise(alike))
        asked = asked.unionByName(alike.select(F.explode(F.array("u", "v")).alias("node")))
    wanted = nodes.join(bounded(asked.distinct()), "node", "left_semi")
    sets = freed(stored(shingle_sets(keyed, wanted, shingle), "shingle-sets"))

    ends = members.select(F.explode(F.array("low", "high")).alias("u"), F.col("node").alias("v"))
    tried = materialise((ends if alike is None else ends.unionByName(alike)).where("u <> v").distinct())
    found = similar(tried, sets, similarity)
    members = members.select("bucket", "node")

    degree = found.groupBy("v").agg(F.count("*").alias("links"))
    left = freed(materialise(_with_root(members, found)))
    large = left.where(F.col("n") > LARGE)
    if not large.isEmpty():
        hubs = large.join(degree, large["node"] == degree["v"]).groupBy("bucket").agg(F.max_by(F.struct("node", "root"), F.struct("links", "node")).alias("hub"))
        met = large.join(hubs, "bucket").where("hub.root <> root").select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()
        met = materialise(met.join(tried, ["u", "v"], "left_anti"))
        found = found.unionByName(similar(met, sets, similarity))
        tried = tried.unionByName(met)
        left = _with_root(members, found)

    pairs = likely(left, wanted.select("node", "sketch"), similarity)
    done = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = freed(materialise(pairs.join(done, ["u", "v"], "left_anti")))
    if not pairs.isEmpty():
        found = found.unionByName(similar(pairs, sets, similarity))
    return components(found)
