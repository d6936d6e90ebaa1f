"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles.
Fingerprints link at ``radius`` or fewer differing bits, exactly.

Distinct fingerprints are dealt to tiles by the bits of two of ``radius + 2`` slices and by their population count. Fingerprints within
the radius agree in two slices at least and their counts differ by no more than the radius, so other pairs of tiles are skipped. Every
other pair of tiles is compared as a whole, a pair of blocks of about ``BLOCK`` at a time: numpy exclusive-or and bit counts. A task keeps,
of the links it finds, a spanning forest only, so a large group of near copies never becomes all its pairs; connected
components of the forests are those of all links. Copies share a fingerprint, which is compared once.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; a null doc_id is grouped but never names a component unless all its members are null;
repeated rows come back as often; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, freed, materialise, shuffle_width, stored
from .graph import components

SEED = 42
BLOCK = 1024


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 hashes of a text's word shingles, in their order; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(len(words) - shingle + 1, 1)
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text."""
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit integer."""

    return _printed(docs, "doc_id", "doc_id", shingle)


def _printed(rows: DataFrame, key: str, name: str, shingle: int = 3) -> DataFrame:
    """``name`` (column ``key``) and fp, the fingerprint of ``text``."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], np.uint64).view(np.int64))

    return rows.select(F.col(key).alias(name), fp("text").alias("fp"))


def bands(fp: Column, radius: int) -> Column:
    """Array of (band, value): of radius + 2 slices of the bits, every choice of two, with what the fingerprint has there.

    Fingerprints that differ in ``radius`` bits or fewer agree in two slices at least.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(k).alias("band"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("value")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def by_key(frame: DataFrame, keys: list[str], run: Callable[[dict[str, np.ndarray]], pd.DataFrame | None], schema: str, at_once: int = 1) -> DataFrame:
    """Run a function on all rows of each key; rows of a key are dealt to one task and sorted together.

    ``at_once``: whole keys are handed over together until they have so many rows.
    """
    dealt = frame.repartition(shuffle_width(frame.sparkSession), *keys).sortWithinPartitions(*keys)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []

        def work(rows: pd.DataFrame) -> None:
            ids = rows[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            if at_once > 1:
                ends = [0]
                for c in cuts[1:-1]:
                    if c - ends[-1] >= at_once:
                        ends.append(c)
                cuts = [*ends, len(rows)]
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            for a, b in zip(cuts, cuts[1:]):
                if (found := run({c: v[a:b] for c, v in columns.items()})) is not None:
                    out.append(found)

        for batch in batches:
            if not len(batch):
                continue
            last = batch[keys].iloc[-1]
            tail = (batch[keys] == last).all(axis=1).to_numpy()
            k = len(batch) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if k == 0 and held and (held[-1][keys].iloc[-1] == last).all():
                held.append(batch)
                continue
            work(pd.concat([*held, batch.iloc[:k]], ignore_index=True)) if held or k else None
            held = [batch.iloc[k:]]
            if out:
                yield pd.concat(out, ignore_index=True)
                out.clear()
        if held:
            work(pd.concat(held, ignore_index=True))
        if out:
            yield pd.concat(out, ignore_index=True)

    return dealt.mapInPandas(each, schema)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes can reach by the edges (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label


def places(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """place, node and home: what is compared where. A place holds the rows of one block (home) and of one other at most.

    A tile is a band's value and the population count of all bits; it is cut in blocks of about ``block``. A pair of tiles of
    one value whose counts differ beyond the radius is skipped; of any other pair each pair of blocks is one place.
    """
    rows = fps.select("node", F.explode(bands(F.col("node"), radius)).alias("b")).select("node", "b.band", "b.value", F.bit_count("node").alias("ones"))
    tiles = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    # A value has 65 tiles at most.
    shared = tiles.groupBy("band", "value").agg(F.sum("n").alias("n"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))).alias("tiles")).where("n > 1").drop("n")
    met = rows.join(shared, ["band", "value"])
    own = F.filter("tiles", lambda t: t["ones"] == F.col("ones"))[0]["blocks"]
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), own).cast("int"))
    near = F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["blocks"] - 1), lambda k: F.struct(t["ones"].alias("ones"), k.alias("block")))))
    mine = F.struct(F.col("ones").alias("ones"), F.col("block").alias("block"))
    sent = met.select("node", "band", "value", mine.alias("mine"), F.explode(others).alias("other"))
    place = F.xxhash64("band", "value", F.least("mine", "other"), F.greatest("mine", "other"))
    return sent.select(place.alias("place"), "node", (F.col("mine") <= F.col("other")).alias("home"))


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """A spanning forest (u, v) over ``node``, distinct fingerprints, of the links among them."""

    def compare(x: dict[str, np.ndarray]) -> pd.DataFrame | None:
        # Small places are handed over together; a link between two of them is a link too.
        home = x["home"].astype(bool)
        node, first = np.unique(np.concatenate([x["node"][home], x["node"][~home]]), return_index=True)
        order = np.argsort(first, kind="stable")
        node, n = node[order], len(np.unique(x["node"][home]))
        fp = node.view(np.uint64)
        found_u, found_v, held = [], [], 0
        step = max(1, 2_000_000 // len(node))
        for i in range(0, n, step):
            u, v = np.nonzero(np.bitwise_count(fp[i : min(i + step, n), None] ^ fp[None, :]) <= radius)
            keep = u + i < v
            found_u.append(u[keep] + i)
            found_v.append(v[keep])
            held += int(keep.sum())
            if held > 4_000_000:  # a dense group: keep its forest only
                label = forest(len(node), np.concatenate(found_u), np.concatenate(found_v))
                moved = np.flatnonzero(label != np.arange(len(label)))
                found_u, found_v, held = [moved], [label[moved]], 0
        if not held:
            return None
        label = forest(len(node), np.concatenate(found_u), np.concatenate(found_v))
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pd.DataFrame({"u": node[moved], "v": node[label[moved]]})

    return by_key(places(fps, radius, block), ["place"], compare, "u long, v long", at_once=2 * block)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, and component_id, the least doc_id that links reach, of every document."""
    own = stored(with_fingerprint(docs, shingle), "fingerprints")
    nodes = stored(own.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = components(links(nodes, radius, block))
    rooted = nodes.join(found, "node", "left").select(F.col("node").alias("fp"), "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _linked(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) of nodes to compare, from (node, fp): those of one fingerprint with its least, and the least ones of linked fingerprints."""
    least = prints.groupBy("fp").agg(F.min("node").alias("least"))
    fps = stored(least.select(F.col("fp").alias("node"), "least"), "fingerprint-nodes")
    same = prints.join(bounded(least), "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    ends = fps.select(F.col("node").alias("_fp"), "least")
    found = links(fps.select("node"), radius)
    found = found.join(bounded(ends.select(F.col("_fp").alias("u"), F.col("least").alias("a"))), "u").join(bounded(ends.select(F.col("_fp").alias("v"), F.col("least").alias("b"))), "v")
    return same.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 2) -> DataFrame:
    """The documents without near copies: of each group one row of the least (doc_id, hash of the text), null ids last.

    Documents are near copies if their sets of shingles of five words have the given Jaccard similarity, compared in
    full; groups are the connected components. Candidates are the links of SimHash fingerprints within ``radius`` bits, and, since
    similar texts may differ in more, those of min-hash bands (see ``near_copies``). Rows that repeat a doc_id with another text are documents
    of their own, and so are rows without doc_id.
    """
    from . import near_copies

    key = free_name("text_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    texts = keyed.select("doc_id", F.col(key).alias("text_key"), "text")
    signed = materialise(near_copies.with_signature(texts, shingle))
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = freed(materialise(signed.groupBy("node").agg(F.min(least).alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))))
    # The links of fingerprints go first, so their groups need few of the bands' comparisons.
    first = keyed.join(bounded(nodes.select("node", F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("_key"))), keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed[key] == F.col("_key")))
    prints = stored(_printed(first.select("node", "text"), "node", "node"), "fingerprints")
    alike = _linked(prints, radius)
    found = near_copies.groups(texts, nodes.select("node", "bands", "sketch", "least.doc_id", "least.text_key"), similarity, shingle, alike)
    # Nodes of one row that link to no other are left out: their rows stay.
    rooted = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").where("root IS NOT NULL OR rows > 1")
    rooted = rooted.select("node", "least", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    ids = freed(materialise(rooted.join(bounded(materialise(firsts)), "root").select("node", "first")))
    return _only_first(keyed, key, signed.join(bounded(ids), "node")).select(*docs.columns)


def _only_first(keyed: DataFrame, key: str, grouped: DataFrame) -> DataFrame:
    """Of ``keyed``, without the rows of ``grouped`` (doc_id, text_key, first) that are not their group's first; one row of each first."""
    doc, text = (free_name(c, keyed.columns) for c in ("found_doc", "found_key"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    counted = materialise(grouped.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(text), is_first.alias("is_first")).count())
    same = keyed["doc_id"].eqNullSafe(F.col(doc)) & (keyed[key] == F.col(text))
    gone = counted.where("NOT is_first").select(doc, text)
    kept = keyed.join(bounded(gone), same, "left_anti")
    twice = counted.where("is_first AND count > 1").select(doc, text)
    if not twice.isEmpty():
        again = kept.join(bounded(twice), same, "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(bounded(twice), same, "left_anti").unionByName(again)
    return kept
