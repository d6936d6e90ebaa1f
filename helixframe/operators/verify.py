"""Verification: probe windows around candidates, hits among distinct reads, genotypes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.order import shuffled
from helixframe.functions.seq import least_pack, piece, revcomp, window_names, windows
from helixframe.operators.align import VARIANT, computed
from helixframe.operators.reads import single
from helixframe.operators.reference import with_window

REGION = 1 << 20
SV_KEY = ["hchr", "hpos", "tchr", "tpos", "dir", "type", "size", "inside"]


def linked_snps(support: DataFrame, length: int) -> DataFrame:
    """Add ``linked``: well supported SNPs (16 reads or more) just upstream, of the last ten, that a probe spans.

    Chromosomes are cut in regions; SNPs near a region's end are seen by the next region too.
    """
    strong = F.floor(1 + F.col("cnt") / 4) >= 5
    own = F.floor(F.col("pos") / REGION)
    shown = F.when(F.pmod("pos", F.lit(REGION)) >= REGION - length, F.array(own, own + 1)).otherwise(F.array(own))
    rows = support.withColumns({"own": own, "region": F.explode(shown)})
    one = F.struct("pos", "ref", "alt")
    seen = F.collect_list(F.when(strong, one)).over(Window.partitionBy("chr", "region").orderBy("pos").rangeBetween(-length, 0))
    listed = rows.withColumn("seen", seen).where("own = region")
    before = F.filter(F.array_sort("seen"), lambda x: x <= one)
    last = F.when(F.size(before) > 10, F.slice(before, -10, 10)).otherwise(before)
    near = F.filter(last, lambda x: (x["pos"] >= F.col("pos") - length + 2) & (x["pos"] < F.col("pos")))
    return listed.withColumn("linked", near).drop("own", "region", "seen")


def _windows(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    """keys, tag and seq: all windows of the columns wild (tag w) and mutant (m), exploded from the same rows."""
    both = F.array(*[F.struct(F.lit(t).alias("t"), F.col(c).alias("s")) for t, c in (("w", "wild"), ("m", "mutant"))])
    wins = windows(df.select(*keys, F.explode(both).alias("_b")).select(*keys, F.col("_b.t").alias("tag"), F.col("_b.s").alias("seq")), [*keys, "tag"], length)
    return wins.select(*keys, "tag", F.col("win").alias("seq"))


def _tagged(wins: DataFrame, keys: list[str], samples: dict[str, str]) -> DataFrame:
    """The windows as probes of each sample, whose tags get its prefix."""
    asked = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(p).alias("p")) for s, p in samples.items()])
    return wins.select("*", F.explode(asked).alias("_a")).select("_a.sample", "seq", *keys, F.concat("_a.p", "tag").alias("tag"))


def _spans(linked: DataFrame, chunks: DataFrame, length: int) -> DataFrame:
    """The SNPs with ``wild`` and ``mutant``, the bases that windows of ``length`` bases over each of them have."""
    wide = with_window(linked, chunks, "chr", F.col("pos") - length, F.lit(2 * length - 1), "wild", 2 * length - 1)
    mutant = F.concat(F.substring("wild", 1, length - 1), F.col("alt"), F.substring("wild", length + 1, length))
    place = lambda x: (x["pos"] - (F.col("pos") - length)).cast("int")  # noqa: E731  1-based
    folded = F.aggregate("linked", mutant, lambda s, x: F.overlay(s, x["alt"], place(x), F.lit(1)))
    return wide.withColumn("mutant", folded)


def snp_windows(linked: DataFrame, chunks: DataFrame, length: int) -> DataFrame:
    """Windows of ``length`` bases over each SNP: ``w`` of the reference, ``m`` of the mutant sequence."""
    return _windows(_spans(linked, chunks, length), VARIANT, length)


def snp_probes(linked: DataFrame, chunks: DataFrame, length: int, samples: dict[str, str]) -> DataFrame:
    """Probes of the samples' read length over each SNP. ``samples``: prefix of the tags by sample."""
    return _tagged(snp_windows(linked, chunks, length), VARIANT, samples)


def probe_hits(probes: DataFrame, uniq: DataFrame) -> DataFrame:
    """Probes that are a read of their sample, on either strand. A semi join: equal probes each count."""
    return probes.withColumn("pack", least_pack("seq")).join(shuffled(single(uniq)), ["sample", "pack"], "left_semi").drop("pack")


def window_hits(wins: DataFrame, keys: list[str], uniq: DataFrame, samples: dict[str, str]) -> DataFrame:
    """keys and tag of the windows that are reads of samples, a row for each of these, whose prefix the tag gets.

    Windows travel once for all samples, packed, and meet one row of each read, which tells the samples that have it.
    """
    has = {p: f"_in_{i}" for i, p in enumerate(samples.values())}
    side = single(uniq).where(F.col("sample").isin(*samples))
    side = side.groupBy("pack").agg(*[F.max(F.col("sample") == s).alias(has[p]) for s, p in samples.items()])
    met = wins.select(*keys, "tag", least_pack("seq").alias("pack")).join(shuffled(side), "pack")
    tags = F.filter(F.array(*[F.when(F.col(c), F.concat(F.lit(p), "tag")) for p, c in has.items()]), lambda x: x.isNotNull())
    return met.select(*keys, F.explode(tags).alias("tag"))


def named_hits(linked: DataFrame, chunks: DataFrame, length: int, named: DataFrame, prefixes: list[str]) -> DataFrame:
    """The rows of ``window_hits(snp_windows(linked, chunks, length), ...)`` over the reads of ``reads.named``, whose samples' tags get ``prefixes``.

    Windows travel as names of 64 bits and meet the reads where these lie; what meets is cut again and compared by another 64 bits, a hash of the packed bases.
    """
    text = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("text")) for t, c in (("w", "wild"), ("m", "mutant"))])
    spans = _spans(linked, chunks, length).select(*VARIANT, F.explode(text).alias("b")).select(*VARIANT, "b.tag", "b.text")
    asked = spans.select(*VARIANT, "tag", F.posexplode(window_names(F.col("text"), length)).alias("i", "name"))
    likely = asked.join(shuffled(named), "name").select(*VARIANT, "tag", "i", F.xxhash64("pack").alias("hash"), "has").join(shuffled(spans), [*VARIANT, "tag"])
    likely = computed(likely, seq=piece(F.col("text"), F.col("i") + 1, F.lit(length))).select(*VARIANT, "tag", "hash", "has", "seq")
    found = likely.where(F.xxhash64(least_pack("seq")) == F.col("hash"))
    tags = F.array_compact(F.array(*[F.when(F.col("has").bitwiseAND(F.lit(1 << i)) > 0, F.concat(F.lit(p), "tag")) for i, p in enumerate(prefixes)]))
    return found.select(*VARIANT, F.explode(tags).alias("tag"))


def genotype() -> Column:
    """M homozygous, H heterozygous, R reference, N not applicable, from cw, cm, tw and tm."""
    cw, cm, tw, tm = (F.col(c) for c in ("cw", "cm", "tw", "tm"))
    het = (10 * tm > 3 * (tm + tw)) & (10 * tm < 7 * (tm + tw)) & (tw >= 5)
    return F.when((cw >= 5) & (cm <= 1), F.when((tm >= 5) & (tw <= 1), "M").when(het, "H").otherwise("R")).otherwise("N")


def hit_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cw, cm, tw, tm and genotype of every variant with a hit."""
    counts = [F.sum((F.col("tag") == t).cast("long")).alias(t) for t in ("cw", "cm", "tw", "tm")]
    return hits.groupBy(*keys).agg(*counts).withColumn("genotype", genotype())


def snp_genotypes(support: DataFrame, chunks: DataFrame, uniq: DataFrame, target: str, control: str, length: int, control_length: int) -> DataFrame:
    """chr, pos, ref, alt, cw, cm, tw, tm and genotype; positions below a read length go."""
    hits = [window_hits(snp_windows(linked_snps(support, n), chunks, n), VARIANT, uniq, samples) for n, samples in _by_length(target, control, length, control_length)]
    return hit_counts(reduce(DataFrame.unionByName, hits), VARIANT).where(F.col("pos") >= max(length, control_length))


def snp_genotypes_by_name(support: DataFrame, chunks: DataFrame, named: DataFrame, length: int) -> DataFrame:
    """The rows of ``snp_genotypes`` for long reads of one length, over the table ``reads.named`` of target and control, in this order."""
    hits = named_hits(linked_snps(support, length), chunks, length, named, ["t", "c"])
    return hit_counts(hits, VARIANT).where(F.col("pos") >= length)


def _by_length(target: str, control: str, length: int, control_length: int) -> list[tuple[int, dict[str, str]]]:
    """Samples of one read length share their probes."""
    if length == control_length:
        return [(length, {target: "t", control: "c"})]
    return [(length, {target: "t"}), (control_length, {control: "c"})]


def kmer_candidates(mapped: DataFrame) -> DataFrame:
    """Mapped k-mer edges as SNPs of support 25, with the control's base taken out of the alternative once."""
    alt = F.when(F.instr("alt", F.col("cont")) > 0, F.overlay("alt", F.lit(""), F.expr("instr(alt, cont)"), F.lit(1))).otherwise(F.col("alt"))
    one = mapped.select("chr", "pos", F.col("cont").alias("ref"), alt.alias("alt")).distinct()
    return one.withColumn("cnt", F.lit(25).cast("long"))


def kmer_genotypes(mapped: DataFrame, chunks: DataFrame, uniq: DataFrame, target: str, control: str, length: int, control_length: int) -> DataFrame:
    """The mapped edges with verified counts and genotype, joined on position only."""
    verified = snp_genotypes(kmer_candidates(mapped), chunks, uniq, target, control, length, control_length)
    far = mapped.where(F.col("pos") >= max(length, control_length))
    return far.join(shuffled(verified.select("chr", "pos", "cw", "cm", "tw", "tm", "genotype")), ["chr", "pos"])


JUNCTIONS = ["hchr", "hpos", "tchr", "tpos"]


def sv_representatives(events: DataFrame, keys: list[str] = JUNCTIONS) -> DataFrame:
    """One event per pair of junctions (or other keys): first by direction, type, size as text, larger hi, read."""
    order = Window.partitionBy(*keys).orderBy("dir", "type", F.coalesce(F.col("size").cast("string"), F.lit("")), F.desc("hi"), "seq", "ti")
    return events.select("hchr", "hpos", "tchr", "tpos", "dir", "type", "size", "hi", "ti", "seq").distinct().withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def sv_windows(events: DataFrame, chunks: DataFrame, length: int) -> DataFrame:
    """Windows over each event's junction; the mutant joins head, inside and tail of the two places.

    Reads end before the junctions overlap (hi < ti), meet (hi = ti) or pass each other (hi > ti).
    """
    hi, ti, forward = F.col("hi"), F.col("ti"), F.col("dir") == "f"
    d = F.abs(ti - hi)
    inside = F.when(hi <= ti, F.substring("seq", hi + 1, d + 1)).otherwise(F.substring("seq", ti + 2, d - 1))
    size = F.when(hi == ti, length - 1).otherwise(length - d)
    head = F.when(hi < ti, F.col("hpos") - length + d - 1).otherwise(F.col("hpos") - length)
    tail = (
        F.when(forward, F.when(hi <= ti, F.col("tpos")).otherwise(F.col("tpos") + d - 1))
        .otherwise(F.when(hi < ti, F.col("tpos") - length + d - 1).otherwise(F.col("tpos") - length))
    )
    wild = F.when(hi > ti, F.col("hpos") - length - d).otherwise(F.col("hpos") - length)
    rows = sv_representatives(events).withColumns({"inside": inside, "part": size, "tail_at": tail, "wild_at": wild}).where("part >= 0")
    rows = with_window(rows, chunks, "hchr", head, F.col("part"), "head_part", 2 * length - 1)
    rows = with_window(rows, chunks, "tchr", F.col("tail_at"), F.col("part"), "tail_part", 2 * length - 1)
    rows = with_window(rows, chunks, "hchr", F.col("wild_at"), F.lit(2 * length - 1), "wild", 2 * length - 1)
    turned = F.when(forward, F.col("tail_part")).otherwise(revcomp(F.col("tail_part")))
    rows = rows.withColumn("mutant", F.concat("head_part", "inside", turned))
    return _windows(rows, SV_KEY, length)


def sv_genotypes(events: DataFrame, chunks: DataFrame, uniq: DataFrame, target: str, control: str, length: int, control_length: int) -> DataFrame:
    """hchr, hpos, tchr, tpos, dir, type, size, inside, cw, cm, tw, tm and genotype."""
    hits = [window_hits(sv_windows(events, chunks, n), SV_KEY, uniq, samples) for n, samples in _by_length(target, control, length, control_length)]
    return hit_counts(reduce(DataFrame.unionByName, hits), SV_KEY).where((F.col("hpos") >= max(length, control_length)))
