"""PCR primers around verified variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.seq import K, revcomp, windows
from helixframe.operators.align import computed
from helixframe.operators.reference import with_window

FLANK, GC = 250, 11


def snp_regions(bi_snp: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows to report with ``region``, 250 bases on either side."""
    return with_window(bi_snp.where("genotype IN ('H', 'M')"), chunks, "chr", F.col("pos") - FLANK, F.lit(2 * FLANK), "region")


def sv_regions(sv: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows to report with ``head`` and ``tail``, 250 bases before and behind the junctions."""
    indel = F.col("type").isin("insertion", "deletion")
    near, far = F.when(indel, F.least("hpos", "tpos")).otherwise(F.col("hpos")), F.when(indel, F.greatest("hpos", "tpos")).otherwise(F.col("tpos"))
    rows = with_window(sv.where("genotype IN ('H', 'M')"), chunks, "hchr", near - FLANK, F.lit(FLANK), "head")
    rows = with_window(rows, chunks, "tchr", far, F.lit(FLANK), "tail")
    return rows.withColumn("tail", F.when(F.col("type") == "inversion", revcomp(F.col("tail"))).otherwise(F.col("tail")))


def primer_candidates(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (left or right), i and primer: 20-mers with 11 bases that are not A or T, right ones turned."""
    wins = windows(regions.select(*keys, F.col("region").alias("seq")), keys, K)
    strong = F.length(F.translate("win", "AT", "")) == GC
    left, right = F.col("i") < FLANK - K, F.col("i").between(FLANK, 2 * FLANK - K - 1)
    return wins.where(strong & (left | right)).select(*keys, F.when(left, "left").otherwise("right").alias("side"), F.col("i").cast("long").alias("i"), F.when(left, F.col("win")).otherwise(revcomp(F.col("win"))).alias("primer"))


def _strong(text: str, starts: Column) -> Column:
    """Structs (w, at) of the 20-mers with 11 bases that are not A or T, in the order of their starts."""
    words = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(K)))
    return F.filter(words, lambda w: (F.length(w) == K) & (F.length(F.translate(w, "AT", "")) == GC))


def dimer(left: Column, turned: Column) -> Column:
    """Whether the ends of two primers pair: of their last i bases, 3 to 19, at least i - 1 are complementary. ``turned``: the right one's reverse complement."""
    base = lambda s, at: F.substring(s, at, F.lit(1))
    alike = lambda i: F.size(F.filter(F.sequence(F.lit(1), i), lambda j: base(left, K - i + j) == base(turned, j)))
    return F.exists(F.sequence(F.lit(3), F.lit(K - 1)), lambda i: alike(i) >= i - 1)


def primer_pairs(regions: DataFrame, structural: bool = False) -> DataFrame:
    """The rows with left, right, length and context; N where there is no pair.

    Lefts from the nearest to the farthest, rights in order, are folded with the best pair so far as the state: a pair takes its place if its product is
    shorter, has 70 bases or more and is no dimer, three times at most. A primer is placed where it first occurs, in its half of a structural variant or in all of a
    SNP's region.
    """
    columns = [c for c in regions.columns if c not in ("region", "head", "tail")]
    if structural:
        context = F.concat(F.substring("head", FLANK - K, K), F.lit(" "), F.substring("tail", 1, K))
        halves, inside = regions.withColumns({"_head": F.col("head"), "_tail": F.col("tail"), "_context": context}), F.coalesce(F.length("inside"), F.lit(0))
    else:
        # A product over a SNP counts its region as it stands; its right end lies 20 bases behind the right start.
        context = F.concat(F.substring("region", 100, 150), F.lit("["), "alt", F.lit("/"), "ref", F.lit("]"), F.substring("region", 251, 149))
        halves, inside = regions.withColumns({"_head": F.substring("region", 1, FLANK), "_tail": F.substring("region", FLANK + 1, FLANK), "_context": context}), F.lit(K)
    at = lambda whole, half, w, start: (F.instr(half, w) if structural else F.instr(whole, w) - start) - 1
    whole = F.col("_head") if structural else F.col("region")
    place = lambda half, start: lambda w: F.struct(w.alias("w"), at(whole, F.col(half), w, start).alias("at"))
    rows = halves.withColumns({
        "_lefts": F.transform(_strong("_head", F.sequence(F.lit(FLANK - K - 1), F.lit(0), F.lit(-1))), place("_head", 0)),
        "_rights": F.transform(_strong("_tail", F.sequence(F.lit(0), F.lit(FLANK - K - 1))), place("_tail", FLANK)),
        "_inside": inside,
    })
    state = lambda left, right, size, n: F.struct(left.alias("left"), right.alias("right"), size.cast("int").alias("size"), n.cast("int").alias("n"))
    none = F.lit(None).cast("string")

    def better(best: Column, left: Column, right: Column) -> Column:
        size = FLANK - left["at"] + right["at"] + F.col("_inside")
        shorter = (best["n"] < 3) & (size >= 70) & (best["size"].isNull() | (size < best["size"]))
        # The dearer test comes after the others.
        return F.when(F.when(shorter, ~dimer(left["w"], right["w"])).otherwise(F.lit(False)), state(left["w"], right["w"], size, best["n"] + 1)).otherwise(best)

    fold = F.aggregate("_lefts", state(none, none, F.lit(None), F.lit(0)), lambda best, left: F.when(best["n"] < 3, F.aggregate("_rights", best, lambda b, right: better(b, left, right))).otherwise(best))
    rows = computed(rows, _best=fold)
    given = lambda c: F.when(F.col("_best.n") > 0, c).otherwise("N")
    return rows.select(*columns, given(F.col("_best.left")).alias("left"), given(revcomp(F.col("_best.right"))).alias("right"), given(F.col("_best.size").cast("string")).alias("length"), given(F.col("_context")).alias("context"))
