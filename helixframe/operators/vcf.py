"""VCF records: verified SNPs and structural variants, k-mer SNPs, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.order import shuffled
from helixframe.functions.seq import chr_key
from helixframe.operators.reference import with_window
from helixframe.operators.verify import sv_representatives

COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
INSERTION = ["hchr", "hpos", "tchr", "tpos", "type", "size"]
SYMBOLIC = "<DEL>|<INS>|<INV>|BND"


def chrom(chr_: Column) -> Column:
    """Short and numeric names get "chr" in front."""
    return F.when((F.length(chr_) <= 3) | chr_.rlike("^[0-9]+$"), F.concat(F.lit("chr"), chr_)).otherwise(chr_)


def truncated(x: Column) -> Column:
    """Three decimals, cut toward zero."""
    return (x * 1000).cast("long") / 1000


def quality(depth: Column, hits: Column) -> Column:
    """-10 log10 of (depth / 1000) ^ hits."""
    p = F.pow(depth * 0.001, hits)
    return F.when(p == 0, 1000.0).otherwise(truncated(-10 * hits * F.log10(depth * 0.001)))


def plain(x: Column) -> Column:
    """A number of three decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), r"0+$", ""), r"\.$", "")


def _record(df: DataFrame, ref: Column, alt: Column, info: Column, dp_info: Column) -> DataFrame:
    """Common part: AF, quality, genotype columns from tw, tm and genotype."""
    dp = F.col("tw") + F.col("tm")
    rows = df.where(dp > 0).withColumns({"_ref": ref, "_alt": alt, "_info": info})
    gt = F.when(F.col("genotype") == "M", "1/1").when(F.col("genotype") == "H", "0/1")
    af = truncated(F.col("tm") / dp)
    ad = F.format_string("%d,%d:%d", F.col("tw"), F.col("tm"), dp)
    text = F.concat(F.col("_info"), F.coalesce(F.concat(F.lit("GT="), gt, F.lit(";")), F.lit("")), F.lit("AF="), plain(af), F.lit(";DP="), dp_info.cast("string"))
    return rows.select(
        chrom(F.col("chr")).alias("chrom"), "pos", F.lit(".").alias("id"), F.col("_ref").alias("ref"), F.col("_alt").alias("alt"), quality(dp, F.col("tm")).alias("qual"), F.lit(".").alias("filter"),
        text.alias("info"), F.when(gt.isNull(), "AD:DP").otherwise("GT:AD:DP").alias("format"), F.coalesce(F.concat(gt, F.lit(":"), ad), ad).alias("sample"),
    )


def _primer_info(df: DataFrame) -> Column:
    if "left" not in df.columns:
        return F.lit("")
    return F.when(F.col("left") != "N", F.concat(F.lit("PL="), "left", F.lit(";PR="), "right", F.lit(";PCRLEN="), "length", F.lit(";"))).otherwise("")


def _reported(df: DataFrame, include_all: bool) -> DataFrame:
    return df.where("tm > 2") if include_all else df.where("tm > 2 AND genotype IN ('M', 'H')")


def vcf_snp(bi_snp: DataFrame, include_all: bool = False) -> DataFrame:
    """Verified SNPs seen more than twice in the target; with primers if the table has them."""
    return _record(_reported(bi_snp, include_all), F.col("ref"), F.col("alt"), _primer_info(bi_snp), F.col("tw") + F.col("tm"))


def vcf_kmer(kmer_snp: DataFrame) -> DataFrame:
    """Verified k-mer SNPs without repetition; DP in INFO is the number of mutant reads."""
    return _record(kmer_snp.where("genotype IN ('M', 'H')"), F.col("cont"), F.col("alt"), F.lit(""), F.col("tm")).distinct()


def insert_sequences(events: DataFrame) -> DataFrame:
    """The key of each insertion and ``insert``: the anchor base and the inserted bases of one of its own reads, null if that ends before."""
    one = sv_representatives(events.where("type = 'insertion'"), INSERTION)
    text = F.substring("seq", F.col("hi"), F.col("size") + 1)
    return one.select(*INSERTION, F.when(F.length(text) >= F.col("size"), text).alias("insert"))


def _placed(rows: DataFrame, chunks: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(rows with ``bases``, the reference at the record's place; ALT; what INFO says of the event, without homology)."""
    kind, size = F.col("type"), F.col("size")
    short = (kind == "deletion") & (size > -80)
    rows = with_window(rows, chunks, "hchr", F.col("hpos") - 2, F.when(short, F.abs(size) + 1).otherwise(F.lit(1).cast("long")).cast("int"), "bases")
    first = F.substring("bases", 1, 1)
    alt = (
        F.when(short, first).when(kind == "deletion", "<DEL>").when(kind == "insertion", F.coalesce("insert", F.lit("<INS>"))).when(kind == "inversion", "<INV>")
        .otherwise(F.concat(first, F.lit("]"), "tchr", F.lit(":"), F.col("tpos").cast("string")))
    )
    end, span = (F.col("tpos") + 1).cast("string"), size.cast("string")
    hom = F.lit("")
    if "inside" in rows.columns:
        hom = F.when(F.length("inside") > 0, F.concat(F.lit("HOMLEN="), F.length("inside").cast("string"), F.lit(";HOMSEQ="), "inside", F.lit(";"))).otherwise("")
    info = (
        F.when(kind == "deletion", F.concat(F.lit("SVTYPE=DEL;END="), end, F.lit(";"), hom, F.lit("SVLEN="), span, F.lit(";")))
        .when(kind == "insertion", F.concat(F.lit("SVTYPE=INS;END="), end, F.lit(";SVLEN="), span, F.lit(";")))
        .when(kind == "inversion", F.concat(F.lit("SVTYPE=INV;END="), F.col("tpos").cast("string"), F.lit(";")))
        .otherwise("SVTYPE=BND;")
    )
    return rows.withColumns({"chr": F.col("hchr"), "pos": F.col("hpos") - 1}), alt, info


def vcf_sv(sv: DataFrame, events: DataFrame, chunks: DataFrame, include_all: bool = False) -> DataFrame:
    """Verified structural variants; the record stands one base before the junction."""
    rows = _reported(sv, include_all).join(shuffled(insert_sequences(events)), INSERTION, "left")
    placed, alt, info = _placed(rows, chunks)
    return _record(placed, F.col("bases"), alt, F.concat(info, _primer_info(sv)), F.col("tw") + F.col("tm")).where("ref <> alt")


def full_vcf(snps: DataFrame, svs: DataFrame) -> DataFrame:
    return snps.unionByName(svs).orderBy(chr_key(F.regexp_replace("chrom", "^chr", "")), "pos")


def short_vcf(full: DataFrame) -> DataFrame:
    """Records with spelled-out alleles only."""
    return full.where(~F.concat_ws("\t", "alt", "info").rlike(SYMBOLIC))


def count_limit(support: DataFrame, share: float = 0.999) -> DataFrame:
    """One row: the support that ``share`` of the variants do not exceed, and the largest; over the histogram of supports."""
    hist = support.groupBy("cnt").agg(F.count("*").alias("n"))
    whole = hist.agg(F.sum("n").alias("total"), F.max("cnt").alias("most"))
    # The histogram has a row per distinct support, far fewer than there are variants.
    up = hist.withColumn("sum", F.sum("n").over(Window.orderBy("cnt")))
    return up.crossJoin(F.broadcast(whole)).where(F.col("sum") >= F.col("total") * share).agg(F.min("cnt").alias("limit"), F.first("most").alias("most"))


def _counted(rows: DataFrame, ref: Column, alt: Column, info: Column) -> DataFrame:
    """Records of the highest support, quality and frequency from their counts."""
    af = truncated(F.col("cnt") / F.col("most"))
    gt = F.when(af < 1, "0/1").otherwise("1/1")
    return rows.select(
        chrom(F.col("chr")).alias("chrom"), "pos", F.lit(".").alias("id"), ref.alias("ref"), alt.alias("alt"), quality(F.col("cnt"), F.col("cnt")).alias("qual"), F.lit(".").alias("filter"),
        F.concat(info, F.lit("GT="), gt, F.lit(";AF="), plain(af), F.lit(";DP="), F.col("cnt").cast("string")).alias("info"), F.lit("GT:DP").alias("format"), F.concat(gt, F.lit(":"), F.col("cnt").cast("string")).alias("sample"),
    )


def vcf_count(support: DataFrame) -> DataFrame:
    """SNPs of the highest support."""
    return _counted(support.crossJoin(F.broadcast(count_limit(support))).where("cnt >= limit"), F.col("ref"), F.col("alt"), F.lit(""))


def vcf_count_sv(support: DataFrame, events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Structural variants of the highest support; type, end and length stay in INFO."""
    rows = support.crossJoin(F.broadcast(count_limit(support))).where("cnt >= limit")  # the limit is one row
    placed, alt, info = _placed(rows.join(shuffled(insert_sequences(events)), INSERTION, "left"), chunks)
    return _counted(placed, F.col("bases"), alt, info).where("ref <> alt")
