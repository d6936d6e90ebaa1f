"""Registered queries of the polymorphism engine, on DNA derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import K, with_text
from helixframe.operators import align, kmer, primer, reads, reference, tools, vcf, verify
from helixframe.plans.fixtures import LENGTH, tables
from helixframe.plans.oracle import ORACLES
from helixframe.sources.tables import stored

FLAGSHIP = "snp_genotypes"
TARGET, CONTROL = "target", "control"
#: Reads longer than half of what chunks run on for: windows over their variants take wider chunks.
LONG = 600
#: Reads of more bases go by names of a few bytes, not by their bases, where seeds and probes are looked up.
NAMED = 256


class Run:
    """The plan of one folder; every step is a lazy DataFrame built once."""

    def __init__(self, spark: SparkSession, sf_dir: str, length: int = LENGTH, kind: str = "first"):
        self.spark, self.sf_dir, self.length, self.kind, self.kept = spark, sf_dir, length, kind, False

    def other(self, length: int = LENGTH, kind: str = "first") -> Run:
        """The plan of the same folder with other reads."""
        return Run(self.spark, self.sf_dir, length, kind)

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return tables(self.spark, self.sf_dir, self.length, self.kind)

    @cached_property
    def reads(self) -> DataFrame:
        return self._tables[1]

    @cached_property
    def chunks(self) -> DataFrame:
        return self._tables[0]

    @cached_property
    def one(self) -> DataFrame:
        """Distinct reads of one strand, packed."""
        return reads.one_strand(self.reads)

    @cached_property
    def uniq(self) -> DataFrame:
        return reads.expanded(self.one)

    @cached_property
    def ref20(self) -> DataFrame:
        return reference.ref20_unique(self.chunks)

    @cached_property
    def least20(self) -> DataFrame:
        """The unique 20-mers of one strand."""
        return reference.ref20_least(self.chunks)

    @cached_property
    def counts(self) -> DataFrame:
        return kmer.kmer_count(self.one)

    @cached_property
    def lbc(self) -> DataFrame:
        return kmer.pivot_of_reads(self.one)

    @cached_property
    def joined(self) -> DataFrame:
        return kmer.join_of_reads(self.one, TARGET, CONTROL)

    @cached_property
    def edges(self) -> DataFrame:
        return kmer.kmer_edges(self.joined)

    @cached_property
    def mapped(self) -> DataFrame:
        return kmer.kmer_map(self.edges, self.least20)

    @cached_property
    def places(self) -> DataFrame:
        """Copy numbers, a row for both strands of a place."""
        return kmer.cnv_places(self.one, self.chunks, TARGET, CONTROL)

    @cached_property
    def heads(self) -> DataFrame:
        return align.head_seeds(self.uniq, self.least20, TARGET)

    @cached_property
    def pairs(self) -> DataFrame:
        return align.seed_pairs(self.heads, self.least20)

    @cached_property
    def named(self) -> DataFrame:
        """Distinct reads of both samples with names, for long reads."""
        return reads.named(self.reads, [TARGET, CONTROL])

    @cached_property
    def headed(self) -> DataFrame:
        """Stored, since several branches of a plan read it; of long reads it is not, as these are read again from their one shuffle."""
        if self.length > NAMED:
            return align.aligned_by_name(self.named, self.least20, self.chunks, 1, self.length)
        return stored(align.aligned(self.one, self.least20, self.chunks, TARGET, self.length), "headed")

    @cached_property
    def snps(self) -> DataFrame:
        return align.align_snps(self.headed)

    @cached_property
    def support(self) -> DataFrame:
        return align.snp_support(self.snps)

    @cached_property
    def events(self) -> DataFrame:
        return align.sv_junctions(self.headed, self.chunks, self.length)

    def keep_reads(self) -> None:
        """Store the distinct reads of both samples, for plans that read them again to verify."""
        if not self.kept:
            self.one, self.kept = stored(self.one, "reads"), True

    @cached_property
    def bi_snp(self) -> DataFrame:
        if self.length > NAMED:
            return verify.snp_genotypes_by_name(self.support, self.chunks, self.named, self.length)
        self.keep_reads()
        return verify.snp_genotypes(self.support, self.chunks, self.one, TARGET, CONTROL, self.length, self.length)

    @cached_property
    def sv(self) -> DataFrame:
        self.keep_reads()
        return verify.sv_genotypes(self.events, self.chunks, self.one, TARGET, CONTROL, self.length, self.length)

    @cached_property
    def kmer_snp(self) -> DataFrame:
        self.keep_reads()
        # Stored, as it is read to verify and again to be reported.
        return verify.kmer_genotypes(stored(self.mapped, "mapped"), self.chunks, self.one, TARGET, CONTROL, self.length, self.length)

    @cached_property
    def probes(self) -> DataFrame:
        return verify.snp_probes(verify.linked_snps(self.support, self.length), self.chunks, self.length, {TARGET: "t"})

    @cached_property
    def uneven(self) -> DataFrame:
        """Reads cut to different lengths by their number, for the clipping operators."""
        return self.reads.withColumn("seq", F.substring("seq", F.lit(1), F.when(F.col("id") % 10 == 0, 80).when(F.col("id") % 10 < 4, 90).otherwise(100)))


def _genotype_matrix(r: Run) -> DataFrame:
    """SNPs of two targets side by side."""
    return tools.genotype_matrix({"t1": r.bi_snp, "t2": r.other(kind="second").bi_snp})


def _sv_genotype_matrix(r: Run) -> DataFrame:
    """Structural variants of two targets side by side; the first has rearrangements that the second lacks."""
    return tools.genotype_matrix({"t1": r.other(kind="rearranged").sv, "t2": r.other(kind="second").sv}, tools.SV_KEY)


def _alignment_records(r: Run) -> DataFrame:
    """All alignment records, SNPs and structural variants, by place."""
    return align.by_place(align.snp_records(r.headed).unionByName(align.sv_records(r.events)))


def _cnv_sorted(r: Run) -> DataFrame:
    """All copy numbers with their places in the global order."""
    # Stored, as a sort by ranges reads its rows twice.
    return kmer.cnv_sorted(kmer.cnv_spread(stored(r.places, "places")))


PLANS: dict[str, Callable[[Run], DataFrame]] = {
    "reads_uniq": lambda r: r.uniq,
    "kmer_count": lambda r: with_text(r.counts, "code", "kmer"),
    "ref_kmers": lambda r: with_text(reference.ref_kmers(r.chunks), "code", "kmer"),
    "ref20_unique": lambda r: with_text(r.ref20, "code", "kmer"),
    "ref_control_reads": lambda r: reference.control_reads(r.chunks, "ref"),
    "last_base_pivot": lambda r: with_text(r.lbc, "prefix19", "prefix19", K - 1),
    "kmer_join": lambda r: with_text(r.joined, "prefix19", "prefix19", K - 1),
    "kmer_edges": lambda r: with_text(r.edges, "prefix19", "prefix19", K - 1),
    "kmer_map": lambda r: r.mapped,
    "cnv_counts": lambda r: kmer.cnv_spread(r.places),
    "head_seed_map": lambda r: r.heads.drop("tail"),
    "seed_pairs": lambda r: r.pairs,
    "align_snps": lambda r: r.snps,
    "snp_read_support": lambda r: r.support,
    "snp_probes": lambda r: r.probes,
    "snp_probe_hits": lambda r: verify.probe_hits(r.probes, r.one),
    "snp_genotypes": lambda r: r.bi_snp,
    "sv_junctions": lambda r: r.events.drop("head", "tail"),
    "sv_read_support": lambda r: align.sv_support(r.events),
    "sv_genotypes": lambda r: r.sv,
    "kmer_genotypes": lambda r: r.kmer_snp,
    "vcf_snp": lambda r: vcf.vcf_snp(r.bi_snp),
    "vcf_kmer": lambda r: vcf.vcf_kmer(r.kmer_snp),
    "vcf_sv": lambda r: vcf.vcf_sv(r.sv, r.events, r.chunks),
    "vcf_full": lambda r: vcf.full_vcf(vcf.vcf_snp(r.bi_snp), vcf.vcf_sv(r.sv, r.events, r.chunks)),
    "vcf_count": lambda r: vcf.vcf_count(r.support),
    "vcf_count_sv": lambda r: vcf.vcf_count_sv(align.sv_support(r.events), r.events, r.chunks),
    "search_alignment_sv": lambda r: align.search_alignment(align.by_place(align.sv_records(r.events)), "1", 2000),
    "cnv_sorted": _cnv_sorted,
    "clip_reads": lambda r: reads.clip_reads(r.reads.select("sample", "id", "seq"), 30),
    "auto_clip": lambda r: reads.auto_clip(r.uneven),
    "length_histogram": lambda r: reads.length_histogram(r.uneven),
    "search_alignment": lambda r: align.search_alignment(align.by_place(align.snp_records(r.headed)), "1", 200),
    "genotype_matrix": _genotype_matrix,
    "sv_genotype_matrix": _sv_genotype_matrix,
    "alignment_records": _alignment_records,
    "long_read_snp_genotypes": lambda r: r.other(LONG).bi_snp,
    "rearranged_junctions": lambda r: r.other(kind="rearranged").events.drop("head", "tail"),
    "rearranged_genotypes": lambda r: r.other(kind="rearranged").sv,
    "rearranged_vcf": lambda r: (lambda o: vcf.vcf_sv(o.sv, o.events, o.chunks))(r.other(kind="rearranged")),
    "primer_candidates": lambda r: primer.primer_candidates(primer.snp_regions(r.bi_snp, r.chunks), ["chr", "pos", "ref", "alt"]),
    "primer_pairs": lambda r: primer.primer_pairs(primer.snp_regions(r.bi_snp, r.chunks)),
    "sv_primer_pairs": lambda r: primer.primer_pairs(primer.sv_regions(r.sv, r.chunks), structural=True),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Run(spark, sf_dir))) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
