"""A whole run: reads and a genome in, reports out. Tables that several steps use are written once and found again by what made them."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from dataclasses import dataclass
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import K, chr_key, with_text
from helixframe.operators import align, kmer, primer, reads, reference, vcf, verify
from helixframe.sources import files
from helixframe.sources.tables import exists, listing

log = logging.getLogger("helixframe")
METHODS = ("bidirectional", "kmer", "cnv")
#: Genomes whose files hold more sequences than are used: a pattern of names to leave out.
SKIPPED = {"hg38": "_"}


@dataclass
class Options:
    """What a run needs: folders or files of reads, a genome (FASTA) and where results go.

    ``control`` "reference" makes the control's reads from the genome. ``method``: bidirectional with a genome, kmer without one. Names of the
    sequences come from ``chromosomes``, or from the entry ``genome`` of a ``catalog``, or from the headers; ``skip`` is a pattern of names to leave out.
    """

    target: str
    control: str
    out: str
    ref: str | None = None
    method: str | None = None
    chromosomes: list[str] | None = None
    catalog: str | None = None
    genome: str | None = None
    skip: str | None = None
    clip: int | None = None
    cutoff: int = 3
    primers: bool = True
    fasta: bool = False

    @classmethod
    def parse(cls, text: str) -> Options:
        """From key=value pairs with commas between; names of chromosomes are separated by spaces."""
        found = dict(pair.split("=", 1) for pair in text.split(",") if pair)
        true = lambda x: x.lower() in ("1", "true", "yes")
        kinds = {"clip": int, "cutoff": int, "primers": true, "fasta": true, "chromosomes": str.split}
        return cls(**{k: kinds.get(k, str)(v) for k, v in found.items()})

    def __post_init__(self) -> None:
        self.method = self.method or ("bidirectional" if self.ref else "kmer")
        self.skip = self.skip or SKIPPED.get(self.genome or "")
        if self.method not in METHODS:
            raise ValueError(f"method is one of {', '.join(METHODS)}")
        if self.method != "kmer" and not self.ref:
            raise ValueError(f"{self.method} needs a genome")


@cache
def code_version() -> str:
    """A digest of the engine's own modules: tables of other code are not found again."""
    found = hashlib.sha256()
    for part in ("functions", "operators", "sources", "plans"):
        for module in sorted(resources.files("helixframe").joinpath(part).iterdir(), key=lambda m: m.name):
            if module.name.endswith(".py"):
                found.update(module.name.encode() + module.read_bytes())
    return found.hexdigest()


class Engine:
    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.o, self.made, self.keys = spark, options, [], {}

    def once(self, name: str, plan, *made_from: str, bucket: str | None = None, **options) -> DataFrame:
        """The table ``name``, made only if the output folder has none of the same making.

        Its key digests the code, the keys of the tables it is made from, and ``options``; the key names its folder and lies beside it in full.
        ``bucket``: a column by whose hash it is stored in buckets, so joins on it move the other side only.
        """
        making = json.dumps({"table": name, "code": code_version(), "from": {n: self.keys[n] for n in made_from}, "options": options}, sort_keys=True)
        key = hashlib.sha256(making.encode()).hexdigest()[:24]
        self.keys[name] = key
        path = f"{self.o.out.rstrip('/')}/tables/{name}/{key}"
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if not exists(self.spark, f"{path}/_SUCCESS"):
            began = time.time()
            if bucket:
                writer = plan().repartition(width, bucket).write.mode("overwrite").bucketBy(width, bucket).sortBy(bucket)
                self.spark.sql(f"DROP TABLE IF EXISTS helixframe_{name}_{key}")
                writer.option("path", path).saveAsTable(f"helixframe_{name}_{key}")
            else:
                plan().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(making, width)], "making string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}.making")
            self.made.append(name)
            log.info("%s made in %.1f s", name, time.time() - began)
        if not bucket:
            return self.spark.read.parquet(path)
        if not self.spark.catalog.tableExists(f"helixframe_{name}_{key}"):
            # Another session's table: its buckets are told to this one's catalog.
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            buckets = self.spark.read.json(f"{path}.making").first()["buckets"]
            self.spark.sql(f"CREATE TABLE helixframe_{name}_{key} ({columns}) USING parquet CLUSTERED BY ({bucket}) SORTED BY ({bucket}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(f"helixframe_{name}_{key}")

    def names(self) -> list[str] | None:
        """Names of the genome's sequences in order, if they do not come from its headers."""
        if self.o.chromosomes or not self.o.catalog:
            return self.o.chromosomes
        return files.chromosome_names(files.read_catalog(self.spark, self.o.catalog), self.o.genome or "") or None

    def chunks(self, most: int = 0) -> DataFrame:
        """The genome's chunks, running on for ``most`` bases at least."""
        names = self.names()
        plan = lambda: files.read_genome(self.spark, self.o.ref, names, self.o.skip)
        own = self.once("ref_chunks", plan, files=listing(self.spark, self.o.ref), names=names, skip=self.o.skip)
        if most <= reference.overlap_of(own):
            return own
        return self.once("ref_chunks_wide", lambda: reference.wider(own, most), "ref_chunks", most=most)

    def ref20(self) -> DataFrame:
        chunks = self.chunks()
        return self.once("ref20", lambda: reference.ref20_unique(chunks), "ref_chunks", bucket="code")

    def clip(self) -> int | None:
        """Clipping as told, or what the target's lengths ask for; the control follows it."""
        if self.o.clip is not None:
            return self.o.clip
        target = listing(self.spark, self.o.target)
        return self.once("clip", lambda: reads.auto_clip(files.read_fastq(self.spark, self.o.target, "target")), files=target).first()["clip"]

    def uniq(self) -> DataFrame:
        clip, own = self.clip(), self.o.control == "reference"
        chunks = self.chunks() if own else None

        def plan() -> DataFrame:
            cut = lambda rows: reads.clip_reads(rows, int(clip)) if clip else rows
            target = reads.both_strands(cut(files.read_fastq(self.spark, self.o.target, "target")))
            if own:
                return target.unionByName(reference.control_reads(chunks, "control"))
            return target.unionByName(reads.both_strands(cut(files.read_fastq(self.spark, self.o.control, "control"))))

        inputs = {"target": listing(self.spark, self.o.target), "control": None if own else listing(self.spark, self.o.control), "clip": clip}
        return self.once("reads_uniq", plan, *(["ref_chunks"] if own else []), **inputs)

    def lengths(self) -> tuple[int, int]:
        return reads.read_length(self.uniq(), "target"), reads.read_length(self.uniq(), "control")

    def _text(self, df: DataFrame, name: str, order: list, header: list[str] = ()) -> str:
        path = f"{self.o.out.rstrip('/')}/{name}"
        files.write_lines(df, path, df.columns, order, header)
        return path

    def _vcf(self, df: DataFrame, name: str) -> str:
        return self._text(df, name, [chr_key(F.regexp_replace("chrom", "^chr", "")), "pos", "ref", "alt"], files.vcf_header(self.o.ref or "", self.o.control))

    def bidirectional(self) -> dict[str, str]:
        length, control_length = self.lengths()
        most = 2 * max(length, control_length) - 1
        uniq, ref20, chunks = self.uniq(), self.ref20(), self.chunks(most)
        genome = "ref_chunks_wide" if "ref_chunks_wide" in self.keys else "ref_chunks"
        sides = ("target", "control", length, control_length)
        headed = self.once("headed", lambda: align.aligned(uniq, ref20, chunks, "target", length), "reads_uniq", "ref20", genome)
        snps = self.once("snps", lambda: align.align_snps(headed), "headed")
        events = self.once("events", lambda: align.sv_junctions(headed, chunks, length), "headed")
        support = self.once("snp_support", lambda: align.snp_support(snps), "snps")
        bi_snp = self.once("bi_snp", lambda: verify.snp_genotypes(support, chunks, uniq, *sides), "snp_support")
        sv = self.once("sv", lambda: verify.sv_genotypes(events, chunks, uniq, *sides), "events")
        sv_support = self.once("sv_support", lambda: align.sv_support(events), "events")
        records = self.once("records", lambda: align.snp_records(headed).unionByName(align.sv_records(events)), "headed", "events")
        with_primers = {"bi_snp": bi_snp, "sv": sv}
        if self.o.primers:
            found = {"bi_snp": lambda: primer.primer_pairs(primer.snp_regions(bi_snp, chunks)), "sv": lambda: primer.primer_pairs(primer.sv_regions(sv, chunks), structural=True)}
            with_primers = {k: self.once(f"{k}_primers", plan, k) for k, plan in found.items()}
        full = self.once("full_vcf", lambda: vcf.vcf_snp(with_primers["bi_snp"]).unionByName(vcf.vcf_sv(with_primers["sv"], events, chunks)), *(["bi_snp_primers", "sv_primers"] if self.o.primers else ["bi_snp", "sv"]))
        snp_order, sv_order = [chr_key(F.col("chr")), "pos", "ref", "alt"], [chr_key(F.col("hchr")), "hpos", "tchr", "tpos", "type"]
        search = f"{self.o.out.rstrip('/')}/aln.search"
        align.write_search_table(records, search)
        out = {
            "bi_snp": self._text(bi_snp, "bi.snp", snp_order), "snp_count": self._text(support, "bi.snp.count", snp_order),
            "sv": self._text(sv, "sv.txt", sv_order), "sv_count": self._text(sv_support, "sv.count", sv_order),
            "full_vcf": self._vcf(full, "full.vcf"), "vcf": self._vcf(vcf.short_vcf(full), "short.vcf"),
            "count_vcf": self._vcf(vcf.vcf_count(support).unionByName(vcf.vcf_count_sv(sv_support, events, chunks)), "count.vcf"),
            "aln": self._text(records.select(F.concat("line", F.lit("\n")).alias("line"), "chr", "places").select("line"), "aln", ["line"]),
            "aln_search": search,
        }
        if self.o.primers:
            out |= {f"{k}_primers": self._text(df, f"{k}.primer", snp_order if k == "bi_snp" else sv_order) for k, df in with_primers.items()}
        return out

    def kmer(self) -> dict[str, str]:
        uniq = self.uniq()
        counts = self.once("kmer_count", lambda: kmer.kmer_count(uniq), "reads_uniq")
        edges = self.once("kmer_edges", lambda: kmer.kmer_edges(kmer.kmer_join(kmer.last_base_pivot(counts), "target", "control"), self.o.cutoff), "kmer_count", cutoff=self.o.cutoff)
        if not self.o.ref:
            return {"kmer": self._text(with_text(edges, "prefix19", "prefix19", K - 1), "kmer.snp", ["prefix19"])}
        ref20, lengths = self.ref20(), self.lengths()
        chunks = self.chunks(2 * max(lengths) - 1)
        mapped = self.once("kmer_map", lambda: kmer.kmer_map(edges, ref20), "kmer_edges", "ref20")
        found = self.once("kmer_snp", lambda: verify.kmer_genotypes(mapped, chunks, uniq, "target", "control", *lengths), "kmer_map", "reads_uniq")
        return {"kmer": self._text(found, "kmer.snp", [chr_key(F.col("chr")), "pos", "prefix19", "alt"]), "vcf": self._vcf(vcf.vcf_kmer(found), "kmer.vcf")}

    def cnv(self) -> dict[str, str]:
        uniq, ref20 = self.uniq(), self.ref20()
        counts = self.once("kmer_count", lambda: kmer.kmer_count(uniq), "reads_uniq")
        found = self.once("cnv", lambda: kmer.cnv_counts(counts, ref20, "target", "control"), "kmer_count", "ref20")
        return {"cnv": self._text(found, "cnv", kmer.cnv_order())}

    def run(self) -> dict[str, str]:
        """Paths of the results by name, with a report of what was made and how long it took."""
        began, root = time.time(), self.o.out.rstrip("/")
        out = getattr(self, self.o.method)()
        if self.o.ref and self.o.fasta:
            files.write_fasta(self.chunks(), f"{root}/genome.fa")
            out["fasta"] = f"{root}/genome.fa"
        found = files.discovered_chromosomes(self.chunks()) if self.o.ref else []
        rows = [
            f"method\t{self.o.method}", f"target\t{self.o.target}", f"control\t{self.o.control}", f"reference\t{self.o.ref or ''}", *[f"chromosome\t{c}" for c in found],
            *[f"made\t{x}" for x in self.made], f"seconds\t{time.time() - began:.1f}",
        ]
        write = lambda lines, path: self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
        write(rows, f"{root}/report")
        # Where the tables of the last run lie, for commands over stored results.
        write([f"{name}\t{root}/tables/{name}/{key}" for name, key in self.keys.items()], f"{root}/tables.current")
        log.info("%s finished in %.1f s", self.o.method, time.time() - began)
        return out | {"report": f"{root}/report"}


def main(text: str) -> None:
    """python -m helixframe.plans.run target=...,control=...,ref=...,out=..."""
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    for name, path in Engine(spark, Options.parse(text)).run().items():
        print(name, path, sep="\t")


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
