"""Readers of FASTQ, FASTA and genome catalogs; writers of FASTA and VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.seq import chr_key, plain_chr
from helixframe.operators.reference import CHUNK, OVERLAP, chunks_of, plain_bases
from helixframe.sources.xz import xz_lines

#: Splits of plain files up to which their line counts are broadcast.
SPLITS = 1_000_000


def split_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, split (where it begins), id (ascending within a split) and value of every line of the text files (plain, gz, bz2) that match."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")


def _small(splits: DataFrame) -> DataFrame:
    """A table of a row for each split, to be broadcast if there are not too many."""
    return F.broadcast(splits) if splits.limit(SPLITS + 1).count() <= SPLITS else splits


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, n (from 0, within the file) and value of every line of the text files (plain, gz, bz2) that match.

    A split counts its lines; the running sum over a file's splits, one row each, says where each begins. No file is one task unless its
    compression cannot be split.
    """
    lines = split_lines(spark, path, glob)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("count"), F.min("id").alias("least"))
    before = F.sum("count").over(Window.partitionBy("file").orderBy("split")) - F.col("count")
    splits = _small(splits.select("file", "split", "least", before.alias("before")))
    return lines.join(splits, ["file", "split"]).select("file", (F.col("id") - F.col("least") + F.col("before")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """sample and seq of FASTQ files: the second line of every four. Plain, gz, bz2 and xz files may be mixed.

    Plain and bz2 files are read by their splits, xz files by their blocks (see ``sources.xz``); a gz file is one stream.
    """
    lines = numbered_lines(spark, path, "*{q,.gz,.bz2}").unionByName(xz_lines(spark, path))
    return lines.where("n % 4 = 1").select(F.lit(sample).alias("sample"), F.trim("value").alias("seq"))


def fasta_pieces(spark: SparkSession, path: str, names: list[str] | None = None, skip: str | None = None) -> DataFrame:
    """chr, at and seq of the lines of FASTA files (plain, gz, bz2): each line's bases and their 0-based place in the chromosome.

    Files are read by splits, so neither a file nor a chromosome is ever one row. A line's record and place are running counts within its split; a
    row for each split carries on the number of records, and of bases since the last header, from the splits before. Names come
    from the headers, or from ``names`` in order of the records, over all files in order of their paths; records beyond the names are left out. Bases are
    upper-cased, anything but A, C, G, T becomes N; what stands before the first header is left out. ``skip``: a pattern of names to leave out; "NOP" always is.
    """
    lines = split_lines(spark, path).withColumn("header", F.col("value").startswith(">"))
    lines = lines.withColumn("seq", F.when(F.col("header"), "").otherwise(F.regexp_replace("value", r"\s", "")))
    # Both windows are dealt by file and split: one shuffle of the lines.
    order = Window.partitionBy("file", "split").orderBy("id")
    lines = lines.withColumn("record", F.sum(F.col("header").cast("long")).over(order))
    inside = F.sum(F.length("seq").cast("long")).over(Window.partitionBy("file", "split", "record").orderBy("id"))
    lines = lines.withColumn("at", inside - F.length("seq"))
    ends = lines.groupBy("file", "split").agg(F.max("record").alias("records"), F.max_by(F.col("at") + F.length("seq"), "id").alias("tail"))
    file = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("run", F.sum((F.col("records") > 0).cast("long")).over(file))
    ends = ends.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split")))
    # A row for each split of the genome's files.
    ends = ends.select("file", "split", F.coalesce(F.lag("open").over(file), F.lit(0)).alias("carried"), (F.sum("records").over(Window.orderBy("file", "split")) - F.col("records")).alias("before"), (F.sum("records").over(file) - F.col("records")).alias("own"))
    at = F.col("at") + F.when(F.col("record") == 0, F.col("carried")).otherwise(F.lit(0))
    placed = lines.join(_small(ends), ["file", "split"]).where(F.col("own") + F.col("record") > 0).select((F.col("before") + F.col("record")).alias("record"), at.alias("at"), "header", "value", "seq")
    if names is None:
        named = placed.where("header").select("record", plain_chr(F.col("value")).alias("chr"))
    else:
        named = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)] or [(0, "")], "record long, chr string")
    named = named.where("chr <> 'NOP'")
    named = named.where(~F.col("chr").rlike(skip)) if skip else named
    # A row for each sequence.
    return placed.where("seq <> ''").join(_small(named), "record").select("chr", "at", plain_bases(F.col("seq")).alias("seq"))


def read_genome(spark: SparkSession, path: str, names: list[str] | None = None, skip: str | None = None, overlap: int = OVERLAP) -> DataFrame:
    """The overlapping chunks of a genome in FASTA files; see ``fasta_pieces``."""
    return chunks_of(fasta_pieces(spark, path, names, skip), overlap)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """name, type and values of a genome catalog: tab-separated lines, comments and blank lines skipped."""
    rows = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").select(F.split("value", "\t").alias("x")).where("size(x) >= 3")
    return rows.select(F.col("x")[0].alias("name"), F.col("x")[1].alias("type"), F.slice("x", 3, 100_000).alias("values"))


def chromosome_names(catalog: DataFrame, name: str) -> list[str]:
    """Chromosomes of a genome: the numbers from start to end (none for 0 and 0), then the names."""
    row = catalog.where((F.col("name") == name) & (F.col("type") == "chromosome")).select("values").first()
    if row is None:
        return []
    start, end, *names = [v.strip() for v in row[0]]
    numbers = [str(i) for i in range(int(start), int(end) + 1)] if int(end or 0) else []
    return numbers + [n for n in names if n]


def discovered_chromosomes(chunks: DataFrame) -> list[str]:
    """Names found in a genome, in order, for genomes that the catalog does not list."""
    return [r["chr"] for r in chunks.select("chr").distinct().orderBy(chr_key(F.col("chr")), "chr").collect()]


def write_lines(df: DataFrame, path: str, columns: list[str], order: list, header: list[str] = ()) -> None:
    """Tab-separated text in order: range partitions, sorted, one part file each, in the order of their names; header lines are a part before them.

    Spark's adaptive execution joins small neighbouring ranges, so a small report has one part behind its header.
    """
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("N")) for c in columns])
    lines = df.orderBy(*order).select(text.alias("value"))
    if header:
        top = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(header)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
        lines = top.union(lines)
    lines.write.mode("overwrite").text(path)


#: INFO and FORMAT ids of the records: number, type and what they say.
INFO_IDS = {
    "GT": ("1", "String", "Genotype"), "AF": ("A", "Float", "Share of reads with the allele"), "DP": ("1", "Integer", "Reads that count"),
    "SVTYPE": ("1", "String", "Kind of structural variant"), "END": ("1", "Integer", "Last place of the variant"), "SVLEN": (".", "Integer", "Bases gained or lost"),
    "HOMLEN": (".", "Integer", "Length of the homology at the junction"), "HOMSEQ": (".", "String", "Homology at the junction"),
    "PL": ("1", "String", "Left primer"), "PR": ("1", "String", "Right primer"), "PCRLEN": ("1", "Integer", "Length of the product"),
}
FORMAT_IDS = {"GT": ("1", "String", "Genotype"), "AD": (".", "Integer", "Reads of either allele"), "DP": ("1", "Integer", "Reads that count")}


def vcf_header(reference: str, control: str) -> list[str]:
    lines = ["##fileformat=VCFv4.2", f"##reference={reference}", f"##control={control}"]
    for kind, ids in (("INFO", INFO_IDS), ("FORMAT", FORMAT_IDS)):
        lines += [f'##{kind}=<ID={name},Number={number},Type={type_},Description="{text}">' for name, (number, type_, text) in ids.items()]
    lines += [f'##ALT=<ID={x},Description="{text}">' for x, text in (("DEL", "Deletion"), ("INS", "Insertion"), ("INV", "Inversion"))]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])]


def write_fasta(chunks: DataFrame, path: str) -> None:
    """A genome's chunks as FASTA: a header for each chromosome, then a line for each chunk, in range partitions as ``write_lines`` makes them."""
    own = F.substring("seq", 1, CHUNK)
    text = F.when(F.col("chunk_id") == 0, F.concat(F.lit(">"), "chr", F.lit("\n"), own)).otherwise(own)
    chunks.orderBy(chr_key(F.col("chr")), "chr", "chunk_id").select(text.alias("value")).write.mode("overwrite").text(path)
