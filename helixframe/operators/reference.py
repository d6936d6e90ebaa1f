"""The reference genome: overlapping chunks, unique 20-mers, control reads, window lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.order import shuffled
from helixframe.functions.seq import K, has_n, kmer_codes, least_codes, piece, revcomp, turned, windows

CHUNK, OVERLAP = 4096, 1024
#: Bits of a number that hold a place in a chromosome and its strand; the chromosome's number stands above.
PLACE = 44


def chunks_of(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """chr, chunk_id, start0 and seq: ``CHUNK`` bases from chunk_id * CHUNK that run on for ``overlap`` more.

    ``pieces``: chr, at (0-based place) and seq of parts of chromosomes, of any length, that follow each other without a gap. Only pieces
    move, a chromosome is never put together; an array holds one chunk's pieces.
    """
    end = F.col("at") + F.length("seq")
    first = F.greatest(F.floor((F.col("at") - CHUNK - overlap) / CHUNK) + 1, F.lit(0))
    rows = pieces.where("seq <> ''").select("chr", F.col("at").cast("long").alias("at"), F.col("seq").cast("binary").alias("raw"), F.sequence(first, F.floor((end - 1) / CHUNK)).alias("ks"))
    lo = lambda k: F.greatest(k * CHUNK - F.col("at"), F.lit(0))
    hi = lambda k: F.least(k * CHUNK + CHUNK + overlap - F.col("at"), F.octet_length("raw").cast("long"))
    cut = F.transform("ks", lambda k: F.struct(k.alias("k"), (F.col("at") + lo(k)).alias("at"), F.substring("raw", (lo(k) + 1).cast("int"), (hi(k) - lo(k)).cast("int")).cast("string").alias("s")))
    each = rows.select("chr", F.explode(cut).alias("p")).select("chr", F.col("p.k").alias("chunk_id"), F.struct("p.at", "p.s").alias("p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "")
    return _marked(each.groupBy("chr", "chunk_id").agg(whole.alias("seq")), overlap)


def _marked(chunks: DataFrame, overlap: int) -> DataFrame:
    """The table of chunks, whose column ``seq`` carries how far they run on."""
    return chunks.select("chr", "chunk_id", (F.col("chunk_id") * CHUNK).alias("start0"), F.col("seq").alias("seq", metadata={"overlap": overlap}))


def overlap_of(chunks: DataFrame) -> int:
    return chunks.schema["seq"].metadata.get("overlap", OVERLAP)


def plain_bases(seq: Column) -> Column:
    """Upper case, N for all but A, C, G, T."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def ref_chunks(ref: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of a table of whole chromosomes (chr, seq); "NOP" is left out. Genomes in files are cut as they are read, see ``sources.files``."""
    return chunks_of(ref.where("chr <> 'NOP'").select("chr", F.lit(0).alias("at"), plain_bases(F.col("seq")).alias("seq")), overlap)


def wider(chunks: DataFrame, overlap: int) -> DataFrame:
    """The same chunks, running on for ``overlap`` bases at least: each gets the own parts of those behind it."""
    if overlap <= overlap_of(chunks):
        return chunks
    behind = F.sequence(F.lit(0), F.least(F.lit(-(-overlap // CHUNK)), F.col("chunk_id")).cast("int"))
    rows = chunks.select("chr", "chunk_id", F.col("seq").cast("binary").alias("raw"), F.explode(behind).alias("j"))
    size = F.when(F.col("j") == 0, CHUNK).otherwise(F.least(F.lit(CHUNK), overlap - (F.col("j") - 1) * CHUNK)).cast("int")
    parts = rows.select("chr", (F.col("chunk_id") - F.col("j")).alias("chunk_id"), F.struct("j", F.substring("raw", F.lit(1), size).cast("string").alias("s")).alias("p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "")
    return _marked(parts.groupBy("chr", "chunk_id").agg(whole.alias("seq")), overlap)


def ref_kmers(chunks: DataFrame) -> DataFrame:
    """code, chr, pos and dir of every 20-mer without N, on both strands; pos is that of the first base read."""
    return _numbered(chunks, ["chr"]).select("code", "chr", F.abs("at").alias("pos"), F.when(F.col("at") > 0, "f").otherwise("r").alias("dir"))


def _numbered(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, code and at (1-based place, negative for reverse 20-mers) of every 20-mer without N."""
    codes = kmer_codes(F.substring("seq", 1, CHUNK + 19))
    each = chunks.select(*keep, "start0", F.posexplode(codes).alias("i", "code")).where("code IS NOT NULL")
    at = F.col("start0") + F.col("i")
    sides = F.array(F.struct(F.col("code"), (at + 1).alias("at")), F.struct(turned(F.col("code")).alias("code"), (-(at + 20)).alias("at")))
    return each.select(*keep, F.explode(sides).alias("k")).select(*keep, "k.code", "k.at")


def ref20_unique(chunks: DataFrame) -> DataFrame:
    """code, chr, pos and dir of the 20-mers that occur once over both strands and all chromosomes."""
    one = ref20_least(chunks)
    at = F.col("at")
    sides = F.array(F.struct(F.col("code"), at.alias("at")), F.struct(turned(F.col("code")).alias("code"), F.when(at > 0, -(at + K - 1)).otherwise(-at - (K - 1)).alias("at")))
    each = one.select("chr", F.explode(sides).alias("k"))
    return each.select("k.code", "chr", F.abs("k.at").alias("pos"), F.when(F.col("k.at") > 0, "f").otherwise("r").alias("dir"))


def chr_ids(chunks: DataFrame) -> DataFrame:
    """chr and chr_id, its number: a row for each chromosome."""
    return chunks.select("chr").distinct().select("chr", F.row_number().over(Window.orderBy("chr")).alias("chr_id"))


def at_of(place: Column) -> Column:
    """The ``at`` of ``ref20_least`` of a number whose lower ``PLACE`` bits are the 0-based place of a 20-mer << 1, and 1 if the reverse complement has the smaller code."""
    start = F.shiftright(place.bitwiseAND(F.lit((1 << PLACE) - 1)), 1)
    return F.when(place.bitwiseAND(F.lit(1)) == 0, start + 1).otherwise(-(start + K))


def ref20_least(chunks: DataFrame) -> DataFrame:
    """code, chr and at of the 20-mers of ``ref20_unique``, of one strand of two: the smaller code; at is the 1-based place of its first base, negative for a reverse 20-mer.

    A 20-mer and its reverse complement occur equally often, so one of them is counted; one that is its own occurs twice at every place and is never unique.
    Codes and places are whole numbers, so counting is a hash aggregation; the chromosomes' names are put back at the end.
    """
    names = chr_ids(chunks)
    codes = least_codes(F.substring("seq", 1, CHUNK + K - 1))
    each = chunks.join(F.broadcast(names), "chr").select("chr_id", "start0", F.posexplode(codes).alias("i", "own")).where("own IS NOT NULL")
    place = F.shiftleft(F.col("chr_id").cast("long"), PLACE).bitwiseOR(F.shiftleft(F.col("start0") + F.col("i"), 1)).bitwiseOR(F.col("own").bitwiseAND(F.lit(1)))
    one = each.select(F.shiftright("own", 1).alias("code"), place.alias("place")).groupBy("code").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n = 1")
    return one.select("code", F.shiftright("place", PLACE).cast("int").alias("chr_id"), at_of(F.col("place")).alias("at")).join(F.broadcast(names), "chr_id").select("code", "chr", "at")


def control_reads(chunks: DataFrame, sample: str, length: int = 100, step: int = 2) -> DataFrame:
    """Reads made from the genome: windows of ``length`` bases every ``step``, without N, both strands, distinct."""
    wins = windows(wider(chunks, length), ["chr"], length, step, F.lit(CHUNK - 1)).where(~has_n(F.col("win")))
    return wins.select(F.lit(sample).alias("sample"), F.explode(F.array("win", revcomp(F.col("win")))).alias("seq")).distinct()


def with_window(df: DataFrame, chunks: DataFrame, chr_: str, off0: Column, size: Column, name: str, most: int | None = None) -> DataFrame:
    """Add ``name``: ``size`` bases of chromosome ``chr_`` from 0-based ``off0``; rows whose window leaves the genome go.

    A window is one chunk's substring, found by an equi-join on chromosome and chunk. ``most``: the largest size asked, if that can be more
    than the chunks run on for; they are made wider then. A larger window is an error, never a lost row.
    """
    chunks = wider(chunks, most or 0)
    limit = overlap_of(chunks)
    told = F.raise_error(F.format_string(f"a window of %d bases was asked of chunks that run on for {limit}", F.col("_size").cast("long")))
    asked = df.withColumns({"_off": off0, "_size": size}).where("_off >= 0").withColumn("_chunk", F.floor(F.col("_off") / CHUNK))
    asked = asked.withColumn("_size", F.when(F.col("_size") > limit, told.cast("int")).otherwise(F.col("_size").cast("int")))
    side = chunks.select(F.col("chr").alias("_chr"), F.col("chunk_id").alias("_id"), F.col("start0").alias("_start"), F.col("seq").alias("_seq"))
    joined = asked.join(shuffled(side), (F.col(chr_) == F.col("_chr")) & (F.col("_chunk") == F.col("_id")))
    found = joined.withColumn(name, piece(F.col("_seq"), F.col("_off") - F.col("_start") + 1, F.col("_size")))
    return found.where(F.length(name) == F.col("_size")).drop("_off", "_size", "_chunk", "_chr", "_id", "_start", "_seq")
