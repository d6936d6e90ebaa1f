"""Bidirectional alignment: seeds from both ends, SNPs, structural variants, read support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.order import shuffled
from helixframe.functions.seq import K, end_codes, first_code, mismatches, pack_ends, pack_size, pack_text, piece, read_size, revcomp, same_bases, strands, turned
from helixframe.operators.reads import single
from helixframe.operators.reference import CHUNK, wider, with_window

MARGINS = (0, 5, 10, 15)
VARIANT = ["chr", "pos", "ref", "alt"]
EVENT = ["hchr", "hpos", "tchr", "tpos", "dir", "type", "size"]


def unlike(uniq: DataFrame, ref20: DataFrame, chunks: DataFrame, sample: str, longest: int | None = None) -> DataFrame:
    """A sample's reads that can be aligned with a mismatch, of both strands."""
    rest = unlike_packs(uniq, ref20, chunks, sample, longest)
    return rest.select(F.lit(sample).alias("sample"), F.explode(strands("pack")).alias("seq")).where(F.length("seq") >= K + max(MARGINS))


def met(df: DataFrame, code: str, ref20: DataFrame, chr_: str, pos: str, ahead: str, own: str | None = None) -> DataFrame:
    """df with the place (``chr_``, ``pos``, and ``ahead``: on the forward strand) of the unique 20-mer in its column ``code``, which goes; rows without one go.

    ``ref20``: the table of ``ref20_least``, which has one row for a place, or of ``ref20_unique``, with a row for each strand. ``own``: for the former, a column that tells
    that ``code`` is a 20-mer's own code and not its reverse complement's, if the smaller one stands there already; it goes too.
    """
    if "at" not in ref20.columns:
        at = ref20.select(F.col("code").alias("_code"), F.col("chr").alias(chr_), F.col("pos").alias(pos), (F.col("dir") == "f").alias(ahead))
        return df.join(shuffled(at), F.col(code) == F.col("_code")).drop(code, "_code")
    at = ref20.select(F.col("code").alias("_code"), F.col("chr").alias(chr_), F.col("at").alias("_at"))
    if own is None:
        # Keys are columns made once, since a sort or a filter would make expressions anew for each comparison.
        own, keyed = "_own", computed(df, _turn=turned(F.col(code)))
        keyed = keyed.withColumn("_own", F.col(code) <= F.col("_turn")).withColumn(code, F.least(code, "_turn")).drop("_turn")
    else:
        keyed = df
    found = keyed.join(shuffled(at), F.col(code) == F.col("_code"))
    return found.select(*[c for c in df.columns if c not in (code, own)], chr_, _first_base(F.col(own), F.col("_at")).alias(pos), _on_forward(F.col(own), F.col("_at")).alias(ahead))


def _first_base(own: Column, at: Column) -> Column:
    """The 1-based place of the first base of a 20-mer that has the smaller code of both strands (``own``), or else the other, from ``at`` of ``ref20_least``."""
    return F.when(own, F.abs(at)).when(at > 0, at + K - 1).otherwise(-at - (K - 1))


def _on_forward(own: Column, at: Column) -> Column:
    """Whether such a 20-mer stands on the forward strand. No equality, which Spark would make a key of the join and deal the 20-mers anew for."""
    return F.when(own, at > 0).otherwise(at < 0)


def unlike_packs(uniq: DataFrame, ref20: DataFrame, chunks: DataFrame, sample: str, longest: int | None = None) -> DataFrame:
    """pack of a sample's reads that can be aligned with a mismatch: those that equal the genome as a whole go, with their reverse complements.

    One 20-mer of one strand places a pair of reads, so most reads are compared once, before rows for all margins are made of the rest. Nothing is lost:
    every unique head of such a read places it there, as a perfect match, and its complement's 20-mers occur on the other strand, so none is a unique forward one.
    """
    pack, size = F.col("pack"), F.col("size")
    # Reads that are not packed, and below those without a place, are spread and meet nothing.
    code = F.when(pack_size(pack).isNotNull(), first_code(pack)).otherwise(-1 - F.abs(F.xxhash64("pack") % (1 << 40)))
    one = computed(single(uniq).where(F.col("sample") == sample).select("pack"), size=pack_size(pack), own=code)
    one = one.where(F.coalesce(size, F.lit(K + max(MARGINS))) >= K + max(MARGINS))
    if "at" in ref20.columns:
        least = computed(one, turn=turned(F.col("own"))).withColumn("code", F.when(size.isNotNull(), F.least("own", "turn")).otherwise(F.col("own")))
        first = least.select("pack", "size", "code", (F.col("own") == F.col("code")).alias("is_own"))
        found = first.join(shuffled(ref20.select("code", "chr", "at")), "code", "left")
        found = found.select("pack", "size", "chr", _first_base(F.col("is_own"), F.col("at")).alias("pos"), _on_forward(F.col("is_own"), F.col("at")).alias("ahead"))
    else:
        found = one.withColumnRenamed("own", "code").join(shuffled(ref20.select("code", "chr", "pos", (F.col("dir") == "f").alias("ahead"))), "code", "left")
    placed = found.select("pack", "size", "ahead", F.coalesce("chr", F.lit("")).alias("chr"), F.when(F.col("ahead"), F.col("pos") - 1).otherwise(F.col("pos") - size).alias("off"))
    placed = placed.withColumn("chunk", F.coalesce(F.floor(F.col("off") / CHUNK), F.xxhash64("pack")))
    side = wider(chunks, longest or 0).select(F.col("chr").alias("_chr"), F.col("chunk_id").alias("_id"), F.col("start0").alias("_start"), F.col("seq").alias("_seq"))
    found = placed.join(shuffled(side), (F.col("chr") == F.col("_chr")) & (F.col("chunk") == F.col("_id")), "left")
    # Cut before the comparison, so that no chunk goes along with a read to Python.
    found = computed(found, there=piece(F.col("_seq"), F.col("off") - F.col("_start") + 1, size)).select("pack", "ahead", "there")
    rest = found.where(F.col("there").isNull() | ~same_bases("pack", "there", "ahead"))
    return rest.select("pack")


def head_seeds(uniq: DataFrame, ref20: DataFrame, sample: str) -> DataFrame:
    """seq, m, hchr, head_pos: 20-mers at each margin of a read that a unique forward 20-mer places; and ``tail``, the code of the 20-mer at that margin of its end.

    Reverse heads need no rows: the read's reverse complement is a read too.
    """
    reads = uniq.where((F.col("sample") == sample) & (F.length("seq") >= K + max(MARGINS))).select("seq", end_codes(F.col("seq"), MARGINS).alias("codes"))
    ends = F.array(*[F.struct(F.lit(m).alias("m"), F.get("codes", F.lit(2 * i)).alias("code"), F.get("codes", F.lit(2 * i + 1)).alias("tail")) for i, m in enumerate(MARGINS)])
    found = met(reads.select("seq", F.explode(ends).alias("e")).select("seq", "e.*"), "code", ref20, "hchr", "head_pos", "_ahead")
    return found.where("_ahead").select("seq", "m", "hchr", "head_pos", "tail")


def seed_pairs(heads: DataFrame, ref20: DataFrame) -> DataFrame:
    """Heads joined with the place of the read's tail at the same margin: tchr, tail_pos, tail_dir."""
    found = met(heads, "tail", ref20, "tchr", "tail_pos", "_ahead")
    return found.select(*[c for c in heads.columns if c != "tail"], "tchr", "tail_pos", F.when(F.col("_ahead"), "f").otherwise("r").alias("tail_dir"))


def _seeds(ends: DataFrame, keep: list[str], ref20: DataFrame) -> DataFrame:
    """``keep``, m, turn, hchr, head_pos, tchr, tail_pos, tail_dir: the places of heads and tails at all margins of packed reads, whose ``codes`` are those of ``pack_ends``."""
    least, wide = "at" in ref20.columns, 2 * len(MARGINS)
    code, turn = (lambda i, k=k: F.get("codes", F.lit(2 * i + k)) for k in (0, 1))
    key = lambda i: F.least(code(i), turn(i)) if least else code(i)
    own = lambda i: code(i) <= turn(i)
    seed = lambda i, m, back: F.struct(F.lit(m).alias("m"), F.lit(back).alias("turn"), key(i).alias("code"), own(i).alias("code_own"), key(i + 1).alias("tail"), own(i + 1).alias("tail_own"))
    sides = F.array(*[seed(wide * back + 2 * i, m, back) for back in (False, True) for i, m in enumerate(MARGINS)])
    seeds = ends.select(*keep, F.explode(sides).alias("e")).select(*keep, "e.*").where("code IS NOT NULL AND tail IS NOT NULL")
    given = (lambda name: name) if least else lambda name: None
    heads = met(seeds, "code", ref20, "hchr", "head_pos", "_ahead", given("code_own")).where("_ahead").drop("_ahead")
    return met(heads, "tail", ref20, "tchr", "tail_pos", "_ahead", given("tail_own")).withColumn("tail_dir", F.when(F.col("_ahead"), "f").otherwise("r")).drop("_ahead")


def aligned(uniq: DataFrame, ref20: DataFrame, chunks: DataFrame, sample: str, longest: int | None = None) -> DataFrame:
    """The seed pairs of a sample's reads with ``head``, without perfect matches.

    The rows of ``with_head(seed_pairs(head_seeds(...)))``; reads travel packed, with their strand beside them, and are spelled when all joins are done.
    """
    rest = unlike_packs(uniq, ref20, chunks, sample, longest).withColumn("n", read_size(F.col("pack"))).where(F.col("n") >= K + max(MARGINS))
    pairs = _seeds(rest.select("pack", "n", pack_ends(F.col("pack"), MARGINS).alias("codes")), ["pack", "n"], ref20)
    found = with_window(pairs, chunks, "hchr", F.col("head_pos") - 1 - F.col("m"), F.col("n"), "_head", longest)
    # Cut before the reads are spelled, so that no chunk waits beside a read for Python.
    found = computed(found, head=F.col("_head")).withColumn("seq", pack_text("pack", "turn"))
    return found.where("seq <> head").select("seq", "m", "hchr", "head_pos", "head", "tchr", "tail_pos", "tail_dir")


#: The columns that tell a read and its strand in place of its text: two names of 64 and 31 bits and whether it is turned.
READ = ["name", "other", "turn"]


def aligned_by_name(named: DataFrame, ref20: DataFrame, chunks: DataFrame, bit: int, longest: int | None = None) -> DataFrame:
    """The rows of ``aligned`` with ``READ`` and ``all`` (the places of all mismatches), for long reads: a sample's rows of ``reads.named``.

    Only names go with the seeds; a read meets its places where it lies and moves once, to the windows of the genome, with all its seeds there.
    """
    mine = named.where(F.col("has").bitwiseAND(F.lit(bit)) > 0)
    each = mine.select("name", F.xxhash64("pack").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("other"), "pack", read_size(F.col("pack")).alias("n")).where(F.col("n") >= K + max(MARGINS))
    pairs = _seeds(each.select("name", "other", pack_ends(F.col("pack"), MARGINS).alias("codes")), ["name", "other"], ref20)
    seeds = pairs.select(*READ, "hchr", (F.col("head_pos") - 1 - F.col("m")).alias("off"), F.struct("m", "tchr", "tail_pos", "tail_dir").alias("s"))
    places = seeds.repartition("name").groupBy(*READ, "hchr", "off").agg(F.collect_list("s").alias("seeds"))
    # No equality of the second names, which Spark would make a key of the join and deal the reads anew for.
    same = F.col("other").bitwiseXOR(F.col("_other")) == 0
    placed = each.join(shuffled(places.withColumnRenamed("other", "_other")), "name").where(same).drop("_other")
    found = with_window(placed, chunks, "hchr", F.col("off"), F.col("n"), "_head", longest)
    found = computed(found, head=F.col("_head")).withColumn("seq", pack_text("pack", "turn")).where("seq <> head")
    rows = found.withColumn("all", mismatches("seq", "head")).select(*READ, "seq", "head", "all", "hchr", "off", F.explode("seeds").alias("s"))
    return rows.select(*READ, "seq", "s.m", "hchr", (F.col("off") + 1 + F.col("s.m")).alias("head_pos"), "head", "s.tchr", "s.tail_pos", "s.tail_dir", "all")


def _read(df: DataFrame) -> list[str]:
    return READ if "name" in df.columns else []


def with_head(pairs: DataFrame, chunks: DataFrame, longest: int | None = None) -> DataFrame:
    """Add ``head``, the reference at the read's length from the head on; perfect matches go. ``longest``: the reads' length, if chunks may run on for less."""
    return with_window(pairs, chunks, "hchr", F.col("head_pos") - 1 - F.col("m"), F.length("seq"), "head", longest).where("seq <> head")


def collinear() -> Column:
    return (F.col("hchr") == F.col("tchr")) & (F.col("tail_dir") == "f") & (F.col("tail_pos") - F.col("head_pos") == F.length("seq") - K - 2 * F.col("m"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row: a generator of one row keeps filters from pulling the expressions apart."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_one")
    return df.select("*", one).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in columns])


def _base(text: str, i: Column) -> Column:
    return F.substring(text, i + 1, F.lit(1))


def matched(headed: DataFrame, most: int = 5) -> DataFrame:
    """Collinear reads with ``at``, the places (0-based, in the read) of their 1 to ``most`` mismatches between the margins."""
    inside = lambda i: (i >= F.col("m")) & (i < F.length("seq") - F.col("m"))
    found = headed.where(collinear())
    found = (found if "all" in found.columns else found.withColumn("all", mismatches("seq", "head")))
    # Only for collinear reads, wherever Spark puts the filters: others have many mismatches.
    found = found.withColumn("at", F.when(collinear(), F.filter("all", inside)))
    return found.where(F.size("at").between(1, most)).drop("all")


def align_snps(headed: DataFrame, most: int = 5) -> DataFrame:
    """seq, m, chr, pos, ref, alt of mismatches between the margins of collinear reads that have 1 to ``most`` of them."""
    one = matched(headed, most).select(*_read(headed), "seq", "m", "hchr", "head_pos", "head", F.explode("at").alias("i"))
    return one.select(*_read(headed), "seq", "m", F.col("hchr").alias("chr"), (F.col("head_pos") + F.col("i") - F.col("m")).alias("pos"), _base("head", F.col("i")).alias("ref"), _base("seq", F.col("i")).alias("alt"))


def snp_support(snps: DataFrame) -> DataFrame:
    """Number of distinct reads of each SNP."""
    return snps.select(*VARIANT, *(_read(snps) or ["seq"])).distinct().groupBy(*VARIANT).agg(F.count("*").alias("cnt"))


def _mismatches(window: str) -> Column:
    """1 where read and window differ, else 0, for each base."""
    return F.zip_with(F.split("seq", ""), F.split(window, ""), lambda a, b: (a != b).cast("int"))


def _first(indexes: Column) -> Column:
    return F.get(indexes, F.lit(0))


def sv_junctions(headed: DataFrame, chunks: DataFrame, longest: int | None = None) -> DataFrame:
    """Reads whose two ends place apart, with both junctions: hi and ti in the read, hpos and tpos in the genome.

    From the head, the first mismatch at 10 or beyond that two more of the next five bases follow (beyond the end all
    mismatch); all before must match and it must lie beyond m + 26. From the tail likewise backwards, where places
    before the start count from the end, and without the demand that all behind match.
    """
    length, m = F.length("seq"), F.col("m")
    off = F.when(F.col("tail_dir") == "f", F.col("tail_pos") - length + K + m - 1).otherwise(F.col("tail_pos") - K - m)
    both = with_window(headed.where(~collinear()), chunks, "tchr", off, length, "tail", longest)
    both = computed(both, tail2=F.when(F.col("tail_dir") == "f", F.col("tail")).otherwise(revcomp(F.col("tail")))).withColumn("tail", F.col("tail2")).drop("tail2")
    both = computed(both.where((F.length("seq") > K) & (F.instr("head", "N") == 0) & (F.instr("tail", "N") == 0)), hm=_mismatches("head"), tm=_mismatches("tail"))
    five = F.array(*map(F.lit, range(1, 6)))
    near = lambda i: F.aggregate(five, F.lit(0), lambda x, j: x + F.coalesce(F.get("hm", i + j), F.lit(1)))
    back = lambda i: F.aggregate(five, F.lit(0), lambda x, j: x + F.get("tm", F.pmod(i - j, F.size("tm"))))
    hi = _first(F.filter(F.sequence(F.lit(10), length - 1), lambda i: (F.get("hm", i) == 1) & (near(i) >= 2)))
    ti = _first(F.filter(F.sequence(length - 10, F.lit(1), F.lit(-1)), lambda i: (F.get("tm", i) == 1) & (back(i) >= 2)))
    found = computed(both, hi=hi, ti=ti)
    clean = F.aggregate(F.slice("hm", F.lit(1), F.col("hi")), F.lit(0), lambda x, y: x + y) == 0
    found = found.where((F.col("hi") > m + 26) & (F.col("ti") < length - 25 - m)).where(clean)
    tpos = F.when(F.col("tail_dir") == "f", F.col("tail_pos") - length + F.col("ti") + K + m).otherwise(F.col("tail_pos") + length - F.col("ti") - K - m)
    same, size = F.col("hchr") == F.col("tchr"), length - K - (F.col("tail_pos") - F.col("head_pos")) - 2 * m
    indel = same & (F.col("tail_dir") == "f")
    kind = F.when(indel, F.when(size > 0, "insertion").otherwise("deletion")).when(same, "inversion").otherwise("translocation")
    return found.select(
        "seq", "m", "hchr", (F.col("head_pos") + F.col("hi") - m).alias("hpos"), "tchr", tpos.alias("tpos"), F.col("tail_dir").alias("dir"),
        kind.alias("type"), F.when(indel, size).cast("long").alias("size"), F.col("hi").cast("int").alias("hi"), F.col("ti").cast("int").alias("ti"), "head", "tail",
    )


def sv_support(events: DataFrame) -> DataFrame:
    """Number of distinct reads of each event."""
    return events.select(*EVENT, "seq").distinct().groupBy(*EVENT).agg(F.count("*").alias("cnt"))


def _bars(window: str) -> Column:
    """A mark for each base that equals the window's, a space for each other."""
    return F.array_join(F.zip_with(F.split("seq", ""), F.split(window, ""), lambda a, b: F.when(a == b, "|").otherwise(" ")), "")


def snp_records(headed: DataFrame, most: int = 5) -> DataFrame:
    """chr, places (of the SNPs) and line (the text) of each read with SNPs: a header for each SNP, the reference, marks, the read."""
    place = lambda i: F.col("head_pos") + i - F.col("m")
    header = lambda i: F.concat_ws(" ", F.lit("#"), "hchr", place(i).cast("string"), F.lit("snp"), _base("head", i), _base("seq", i))
    text = F.concat_ws("\n", F.array_join(F.transform("at", header), "\n"), "head", _bars("head"), "seq")
    return matched(headed, most).select(F.col("hchr").alias("chr"), F.transform("at", place).alias("places"), text.alias("line")).distinct()


def sv_records(events: DataFrame) -> DataFrame:
    """chr, places (the head junction) and line of each event and read: header, head reference, marks, read, marks, tail reference."""
    header = F.concat_ws(" ", F.lit("#"), "hchr", F.col("hpos").cast("string"), "tchr", F.col("tpos").cast("string"), "dir", "type", F.coalesce(F.col("size").cast("string"), F.lit("")))
    text = F.concat_ws("\n", header, "head", _bars("head"), "seq", _bars("tail"), "tail")
    return events.select(F.col("hchr").alias("chr"), F.array("hpos").alias("places"), text.alias("line")).distinct()


def by_place(records: DataFrame) -> DataFrame:
    """chr, pos and line: a row for each variant that a record shows."""
    return records.select("chr", F.explode("places").alias("pos"), "line")


def write_search_table(records: DataFrame, path: str, rows: int = 20_000) -> None:
    """The records by place, in ranges of (chr, pos), sorted and in small row groups, so that a lookup reads few of them."""
    placed = by_place(records)
    sorted_ = placed.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos", "line")
    sorted_.write.mode("overwrite").option("parquet.block.row.count.limit", str(rows)).parquet(path)


def search_alignment(placed: DataFrame, chr_: str, pos: int) -> DataFrame:
    """Distinct records at a place. Both conditions reach the scan of a table that ``write_search_table`` made."""
    return placed.where((F.col("chr") == chr_) & (F.col("pos") == pos)).distinct()
