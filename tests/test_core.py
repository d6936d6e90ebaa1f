import bz2
import collections
import gzip
import itertools
import lzma
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.functions.seq import BASES, K, packed_runs, with_text
from helixframe.operators import align, kmer, primer, reads, reference, tools, vcf, verify
from helixframe.plans.queries import PLANS, Run
from helixframe.sources import files

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(TURN)


def genome(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def genome_of(chunks):
    """Chromosomes from their chunks."""
    parts = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["chr"], r["chunk_id"])):
        assert r["start0"] == r["chunk_id"] * reference.CHUNK == len(parts.get(r["chr"], ""))
        parts[r["chr"]] = parts.get(r["chr"], "") + r["seq"][: reference.CHUNK]
    return parts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_revcomp(spark):
    got = frame(spark, [("ACGTN",), ("",), ("AXC",), (None,)], "seq string").select(seq.revcomp(F.col("seq"))).collect()
    assert [r[0] for r in got] == ["NACGT", "", "GNT", None]


def test_windows_skip_short_rows(spark):
    df = frame(spark, [("a", "ACGTA"), ("b", "AC"), ("c", "")], "id string, seq string")
    assert sorted(map(tuple, seq.windows(df, ["id"], 3, 2).collect())) == [("a", 0, "ACG"), ("a", 2, "GTA")]


def test_chromosome_names(spark):
    names = frame(spark, [(">chr1 x",), (">CHR007",), (">NC_045512.2 y",), (">chrX",)], "n string")
    assert [r[0] for r in names.select(seq.plain_chr(F.col("n"))).collect()] == ["1", "7", "NC_045512.2", "X"]


def test_clipping(spark):
    df = frame(spark, [("s", "A" * 65), ("s", "C" * 29), ("s", "G" * 30 + "N")], "sample string, seq string")
    assert [r["seq"] for r in reads.clip_reads(df, 30).collect()] == ["A" * 30, "A" * 30]


@pytest.mark.parametrize("lengths, clip", [([100] * 10, None), ([100] * 9 + [80], 100), ([50] * 9 + [40], 75), ([250] * 9 + [100], 125), ([260] * 5 + [255] * 5, 127)])
def test_auto_clip(spark, lengths, clip):
    df = frame(spark, [("s", "A" * n) for n in lengths], "sample string, seq string")
    assert reads.auto_clip(df).first()["clip"] == clip


def test_both_strands_closed_and_distinct(spark):
    df = frame(spark, [("s", "ACCA"), ("s", "TGGT"), ("s", "ANNA"), ("s", None)], "sample string, seq string")
    assert sorted(r["seq"] for r in reads.both_strands(df).collect()) == ["ACCA", "TGGT"]


def test_length_histogram(spark):
    df = frame(spark, [("s", "A" * 3), ("s", "A" * 3), ("s", "A" * 2), ("s", "AN")], "sample string, seq string")
    assert sorted(map(tuple, reads.length_histogram(df).collect())) == [("s", 2, 1, 100), ("s", 3, 2, 66)]


def test_unique_kmers_and_chunks(spark):
    text = genome(9000) + "N" + genome(40, 2) + "acgt"
    ref = frame(spark, [("1", text), ("NOP", "ACGT")], "chr string, seq string")
    chunks = reference.ref_chunks(ref)
    got = {r["kmer"]: (r["chr"], r["pos"], r["dir"]) for r in seq.with_text(reference.ref20_unique(chunks), "code", "kmer").collect()}
    up, want = text.upper(), {}
    for i in range(len(up) - 19):
        w = up[i : i + 20]
        if "N" not in w:
            want.setdefault(w, []).append(("1", i + 1, "f"))
            want.setdefault(rc(w), []).append(("1", i + 20, "r"))
    assert got == {k: v[0] for k, v in want.items() if len(v) == 1}


def test_window_lookup_drops_what_leaves_the_genome(spark):
    text = genome(6000)
    chunks = reference.ref_chunks(frame(spark, [("1", text)], "chr string, seq string"))
    asked = frame(spark, [("1", 0), ("1", -1), ("1", 4090), ("1", 5995), ("2", 5)], "chr string, at int")
    got = {r["at"]: r["w"] for r in reference.with_window(asked, chunks, "chr", F.col("at"), F.lit(10), "w").collect()}
    assert got == {0: text[:10], 4090: text[4090:4100]}


def test_control_reads_cover_evenly(spark):
    chunks = reference.ref_chunks(frame(spark, [("1", genome(1000))], "chr string, seq string"))
    assert reference.control_reads(chunks, "ref").count() == 2 * 451


def test_kmer_counts_sum_to_windows(spark):
    uniq = reads.both_strands(frame(spark, [("s", genome(60, i)) for i in range(20)], "sample string, seq string"))
    counts = kmer.kmer_count(uniq)
    assert counts.agg(F.sum("cnt")).first()[0] == uniq.count() * 41
    assert kmer.last_base_pivot(counts).agg(F.sum(F.col("a") + F.col("c") + F.col("g") + F.col("t"))).first()[0] == uniq.count() * 41


@pytest.mark.parametrize("counts, found", [((20, 0, 0, 0, 0, 20, 0, 0), ("A", "C")), ((20, 0, 0, 0, 10, 10, 0, 0), ("A", "AC")), ((20, 0, 0, 0, 101, 20, 0, 0), None), ((20, 2, 0, 0, 0, 20, 0, 0), ("A", "C")), ((20, 2, 2, 0, 0, 20, 0, 0), None), ((20, 0, 0, 0, 20, 2, 0, 0), None)])
def test_edge_rule(spark, counts, found):
    df = frame(spark, [("P", *counts)], "prefix19 string, ca long, cc long, cg long, ct long, ta long, tc long, tg long, tt long")
    got = [(r["cont"], r["alt"]) for r in kmer.kmer_edges(df).collect()]
    assert got == ([found] if found else [])


@pytest.mark.parametrize("cw, cm, tw, tm, want", [(10, 0, 0, 12, "M"), (10, 0, 6, 7, "H"), (10, 0, 20, 2, "R"), (4, 0, 0, 12, "N"), (10, 2, 0, 12, "N"), (5, 1, 1, 5, "M"), (10, 0, 7, 3, "R"), (10, 0, 0, 0, "R")])
def test_genotype_rule(spark, cw, cm, tw, tm, want):
    df = frame(spark, [(cw, cm, tw, tm)], "cw long, cm long, tw long, tm long")
    assert df.select(verify.genotype()).first()[0] == want


def run_target(spark, text, target, length=100):
    ref = frame(spark, [("1", text)], "chr string, seq string")
    chunks = reference.ref_chunks(ref)
    rows = [("t", target[i : i + length]) for i in range(0, len(target) - length + 1, 4)] + [("c", text[i : i + length]) for i in range(0, len(text) - length + 1, 4)]
    uniq = reads.both_strands(frame(spark, rows, "sample string, seq string"))
    ref20 = reference.ref20_unique(chunks)
    headed = align.with_head(align.seed_pairs(align.head_seeds(uniq, ref20, "t"), ref20), chunks)
    return chunks, uniq, headed


def test_planted_snps(spark):
    text = genome(2500, 3)
    at = {400: "A", 480: "C", 1200: "G"}
    target = list(text)
    want = {}
    for p in at:
        new = "ACGT"["ACGT".index(text[p]) - 1]
        target[p] = new
        want[p + 1] = (text[p], new)
    chunks, uniq, headed = run_target(spark, text, "".join(target))
    found = verify.snp_genotypes(align.snp_support(align.align_snps(headed)), chunks, uniq, "t", "c", 100, 100).collect()
    assert {r["pos"]: (r["ref"], r["alt"]) for r in found} == want
    assert {r["genotype"] for r in found} == {"M"}  # 400 and 480 are linked: probes carry both


@pytest.mark.parametrize("kind", ["deletion", "insertion", "inversion"])
def test_planted_structure(spark, kind):
    text = genome(3000, 5)
    if kind == "deletion":
        target = text[:1000] + text[1030:]
    elif kind == "insertion":
        target = text[:1000] + genome(12, 9) + text[1000:]
    else:
        target = text[:1000] + rc(text[1000:1400]) + text[1400:]
    chunks, uniq, headed = run_target(spark, text, target)
    events = align.sv_junctions(headed, chunks)
    found = verify.sv_genotypes(events, chunks, uniq, "t", "c", 100, 100).collect()
    assert {r["type"] for r in found} == {kind}
    assert any(r["genotype"] == "M" for r in found)
    assert {r["size"] for r in found} == {{"deletion": -30, "insertion": 12, "inversion": None}[kind]}
    records = vcf.vcf_sv(verify.sv_genotypes(events, chunks, uniq, "t", "c", 100, 100), events, chunks).collect()
    assert records and all(r["info"].startswith({"deletion": "SVTYPE=DEL", "insertion": "SVTYPE=INS", "inversion": "SVTYPE=INV"}[kind]) for r in records)


def test_vcf_numbers(spark):
    df = frame(spark, [("1", 5, "A", "C", 20, 0, 1, 2 + 8, "M"), ("NC_0451", 6, "A", "C", 20, 0, 8, 2, "H"), ("2", 7, "A", "G", 20, 0, 5, 5, "H")], "chr string, pos long, ref string, alt string, cw long, cm long, tw long, tm long, genotype string")
    got = {r["pos"]: r for r in vcf.vcf_snp(df).collect()}
    assert set(got) == {5, 7}
    assert got[7]["info"] == "GT=0/1;AF=0.5;DP=10" and got[7]["qual"] == 100.0 and got[7]["sample"] == "0/1:5,5:10" and got[7]["chrom"] == "chr2"
    assert got[5]["info"] == "GT=1/1;AF=0.909;DP=11"


def test_genotype_matrix(spark):
    schema = "chr string, pos long, ref string, alt string, genotype string"
    a, b = frame(spark, [("10", 5, "A", "C", "M"), ("2", 9, "A", "C", "H")], schema), frame(spark, [("2", 9, "A", "C", "M")], schema)
    assert [(r["chr"], r["x"], r["y"]) for r in tools.genotype_matrix({"x": a, "y": b}).collect()] == [("2", "H", "M"), ("10", "M", "W")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=60), max_size=5), st.integers(1, 31))
def test_packed_kmers_by_brute_force(texts, k):
    code = lambda w: None if "N" in w else sum("ACGT".index(b) << 2 * i for i, b in enumerate(reversed(w)))
    assert seq.packed(pa.array(texts, pa.string()), k).to_pylist() == [[code(t[i : i + k]) for i in range(len(t) - k + 1)] for t in texts]


def test_codes_turn_and_are_spelled(spark):
    texts = [genome(k, k) for k in (19, 20)] + ["A" * 20, "T" * 20, "ACGT" * 5]
    for text in texts:
        k = len(text)
        df = frame(spark, [(seq.packed(pa.array([text]), k).to_pylist()[0][0],)], "code long")
        assert tuple(df.select(seq.spelled(F.col("code"), k), seq.spelled(seq.turned(F.col("code"), k), k)).first()) == (text, rc(text))


def best_pair(head, tail, inside, region=None):
    """The pair of primers, one pair after the other."""
    place = (lambda w, at: region.index(w) - at) if region else (lambda w, at: (tail if at else head).index(w))
    strong = lambda s: [w for w in (s[i : i + 20] for i in range(230)) if sum(b not in "AT" for b in w) == 11]
    best, n = None, 0
    for left in reversed(strong(head)):
        for right in strong(tail):
            size = 250 - place(left, 0) + place(right, 250) + inside
            pairs = any(sum(left[20 - i + j] == right[j] for j in range(i)) >= i - 1 for i in range(3, 20))
            if n < 3 and not pairs and size >= 70 and (best is None or size < best[2]):
                best, n = (left, rc(right), size), n + 1
    return best


def test_primer_pairs_by_brute_force(spark):
    snps, svs = [], []
    for i in range(12):
        region = genome(500, i)
        if i == 3:
            region = region[250:270] + region[20:]  # a right primer may stand at the start too
        if i == 4:
            region = "AT" * 250
        snps.append(("1", i, "A", "C", "H", region))
        svs.append(("1", i, "ACGT"[: i % 4] or None, region[:250], region[250:]))
    got = primer.primer_pairs(frame(spark, snps, "chr string, pos int, ref string, alt string, genotype string, region string")).collect()
    for r in got:
        region = snps[r["pos"]][5]
        want = best_pair(region[:250], region[250:], 20, region)
        assert (r["left"], r["right"], r["length"]) == ((want[0], want[1], str(want[2])) if want else ("N",) * 3)
        assert r["context"] == (f"{region[99:249]}[C/A]{region[250:399]}" if want else "N")
    assert {r["left"] == "N" for r in got} == {True, False}
    for r in primer.primer_pairs(frame(spark, svs, "hchr string, hpos int, inside string, head string, tail string"), structural=True).collect():
        _, i, inside, head, tail = svs[r["hpos"]]
        want = best_pair(head, tail, len(inside or ""))
        assert (r["left"], r["right"], r["length"], r["context"]) == ((want[0], want[1], str(want[2]), f"{head[229:249]} {tail[:20]}") if want else ("N",) * 4)


@pytest.mark.parametrize("length", [150, 600, 3000])
def test_no_variant_of_long_reads_is_lost(spark, length):
    """Planted SNPs in a genome of several chunks, with windows that run over one or more of their ends."""
    text = genome(16_000, length)
    target, places = list(text), [p for p in (3900, 4095, 4100, 4300, 4601, 8150, 8300, 11_000) if p > length]
    for p in places:
        target[p] = "ACGT"["ACGT".index(text[p]) - 1]
    target = "".join(target)
    step = max(4, length // 40)
    starts = sorted({s for p in places for s in range(max(0, p - length + 20), min(p - 15, 16_000 - length), step)})
    rows = [("t", target[i : i + length]) for i in starts] + [("c", text[i : i + length]) for i in starts]
    uniq = reads.both_strands(frame(spark, rows, "sample string, seq string").repartition(8))
    chunks = reference.ref_chunks(frame(spark, [("1", text)], "chr string, seq string"))
    ref20 = reference.ref20_unique(chunks)
    headed = align.with_head(align.seed_pairs(align.head_seeds(uniq, ref20, "t"), ref20), chunks, length)
    found = verify.snp_genotypes(align.snp_support(align.align_snps(headed)), chunks, uniq, "t", "c", length, length).collect()
    assert {r["pos"] - 1: (r["ref"], r["alt"]) for r in found} == {p: (text[p], target[p]) for p in places if p + 1 >= length}
    # Counts against the reads themselves.
    t_reads = {s for n, s in rows if n == "t"}
    for r in found:
        p = r["pos"] - 1
        wild = text[p - length + 1 : p + length]
        assert r["tw"] == sum(wild[i : i + length] in t_reads for i in range(len(wild) - length + 1))


def test_windows_over_several_chunks(spark):
    text = genome(20_000, 6)
    chunks = reference.ref_chunks(frame(spark, [("1", text)], "chr string, seq string"))
    asked = [(o, n) for o in (0, 1, 4095, 4096, 5000, 9000, 14_999, 17_000) for n in (1, 1024, 1025, 3000, 5000, 9001)]
    got = {(r["o"], r["n"]): r["w"] for r in reference.with_window(frame(spark, asked, "o int, n int").withColumn("chr", F.lit("1")), chunks, "chr", F.col("o"), F.col("n"), "w", 9001).collect()}
    assert got == {(o, n): text[o : o + n] for o, n in asked if o + n <= 20_000}
    with pytest.raises(Exception, match="a window of 1025 bases"):
        reference.with_window(frame(spark, [("1", 0, 1025)], "chr string, o int, n int"), chunks, "chr", F.col("o"), F.col("n"), "w").collect()


def test_ranks_of_the_whole_table(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["1", "2", "10", "X", "Y"]), rng.randrange(400), rng.choice("fr"), i, 0) for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = kmer.cnv_sorted(frame(spark, rows, "chr string, pos long, dir string, target_cnt long, control_cnt long").repartition(5)).collect()
            key = lambda r: (int(r[0]) if r[0].isdigit() else 0, r[1], r[0], r[2])
            assert sorted(r["place"] for r in got) == list(range(1, 3001))
            assert [key(r) for r in sorted(got, key=lambda r: r["place"])] == sorted(map(key, rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lines_are_written_in_order_by_many_tasks(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(5000)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        files.write_lines(frame(spark, rows, "i int, v string"), str(tmp_path / "x"), ["i", "v"], ["i"], ["#one", "#two"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted((tmp_path / "x").glob("part-*"))
    assert len(parts) == 5 and all(len(p.read_text().splitlines()) < 3000 for p in parts)
    assert lines_of(tmp_path / "x") == ["#one", "#two", *[f"{i}\tv{i}" for i in range(5000)]]


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    records = frame(spark, [(c, [p, p + 1], f"# {c} {p}") for c in ("1", "2") for p in range(0, 4000, 2)], "chr string, places array<long>, line string")
    align.write_search_table(records, str(tmp_path / "s"), 500)
    table = spark.read.parquet(str(tmp_path / "s"))
    found = align.search_alignment(table, "2", 1235)
    assert [r["line"] for r in found.collect()] == ["# 2 1234"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(chr,2)" in plan and "EqualTo(pos,1235)" in plan
    groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, sorted((tmp_path / "s").glob("*.parquet"))) for i in range(f.metadata.num_row_groups)]
    stats = [[g.column(k).statistics for k in (0, 1)] for g in groups]
    fit = [a.min <= "2" <= a.max and b.min <= 1235 <= b.max for a, b in stats]
    assert len(groups) >= 12 and 1 <= sum(fit) <= 2


def test_fastq_of_mixed_compression(spark, tmp_path):
    record = lambda s: f"@r\n{s}\n+\n{'I' * len(s)}\n".encode()
    (tmp_path / "a.fastq").write_bytes(record("ACGT") + record("AAAA"))
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(record("CCCC")))
    (tmp_path / "c.bz2").write_bytes(bz2.compress(record("GGGG")))
    (tmp_path / "d.xz").write_bytes(lzma.compress(record("TTTT")))
    (tmp_path / "notes.txt").write_text("no reads")
    got = files.read_fastq(spark, str(tmp_path), "s")
    assert sorted(r["seq"] for r in got.collect()) == ["AAAA", "ACGT", "CCCC", "GGGG", "TTTT"]


def test_fastq_cut_at_many_places(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for name, opener in (("a.fastq", open), ("b.fq", open), ("c.bz2", bz2.open), ("d.gz", gzip.open), ("e.xz", lzma.open)):
        with opener(tmp_path / name, "wb") as f:
            for i in range(700):
                want.append(genome(rng.randrange(1, 60), i))
                f.write(f"@{name} {i}\n{want[-1]}\n+\n{'@' * len(want[-1])}\n".encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997b", "4001b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = files.read_fastq(spark, str(tmp_path), "s")
            assert sorted(r["seq"] for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("ending", [b"\n", b""])
def test_xz_is_read_by_blocks(spark, tmp_path, ending):
    """Streams of one block each, cut anywhere: in lines, at their ends, blocks without a line break, empty ones, with padding."""
    from helixframe.sources import xz

    rng = random.Random(len(ending))
    lines = [genome(rng.choice([0, 1, 7, 60, 300]), i) for i in range(400)]
    text = "\n".join(lines).encode() + ending
    cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(30)), *(text.index(b"\n", i) + d for i in (100, 5000, 9000) for d in (0, 1)), *range(2000, 2010)})
    filters = [{"id": lzma.FILTER_DELTA, "dist": 2}, {"id": lzma.FILTER_LZMA2, "preset": 1}]
    data = b"".join(lzma.compress(text[a:b], filters=filters if a % 2 else None) + bytes(4 * (a % 3)) for a, b in zip(cuts, cuts[1:]))
    data += lzma.compress(b"")
    (tmp_path / "a.xz").write_bytes(data)
    read = lambda at, n: data[at : at + n]
    places = xz.blocks(read, len(data))
    assert len(places) == len(cuts) - 1 and b"".join(b"".join(xz.decompressed(read, *p)) for p in places) == text
    found = xz.xz_lines(spark, str(tmp_path))
    want = lines if lines[-1] or ending else lines[:-1]
    assert [r["value"] for r in sorted(found.collect(), key=lambda r: r["n"])] == want and {r["n"] for r in found.collect()} == set(range(len(want)))
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_xz_blocks_of_the_command(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("xz"):
        pytest.skip("no xz")
    want = [genome(50, i) for i in range(2000)]
    (tmp_path / "r.fastq").write_text("".join(f"@r\n{s}\n+\n{'I' * 50}\n" for s in want))
    subprocess.run(["xz", "--block-size=10000", str(tmp_path / "r.fastq")], check=True)
    assert sorted(r["seq"] for r in files.read_fastq(spark, str(tmp_path), "s").collect()) == sorted(want)


def test_catalog_names_run_on_over_several_files(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">x\nAC\n>y\nGG\n")
    (tmp_path / "2.fa").write_text(">z\nTT\n>w\nCC\n")
    assert genome_of(files.read_genome(spark, str(tmp_path), ["I", "NOP", "III"])) == {"I": "AC", "III": "TT"}


def lines_of(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


@pytest.fixture(scope="module")
def samples(tmp_path_factory):
    """A genome of two chromosomes, and reads of it with a SNP, a deletion and a SNP near the other chromosome's start."""
    folder = tmp_path_factory.mktemp("samples")
    one, two = genome(2400, 31), genome(1500, 32)
    (folder / "ref.fa").write_text(f">chr1 x\n{one[:1200]}\n{one[1200:].lower()}\n>chr2\n{two}\n")
    changed = [one[:700] + "ACGT"["ACGT".index(one[700]) - 1] + one[701:1300] + one[1330:], two[:600] + "ACGT"["ACGT".index(two[600]) - 1] + two[601:]]
    for name, texts in (("target", changed), ("control", [one, two])):
        (folder / name).mkdir()
        with gzip.open(folder / name / "reads.fastq.gz", "wt") as f:
            for text in texts:
                for i in range(0, len(text) - 99, 4):
                    f.write(f"@r\n{text[i : i + 100]}\n+\n{'I' * 100}\n")
    return folder, {("chr1", "701"), ("chr2", "601")}


def test_a_whole_bidirectional_run(spark, samples, tmp_path):
    from helixframe.plans.run import Engine, Options

    folder, snps = samples
    options = Options.parse(f"target={folder}/target,control={folder}/control,ref={folder}/ref.fa,out={tmp_path}")
    first = Engine(spark, options)
    out = first.run()
    assert "ref20" in first.made and "bi_snp" in first.made
    full = lines_of(tmp_path / "full.vcf")
    header, rows = [x for x in full if x.startswith("#")], [x.split("\t") for x in full if not x.startswith("#")]
    assert full[: len(header)] == header and header[0] == "##fileformat=VCFv4.2" and len(rows[0]) == 10
    assert {(r[0], r[1]) for r in rows if "SVTYPE" not in r[7]} == snps
    assert any("SVTYPE=DEL" in r[7] and "SVLEN=-30" in r[7] for r in rows)
    declared = {x.split("ID=")[1].split(",")[0] for x in header if x.startswith("##INFO")}
    assert {kv.split("=")[0] for r in rows for kv in r[7].split(";")} <= declared
    assert any("PL=" in r[7] and "PCRLEN=" in r[7] for r in rows)
    assert [r for r in lines_of(tmp_path / "short.vcf") if not r.startswith("#")] == ["\t".join(r) for r in rows if not any(x in r[4] + r[7] for x in ("<DEL>", "<INS>", "<INV>", "BND"))]
    aln = lines_of(tmp_path / "aln")
    assert any("deletion" in x for x in aln) and any(" snp " in x for x in aln) and lines_of(tmp_path / "count.vcf") and lines_of(tmp_path / "sv.count")
    assert set(out) >= {"report", "full_vcf", "vcf", "count_vcf", "aln", "sv_primers", "bi_snp_primers"} and lines_of(tmp_path / "report")[0] == "method\tbidirectional"
    again = Engine(spark, options)
    again.run()
    assert again.made == [] and lines_of(tmp_path / "full.vcf") == full


def test_whole_kmer_and_copy_number_runs(spark, samples, tmp_path):
    from helixframe.plans.run import Engine, Options

    folder, snps = samples
    base = dict(target=f"{folder}/target", control=f"{folder}/control", ref=f"{folder}/ref.fa")
    Engine(spark, Options(**base, out=str(tmp_path / "k"), method="kmer")).run()
    assert {tuple(x.split("\t")[:2]) for x in lines_of(tmp_path / "k" / "kmer.vcf") if not x.startswith("#")} == snps
    free = Engine(spark, Options(base["target"], base["control"], str(tmp_path / "f")))
    assert free.o.method == "kmer" and set(free.run()) == {"kmer", "report"} and lines_of(tmp_path / "f" / "kmer.snp")
    Engine(spark, Options(**base, out=str(tmp_path / "c"), method="cnv")).run()
    rows = [x.split("\t") for x in lines_of(tmp_path / "c" / "cnv")]
    assert [(int(r[0]), int(r[1])) for r in rows] == sorted((int(r[0]), int(r[1])) for r in rows) and {r[0] for r in rows} == {"1", "2"}
    own = Engine(spark, Options(base["target"], "reference", str(tmp_path / "r"), base["ref"], primers=False))
    own.run()
    assert {tuple(x.split("\t")[:2]) for x in lines_of(tmp_path / "r" / "bi.snp")} == {(c[3:], p) for c, p in snps}
    with pytest.raises(ValueError):
        Options("a", "b", "c", method="cnv")


@pytest.mark.parametrize("ending", ["fa", "fa.gz", "fa.bz2"])
def test_fasta_cut_at_many_places(spark, tmp_path, ending):
    rng = random.Random(9)
    want, opener = {}, {"fa": open, "fa.gz": gzip.open, "fa.bz2": bz2.open}[ending]
    for k, name in enumerate(("a", "b", "c")):
        with opener(tmp_path / f"{name}.{ending}", "wt") as f:
            f.write("lost before any header\n" if k == 1 else "")
            for i in range(4):
                text, width = genome(rng.choice([0, 1, 59, 3000, 9000]), 10 * k + i), rng.choice([1, 7, 60, 10_000])
                f.write(f">chr{name}{i} more words\n" + "".join(text[j : j + width].lower() + "\n" + ("\n" if j % 3 == 1 else "") for j in range(0, len(text), width)))
                want[f"{name}{i}"] = text
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    numbered = {str(i): t for i, t in enumerate(want.values())}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        for size in ("613b", "5001b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert genome_of(files.read_genome(spark, str(tmp_path))) == {k: t for k, t in want.items() if t}
        assert genome_of(files.read_genome(spark, str(tmp_path), skip="^b")) == {k: t for k, t in want.items() if t and k[0] != "b"}
        names = [str(i) if i != 5 else "NOP" for i in range(10)]
        assert genome_of(files.read_genome(spark, str(tmp_path), names)) == {k: t for k, t in numbered.items() if t and k in names}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_row_holds_a_chromosome(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one\n" + "\n".join(genome(60, i) for i in range(2000)) + "\n")
    pieces = files.fasta_pieces(spark, str(tmp_path))
    assert pieces.agg(F.max(F.length("seq"))).first()[0] == 60
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "BinaryFile" not in plan and "SinglePartition" not in plan.split("Scan text")[-1]


def test_a_genome_written_and_read_again(spark, tmp_path):
    chunks = reference.ref_chunks(frame(spark, [("2", genome(9000)), ("10", genome(5000, 2)), ("X", "ACGTN")], "chr string, seq string"))
    files.write_fasta(chunks, str(tmp_path / "g"))
    assert [x for x in lines_of(tmp_path / "g") if x.startswith(">")] == [">2", ">10", ">X"]
    assert genome_of(files.read_genome(spark, str(tmp_path / "g"))) == genome_of(chunks)
    assert files.discovered_chromosomes(chunks) == ["2", "10", "X"]


def test_tables_are_known_by_what_made_them(spark, samples, tmp_path):
    from helixframe.plans.run import Engine, Options

    folder, _ = samples
    base = dict(target=f"{folder}/target", control=f"{folder}/control", ref=f"{folder}/ref.fa", out=str(tmp_path), method="kmer")

    def made(**options):
        engine = Engine(spark, Options(**base | options))
        engine.run()
        return engine.made, [x for x in lines_of(tmp_path / "kmer.snp")]

    first, rows = made(cutoff=3)
    assert "kmer_edges" in first and rows
    assert made(cutoff=3) == ([], rows)
    again, none = made(cutoff=90)
    assert again == ["kmer_edges", "kmer_map", "kmer_snp"] and none == []
    assert made(cutoff=3) == ([], rows)
    turned, other = made(target=base["control"], control=base["target"])
    assert "reads_uniq" in turned and "ref20" not in turned and other != rows
    assert "reads_uniq" in made(clip=90)[0]
    (tmp_path / "new.fa").write_text((folder / "ref.fa").read_text().replace(">chr2", ">chr5"))
    assert "ref_chunks" in made(ref=f"{tmp_path}/new.fa")[0]
    assert {x.split("\t")[0] for x in lines_of(tmp_path / "kmer.snp")} == {"1", "5"}


def test_unique_20mers_lie_in_buckets(spark, samples, tmp_path):
    from helixframe.plans.run import Engine, Options

    folder, _ = samples
    options = Options(f"{folder}/target", f"{folder}/control", str(tmp_path), f"{folder}/ref.fa")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for turn in range(2):
            engine = Engine(spark, options)
            uniq, ref20 = engine.uniq(), engine.ref20()
            assert ("ref20" in engine.made) == (turn == 0)
            pairs = align.seed_pairs(align.head_seeds(uniq, ref20, "target"), ref20)
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            scans = [part for part in plan.split("Exchange")[1:] if "Scan parquet" in part.split("Exchange")[0]]
            # Two exchanges, of the reads; both scans of the 20-mers are read by their buckets.
            assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") + plan.count("SelectedBucketsCount") >= 2, (plan, scans)
            assert pairs.count() > 0
            # Another session's catalog does not know the table.
            spark.sql(f"DROP TABLE helixframe_ref20_{engine.keys['ref20']}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_commands_over_stored_results(spark, samples, tmp_path):
    from helixframe.plans import commands
    from helixframe.plans.run import Engine, Options

    folder, snps = samples
    (tmp_path / "catalog").write_text("G\tdescription\tx\nG\tchromosome\t1\t2\n")
    base = dict(ref=f"{folder}/ref.fa", primers=False, catalog=f"{tmp_path}/catalog", genome="G", fasta=True)
    Engine(spark, Options(f"{folder}/target", f"{folder}/control", f"{tmp_path}/one", **base)).run()
    Engine(spark, Options(f"{folder}/control", f"{folder}/control", f"{tmp_path}/two", **base)).run()
    assert [x for x in lines_of(tmp_path / "one" / "genome.fa") if x.startswith(">")] == [">1", ">2"]
    assert [x for x in lines_of(tmp_path / "one" / "report") if x.startswith("chromosome")] == ["chromosome\t1", "chromosome\t2"]
    rows = [x.split("\t") for x in lines_of(tmp_path / commands.compare(spark, f"{tmp_path}/one {tmp_path}/two", f"{tmp_path}/matrix").rsplit("/", 1)[-1])]
    assert rows[0] == ["chr", "pos", "ref", "alt", "one", "two"] and {(f"chr{r[0]}", r[1]) for r in rows[1:]} == snps and {r[5] for r in rows[1:]} == {"W"}
    commands.lengths(spark, f"{folder}/target", f"{tmp_path}/lengths")
    assert lines_of(tmp_path / "lengths")[0] == "length\tcount\tpercent" and lines_of(tmp_path / "lengths")[1].endswith("\t100")
    found = commands.search(spark, f"{tmp_path}/one", "1", 701)
    assert found and all(x.split("\n")[0].startswith("# 1 ") and "# 1 701 snp" in x for x in found)
    header, head, bars, read = found[0].split("\n")[-4:]
    assert len(head) == len(bars) == len(read) == 100 and [i for i in range(100) if head[i] != read[i]] == [i for i in range(100) if bars[i] == " "]
    assert commands.search(spark, f"{tmp_path}/one", "1", 5) == []


def test_fasta_and_catalog(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr01 first\nacgt\nRYGT\n>chr2\nAC\n>extra\nGG\n")
    (tmp_path / "catalog").write_text("# comment\n\nG\tdescription\tx\nG\tchromosome\t1\t2\tX\tNOP\nW\tchromosome\t0\t0\tI\tII\n")
    assert genome_of(files.read_genome(spark, str(tmp_path / "g.fa"))) == {"1": "ACGTNNGT", "2": "AC", "extra": "GG"}
    assert genome_of(files.read_genome(spark, str(tmp_path / "g.fa"), ["I", "NOP"])) == {"I": "ACGTNNGT"}
    catalog = files.read_catalog(spark, str(tmp_path / "catalog"))
    assert files.chromosome_names(catalog, "G") == ["1", "2", "X", "NOP"]
    assert files.chromosome_names(catalog, "W") == ["I", "II"]
    assert files.chromosome_names(catalog, "none") == []


def test_runs_hold_every_kmer_once(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 19, 20, 21, 29, 30, 100, 300)] + ["A" * 60, "ACGTACGTRACGT" * 6, "ACGT" * 12]
    runs = packed_runs(pa.array(seqs), pa.array([False] * len(seqs))).to_pylist()
    for seq, own in zip(seqs, runs, strict=True):
        spelt = []
        for r in own:
            size = (r & 15) + K
            spelt += ["".join(BASES[(r >> 5) >> 2 * (size - 1 - i) & 3] for i in range(size))[j : j + K] for j in range((r & 15) + 1)]
        assert spelt == [seq[i : i + K] for i in range(len(seq) - K + 1) if set(seq[i : i + K]) <= set(BASES)]


def test_kmer_counts_of_odd_letters_palindromes_and_both_strands(spark):
    turn = lambda s: "".join(dict(zip("ACGT", "TGCA")).get(b, "N") for b in reversed(s))
    rng = random.Random(5)
    half = "".join(rng.choice("ACGT") for _ in range(30))
    base = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = [base[i : i + 60] for i in range(0, 140, 7)] + [turn(base[i : i + 60]) for i in range(0, 140, 11)] + [half + turn(half), base[:25] + "R" + base[26:70], half[:10] + turn(half[:10]) + "C", "A" * 40, "ACGT" * 9]
    uniq = reads.both_strands(frame(spark, [("s", s) for s in seqs], "sample string, seq string"))
    wanted = collections.Counter(s[i : i + K] for s in {x for q in seqs for x in (q, turn(q))} if "N" not in s for i in range(len(s) - K + 1) if set(s[i : i + K]) <= set(BASES))
    assert {r["kmer"]: r["cnt"] for r in with_text(kmer.kmer_count(uniq), "code", "kmer").collect()} == dict(wanted)


@pytest.mark.parametrize("name", ["kmer_join", "kmer_map", "cnv_counts", "head_seed_map", "snp_genotypes", "kmer_genotypes"])
def test_tables_of_kmers_and_windows_are_not_broadcast(spark, name):
    df = PLANS[name](Run(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "BroadcastHashJoin [" in line and not re.search(r"BroadcastHashJoin \[(chr#\d+, hap#\d+\]|chr#\d+\]|chr_id#\d+\])", line)]
    assert "SortMergeJoin" in plan and not sent


def test_reads_like_the_genome_go_before_seeding_and_no_alignment_is_lost(spark):
    text = genome(9000, 8)
    chunks = reference.ref_chunks(frame(spark, [("1", text), ("2", genome(5000, 9) + text[:50])], "chr string, seq string"))
    like = [text[i : i + 100] for i in range(0, 8900, 37)] + [rc(text[i : i + 100]) for i in range(5, 8900, 61)]
    mutant = [s[:k] + s[k].translate(TURN) + s[k + 1 :] for s, k in zip(like, itertools.cycle((3, 25, 50, 97)))]
    joined = [text[i : i + 50] + rc(text[i + 700 : i + 750]) for i in range(0, 4000, 301)]
    odd = [text[40:90] + "R" + text[91:140], text[4000:4050] + rc(text[4000:4050]), "A" * 100]
    uniq = reads.both_strands(frame(spark, [("t", s) for s in like + mutant + joined + odd], "sample string, seq string"))
    ref20 = reference.ref20_unique(chunks)
    plain = align.with_head(align.seed_pairs(align.head_seeds(uniq, ref20, "t"), ref20), chunks)
    found = align.aligned(uniq, ref20, chunks, "t")
    rows = lambda df: sorted(map(tuple, df.select("seq", "m", "hchr", "head_pos", "tchr", "tail_pos", "tail_dir", "head").collect()))
    assert rows(found) == rows(plain) and len(rows(plain)) > 300
    kept = {r["seq"] for r in align.unlike(uniq, ref20, chunks, "t").collect()}
    assert not kept & set(like[1:200]) and set(mutant) | set(joined) <= kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("ACGT", max_size=30), st.text("ACGTNacé", max_size=12)), max_size=12))
def test_packed_reads_come_back(texts):
    plain = lambda s: set(s) <= set("ACGT")
    back = seq.unpacked_reads(seq.packed_reads(pa.array(texts, pa.string())))[0]
    assert back.to_pylist() == texts
    least, own = (seq.packed_reads(pa.array(texts, pa.string()), **{how: True}) for how in ("least", "own"))
    folded, ends, paired = seq.unpacked_reads(least, strands=True)
    wanted = [sorted({s, rc(s)}) if plain(s) else [s] for s in texts]
    assert [folded.to_pylist()[a:b] for a, b in itertools.pairwise(ends)] == wanted
    assert paired.tolist() == [len(w) == 2 for w in wanted]
    assert [p is None for p in own.to_pylist()] == [plain(s) and rc(s) < s for s in texts]


def test_reads_travel_once_for_both_strands_and_packed(spark):
    """Reads, odd ones too, are one short row for both strands; probes of two samples meet them in one."""
    texts = [genome(100, i) for i in range(6)] + [rc(genome(100, 3)), "A" * 50 + "T" * 50, "x" + genome(99, 9), "NA", None]
    one = reads.one_strand(frame(spark, [("t", s) for s in texts] + [("c", texts[0])], "sample string, seq string"))
    packs = [bytes(r["pack"]) for r in one.collect()]
    assert len(packs) == 10 and sorted(map(len, packs)) == [26] * 8 + [101] * 2
    both = {(r["sample"], r["seq"]) for r in reads.expanded(one).collect()}
    assert both == {("t", y) for s in texts[:8] for y in (s, rc(s))} | {("t", texts[8]), ("t", rc(texts[8])[:-1] + "N")} | {("c", texts[0]), ("c", rc(texts[0]))}
    wins = frame(spark, [(1, "w", texts[0]), (1, "w", texts[0]), (1, "m", rc(texts[1])), (2, "w", genome(100, 77))], "id int, tag string, seq string")
    hits = verify.window_hits(wins, ["id"], one, {"t": "t", "c": "c"})
    assert sorted((r["id"], r["tag"]) for r in hits.collect()) == [(1, "cw"), (1, "cw"), (1, "tm"), (1, "tw"), (1, "tw")]


def test_no_chunk_goes_to_python_with_a_read(spark):
    """The piece of a chunk that a read is compared with is cut before; the rows that wait for Python hold no chunk."""
    chunks = reference.ref_chunks(frame(spark, [("1", genome(5000, 5))], "chr string, seq string"))
    one = reads.one_strand(frame(spark, [("t", genome(100, 6))], "sample string, seq string"))
    plan = align.unlike(one, reference.ref20_unique(chunks), chunks, "t")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, x in enumerate(lines) if "ArrowEvalPython [same_bases" in x]
    assert len(at) == 1 and "_seq" not in lines[at[0]]
    assert lines[at[0] + 1].strip(" +-:").startswith("Generate explode(array(struct(there")


def test_unique_20mers_of_one_strand_are_those_of_both(spark):
    """One row stands for both strands; palindromes, which occur on both, are never unique. Alignment by them loses and adds nothing."""
    text = genome(6000, 21)
    other = genome(300, 22) + "ACGTACGTAC" + rc("ACGTACGTAC") + genome(300, 23) + text[100:150] + rc(text[700:760]) + "N" + genome(80, 24)
    chunks = reference.ref_chunks(frame(spark, [("1", text), ("2", other)], "chr string, seq string"))
    counts, places = collections.Counter(), {}
    for name, s in (("1", text), ("2", other)):
        for i in range(len(s) - 19):
            for word, pos, way in ((s[i : i + 20], i + 1, "f"), (rc(s[i : i + 20]), i + 20, "r")):
                if "N" not in word:
                    counts[word] += 1
                    places[word] = (name, pos, way)
    wanted = {w: places[w] for w, n in counts.items() if n == 1}
    least = reference.ref20_least(chunks)
    got = {r["kmer"]: (r["chr"], r["pos"], r["dir"]) for r in seq.with_text(reference.ref20_unique(chunks), "code", "kmer").collect()}
    assert got == wanted and least.count() * 2 == len(wanted)
    odd = [text[40:90] + "R" + text[91:140], "ACR", text[4000:4050] + rc(text[4000:4050])]
    texts = [text[i : i + 50] + text[i + 50].translate(TURN) + text[i + 51 : i + 100] for i in range(0, 5000, 97)] + [text[i : i + 50] + rc(other[i : i + 50]) for i in range(0, 500, 41)] + odd
    one = reads.one_strand(frame(spark, [("t", s) for s in texts] + [("t", rc(s)) for s in texts[:9]], "sample string, seq string"))
    rows = lambda ref20: sorted(map(tuple, align.aligned(one, ref20, chunks, "t").collect()))
    both = reads.expanded(one)
    plain = align.with_head(align.seed_pairs(align.head_seeds(both, least, "t"), least), chunks).select(*align.aligned(one, least, chunks, "t").columns)
    assert rows(least) == rows(reference.ref20_unique(chunks)) == sorted(map(tuple, plain.collect())) and len(rows(least)) > 100
    keys = re.findall(r"SortMergeJoin \[(code#\d+L?|tail#\d+L?)\]", align.aligned(one, least, chunks, "t")._jdf.queryExecution().executedPlan().toString())
    assert len(keys) == 3, "the 20-mers are dealt by code alone, once for all joins"


def test_pivot_and_join_of_reads_are_those_of_counted_kmers(spark):
    rng = random.Random(12)
    half = "".join(rng.choice("ACGT") for _ in range(30))
    base = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = [base[i : i + 60] for i in range(0, 140, 7)] + [rc(base[i : i + 60]) for i in range(0, 140, 11)] + [half + rc(half), base[:25] + "R" + base[26:70], half[:10] + rc(half[:10]) + "C", base[:20], "A" * 40, "ACGT" * 9]
    one = reads.one_strand(frame(spark, [(s, q) for s in "tcx" for q in seqs[ord(s) % 3 :: 2]], "sample string, seq string"))
    pivot = kmer.last_base_pivot(kmer.kmer_count(one))
    found = kmer.pivot_of_reads(one)
    assert found.columns == pivot.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, pivot.collect()))
    joined, wanted = kmer.join_of_reads(one, "t", "c"), kmer.kmer_join(pivot, "t", "c")
    rows = sorted(map(tuple, joined.collect()))
    assert joined.columns == wanted.columns and rows and rows == sorted(map(tuple, wanted.collect()))


def test_last_bases_move_once_and_meet_without_a_join(spark):
    run = Run(spark, "/root/testdata/sf0.001")
    reads_plan, lbc, joined = (df._jdf.queryExecution().executedPlan().toString() for df in (run.one, run.lbc, run.joined))
    deals = lambda plan: len(re.findall(r"\bExchange hashpartitioning", plan))
    assert deals(lbc) - deals(reads_plan) == 2 and deals(joined) - deals(reads_plan) == 2
    assert joined.count("SortMergeJoin") == reads_plan.count("SortMergeJoin")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ACGTNR", max_size=40), min_size=1, max_size=8), st.integers(1, 12))
def test_names_of_windows_tell_texts_of_either_strand(texts, size):
    texts = texts + [rc(t) for t in texts if set(t) <= set("ACGT")]
    least = lambda w: min(w, rc(w)) if set(w) <= set("ACGT") else None
    found = seq.named_windows(pa.array(texts), size).to_pylist()
    assert [len(x) for x in found] == [max(0, len(t) - size + 1) for t in texts]
    seen = {(least(t[i : i + size]), name) for t, names in zip(texts, found) for i, name in enumerate(names) if least(t[i : i + size])}
    assert len(seen) == len({a for a, _ in seen}) == len({b for _, b in seen})
    whole = seq.named_windows(pa.array(texts)).to_pylist()
    assert [x[0] for x, t in zip(whole, texts) if t] == [seq.named_windows(pa.array([t]), len(t)).to_pylist()[0][0] for t in texts if t]


def test_long_reads_by_name_have_all_alignments_and_hits(spark):
    text = genome(6000, 11)
    rng = random.Random(3)
    changed = "".join(rng.choice("ACGTR") if rng.random() < 0.004 else b for b in text)
    starts = range(0, 5700, 40)
    mine = [changed[i : i + 300] if k % 2 else rc(changed[i : i + 300].replace("R", "A")) for k, i in enumerate(starts)] + [text[700:1000], changed[900:1050] + changed[3000:3150], changed[:30]]
    rows = [("t", s) for s in mine] + [("c", text[i : i + 300]) for i in range(0, 5700, 30)] + [("c", mine[0]), ("t", mine[0]), ("x", mine[4])]
    chunks = reference.ref_chunks(frame(spark, [("1", text)], "chr string, seq string"))
    table, least = frame(spark, rows, "sample string, seq string"), reference.ref20_least(chunks)
    one, named = reads.one_strand(table), reads.named(table, ["t", "c"])
    old, new = align.aligned(one, least, chunks, "t", 300), align.aligned_by_name(named, least, chunks, 1, 300)
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.select(*old.columns).collect()))
    support = [align.snp_support(align.align_snps(x)) for x in (old, new)]
    assert len({tuple(sorted(map(tuple, s.collect()))) for s in support}) == 1
    got = [verify.snp_genotypes(support[0], chunks, one, "t", "c", 300, 300), verify.snp_genotypes_by_name(support[1], chunks, named, 300)]
    a, b = (sorted(map(tuple, g.collect())) for g in got)
    assert a == b and len(a) > 10


def test_long_reads_do_not_travel_with_their_seeds(spark):
    plan = Run(spark, "/root/testdata/sf0.001", 600).bi_snp._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and re.search(r"code#\d+L? = _code#|tail#\d+L? = _code#", line)]
    assert joins
    rows = plan.splitlines()
    for line in joins:
        below = rows[rows.index(line) + 1]
        assert "pack" not in below and "seq" not in below, below


def test_copy_numbers_of_places_are_those_of_counted_kmers(spark):
    rng = random.Random(9)
    text = genome(9000, 12) + "N" + genome(60, 13) + genome(9000, 12)[4000:4300] + "ACGT" * 12
    odd = genome(40, 14) + "R" + genome(59, 15)
    texts = {"1": text, "X": genome(500, 16) + odd.replace("R", "A") + rc(text[200:260])}
    chunks = reference.ref_chunks(frame(spark, list(texts.items()), "chr string, seq string"))
    place = lambda n: rng.randrange(len(text) - n)
    mine = [(s, text[i : i + 100]) for s in "tttccx" for i in (place(100) for _ in range(150))]
    mine = [(s, q if rng.random() < 0.5 or "N" in q else rc(q)) for s, q in mine] + [("t", odd), ("c", odd), ("t", text[4090:4110] + rc(text[4090:4110])), ("t", text[50:69]), ("c", "ACGT" * 20), ("t", texts["X"][480:560])]
    one = reads.one_strand(frame(spark, mine, "sample string, seq string"))
    want = kmer.cnv_counts(kmer.kmer_count(one), reference.ref20_unique(chunks), "t", "c")
    least = kmer.cnv_counts(kmer.kmer_count(one), reference.ref20_least(chunks), "t", "c")
    got = kmer.cnv_spread(kmer.cnv_places(one, chunks, "t", "c"))
    rows = lambda df: sorted(map(tuple, df.select("chr", "pos", "dir", "target_cnt", "control_cnt").collect()))
    assert rows(got) == rows(want) == rows(least) and len(rows(want)) > 9000


def test_copy_numbers_move_as_runs(spark):
    plan = PLANS["cnv_counts"](Run(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("core" in keys for keys in dealt) and not any("code" in keys or "run" in keys for keys in dealt)


def test_ranks_of_chromosomes_with_large_and_negative_numbers(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["-300000", "-7", "0", "3", "262144", "262145", "999999999", "99999999999", "X"]), rng.choice([0, 5, 1 << 40, (1 << 44) + rng.randrange(3)]), rng.choice("fr"), i, 0) for i in range(400)]
    got = kmer.cnv_sorted(frame(spark, rows, "chr string, pos long, dir string, target_cnt long, control_cnt long").repartition(3)).collect()
    number = lambda c: int(c) if re.fullmatch(r"-?[0-9]+", c) and abs(int(c)) < 1 << 31 else 0
    key = lambda r: (number(r[0]), r[1], r[0], r[2])
    assert [key(r) for r in sorted(got, key=lambda r: r["place"])] == sorted(map(key, rows))


def test_edges_are_looked_up_in_20mers_of_one_strand(spark):
    text = genome(6000, 21)
    changed = "".join(b.translate(str.maketrans("ACGT", "CGTA")) if i % 300 == 150 else b for i, b in enumerate(text))
    rows = [(s, q[i : i + 80] if i % 4 else rc(q[i : i + 80])) for s, q in (("c", text), ("t", changed)) for i in range(0, 5900, 7)]
    chunks = reference.ref_chunks(frame(spark, [("1", text)], "chr string, seq string"))
    edges = kmer.kmer_edges(kmer.join_of_reads(reads.one_strand(frame(spark, rows, "sample string, seq string")), "t", "c"))
    one, both = (kmer.kmer_map(edges, t) for t in (reference.ref20_least(chunks), reference.ref20_unique(chunks)))
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, both.collect())) and len(got) > 20
    at, base = one.columns.index("pos"), one.columns.index("ref_base")
    assert all(text[r[at] - 1] == r[base] for r in got)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 9, 20, 100, 101]), min_size=8, max_size=8), min_size=1, max_size=40))
def test_edge_rule_by_brute_force(spark, counts):
    def rule(c, t):
        allele = lambda x: 3 <= x <= 100
        a, b = ([allele(x) for x in side] for side in (c, t))
        gone, come = (sum(allele(x) and y <= 1 for x, y in zip(p, q)) for p, q in ((c, t), (t, c)))
        few = lambda side: sum(x <= 1 for x in side)
        if a == b or not any(a) or not any(b) or max(c + t) > 100 or few(c) < 2 or few(t) < 2 or 1 not in (gone, come):
            return None
        one, two = ("".join(n for n, x in zip("ACGT", side) if 4 * x > sum(side)) for side in (c, t))
        return (one, two) if one != two else None

    df = frame(spark, [(i, *c) for i, c in enumerate(counts)], "prefix19 long, ca long, cc long, cg long, ct long, ta long, tc long, tg long, tt long")
    want = {i: found for i, c in enumerate(counts) if (found := rule(c[:4], c[4:]))}
    assert {r["prefix19"]: (r["cont"], r["alt"]) for r in kmer.kmer_edges(df).collect()} == want


def test_mapped_edges_are_made_once_and_the_genome_is_not_dealt_by_prefixes(spark):
    dealt = lambda name: re.findall(r"Exchange hashpartitioning\(([^)]*)\)", PLANS[name](Run(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString())
    assert len([keys for keys in dealt("kmer_map") if "prefix19" in keys]) == 1
    assert not [keys for name in ("kmer_genotypes", "vcf_kmer") for keys in dealt(name) if "prefix19" in keys]
