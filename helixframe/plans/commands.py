"""Commands over stored results: genotypes of several runs side by side, lengths of reads, alignments at a place.

    python -m helixframe.plans.commands compare runs=FOLDER FOLDER,type=snp,out=FOLDER
    python -m helixframe.plans.commands lengths reads=FOLDER,out=FOLDER
    python -m helixframe.plans.commands search run=FOLDER,chr=1,pos=200
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import chr_key
from helixframe.operators import align, reads, tools
from helixframe.sources import files


def table(spark: SparkSession, run: str, *names: str) -> DataFrame:
    """The first of the tables that the last run in a folder has."""
    known = dict(r[0].split("\t") for r in spark.read.text(f"{run.rstrip('/')}/tables.current").collect())
    return spark.read.parquet(next(known[n] for n in names if n in known))


def compare(spark: SparkSession, runs: str, out: str, type: str = "snp") -> str:
    """Genotypes of the runs (folders, separated by spaces; named by their last part) as columns of one table, with the primers if the runs have them."""
    kind, keys = ("sv", tools.SV_KEY) if type == "sv" else ("bi_snp", tools.SNP_KEY)
    targets = {run.rstrip("/").rsplit("/", 1)[-1]: table(spark, run, f"{kind}_primers", kind) for run in runs.split()}
    matrix = tools.genotype_matrix(targets, keys)
    files.write_lines(matrix, out, matrix.columns, [chr_key(F.col(keys[0])), *keys[1:]], ["\t".join(matrix.columns)])
    return out


def lengths(spark: SparkSession, reads_: str, out: str) -> str:
    """Length, count and percentage of reads at least so long, longest first."""
    found = reads.length_histogram(files.read_fastq(spark, reads_, "reads")).drop("sample")
    files.write_lines(found, out, found.columns, [F.desc("length")], ["\t".join(found.columns)])
    return out


def search(spark: SparkSession, run: str, chr: str, pos: int) -> list[str]:
    """Alignment records at a place, in order of their text."""
    rows = align.search_alignment(spark.read.parquet(f"{run.rstrip('/')}/aln.search"), chr, int(pos))
    return [r["line"] for r in rows.orderBy("line").collect()]  # what is printed: the reads over one place


def main(command: str, text: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    found = dict(pair.split("=", 1) for pair in text.split(",") if pair)
    if command == "lengths":
        print(lengths(spark, found["reads"], found["out"]))
    elif command == "compare":
        print(compare(spark, **found))
    elif command == "search":
        print("\n\n".join(search(spark, **found)))
    else:
        raise ValueError("the commands are compare, lengths and search")


if __name__ == "__main__":
    import sys

    main(*sys.argv[1:3])
