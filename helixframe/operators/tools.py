"""Tools beside the methods: genotype matrices over several targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.seq import chr_key

SNP_KEY = ["chr", "pos", "ref", "alt"]
SV_KEY = ["hchr", "hpos", "tchr", "tpos", "type", "size"]


def genotype_matrix(tables: dict[str, DataFrame], keys: list[str] = SNP_KEY) -> DataFrame:
    """keys and a genotype column per target, W where a target lacks the variant; primers of the last target that has them."""
    primers = [c for c in ("left", "right", "length", "context") if all(c in t.columns for t in tables.values())]
    rows = None
    for i, (name, table) in enumerate(tables.items()):
        one = table.select(*keys, F.lit(name).alias("_target"), F.lit(i).alias("_i"), "genotype", *primers)
        rows = one if rows is None else rows.unionByName(one)
    genotypes = [F.coalesce(F.max(F.when(F.col("_target") == n, F.col("genotype"))), F.lit("W")).alias(n) for n in tables]
    last = [F.max_by(F.col(p), F.col("_i")).alias(p) for p in primers]
    return rows.groupBy(*keys).agg(*last, *genotypes).orderBy(chr_key(F.col(keys[0])), keys[1])
