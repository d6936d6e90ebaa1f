"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

from helixframe.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["ref20_unique", "kmer_map", "cnv_counts", "snp_genotypes", "sv_genotypes", "vcf_full", "auto_clip", "genotype_matrix", "sv_genotype_matrix", "rearranged_genotypes", "alignment_records", "primer_pairs", "long_read_snp_genotypes"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("part", "orders", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found: sorted(map(str, map(tuple, found)))
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_entry_has_rows(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.oracle_sql()) <= set(queries.queries())
