"""DuckDB SQL of the registered queries: common table expressions, each query with those that it needs."""

from __future__ import annotations

import re

from helixframe.plans.fixtures import LENGTH, fixture_sql, rearranged_sql, second_sql

_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
_rc = _RC.format

CTES = {
    "ru": f"SELECT DISTINCT sample, s AS seq FROM (SELECT sample, unnest([seq, {_rc('seq')}]) AS s FROM reads WHERE seq NOT LIKE '%N%') x",
    # Overlapping pieces of the genome, so no base's row carries a chromosome.
    "ch": "SELECT chr, k, substr(seq, k * 1000 + 1, 2200) AS s FROM (SELECT chr, seq, unnest(range(0, (length(seq) - 1) // 1000 + 1)) AS k FROM ref) x",
    "rk0": "SELECT chr, k * 1000 + i AS o, substr(s, i + 1, 20) AS w FROM (SELECT chr, k, s, unnest(range(0, least(1000, length(s) - 19))) AS i FROM ch WHERE length(s) >= 20) x",
    "rk": f"SELECT w AS kmer, chr, o + 1 AS pos, 'f' AS dir FROM rk0 WHERE w NOT LIKE '%N%' UNION ALL SELECT {_rc('w')}, chr, o + 20, 'r' FROM rk0 WHERE w NOT LIKE '%N%'",
    "r20": "SELECT kmer, min(chr) AS chr, min(pos) AS pos, min(dir) AS dir FROM rk GROUP BY kmer HAVING count(*) = 1",
    "kc": "SELECT sample, kmer, count(*) AS cnt FROM (SELECT sample, substr(seq, i, 20) AS kmer FROM (SELECT sample, seq, unnest(range(1, length(seq) - 18)) AS i FROM ru WHERE length(seq) >= 20) x) y WHERE kmer NOT LIKE '%N%' GROUP BY ALL",
    "lb": "SELECT sample, substr(kmer, 1, 19) AS prefix19, " + ", ".join(f"cast(coalesce(sum(cnt) FILTER (WHERE substr(kmer, 20, 1) = '{b}'), 0) AS bigint) AS {b.lower()}" for b in "ACGT") + " FROM kc GROUP BY ALL",
    "kj": "SELECT prefix19, x.a AS ca, x.c AS cc, x.g AS cg, x.t AS ct, y.a AS ta, y.c AS tc, y.g AS tg, y.t AS tt FROM (SELECT * FROM lb WHERE sample = 'control') x JOIN (SELECT * FROM lb WHERE sample = 'target') y USING (prefix19)",
    "ke0": "SELECT *, " + ", ".join(
        [" || ".join(f"CASE WHEN {p}{b} BETWEEN 3 AND 100 THEN '{b.upper()}' ELSE '' END" for b in "acgt") + f" AS {n}" for p, n in (("c", "aa"), ("t", "bb"))]
        + [" || ".join(f"CASE WHEN {p}{b} / ({p}a + {p}c + {p}g + {p}t) > 0.25 THEN '{b.upper()}' ELSE '' END" for b in "acgt") + f" AS {n}" for p, n in (("c", "cont"), ("t", "alt"))]
        + ["greatest(ca, cc, cg, ct, ta, tc, tg, tt) AS most"]
        + [" + ".join(f"({p}{b} <= 1)::int" for b in "acgt") + f" AS {n}" for p, n in (("c", "nohita"), ("t", "nohitb"))]
        + [" + ".join(f"({p}{b} BETWEEN 3 AND 100 AND {q}{b} <= 1)::int" for b in "acgt") + f" AS {n}" for p, q, n in (("c", "t", "pola"), ("t", "c", "polb"))]
    ) + " FROM kj WHERE ca + cc + cg + ct > 0 AND ta + tc + tg + tt > 0",
    "ke": "SELECT prefix19, cont, alt, ca, cc, cg, ct, ta, tc, tg, tt FROM ke0 WHERE aa <> bb AND aa <> '' AND bb <> '' AND most <= 100 AND nohita >= 2 AND nohitb >= 2 AND (pola = 1 OR polb = 1) AND cont <> alt",
    "km": f"""SELECT chr, CASE dir WHEN 'f' THEN pos + 19 ELSE pos - 19 END AS pos, CASE dir WHEN 'f' THEN prefix19 ELSE {_rc('prefix19')} END AS prefix19,
      CASE dir WHEN 'f' THEN cont ELSE {_rc('cont')} END AS ref_base, CASE dir WHEN 'f' THEN cont ELSE {_rc('cont')} END AS cont, CASE dir WHEN 'f' THEN alt ELSE {_rc('alt')} END AS alt, dir, """
    + ", ".join(f"CASE dir WHEN 'f' THEN {p}{b} ELSE {p}{o} END AS {p}{b}" for p in "ct" for b, o in zip("acgt", "tgca", strict=True))
    + " FROM ke JOIN r20 ON substr(kmer, 1, 19) = prefix19 AND substr(kmer, 20, 1) = cont WHERE length(cont) = 1",
    "hs": "SELECT seq, m, chr AS hchr, pos AS head_pos FROM (SELECT seq, unnest([0, 5, 10, 15]) AS m FROM ru WHERE sample = 'target' AND length(seq) >= 35) x JOIN r20 ON kmer = substr(seq, m + 1, 20) AND dir = 'f'",
    "sp": "SELECT seq, m, hchr, head_pos, chr AS tchr, pos AS tail_pos, dir AS tail_dir FROM hs JOIN r20 ON kmer = substr(seq, length(seq) - 19 - m, 20)",
    "hd": """SELECT * FROM (SELECT sp.*, head_pos - 1 - m AS o, length(seq) AS n, substr(s, head_pos - 1 - m - k * 1000 + 1, length(seq)) AS head FROM sp JOIN ch ON chr = hchr AND k = (head_pos - 1 - m) // 1000 WHERE head_pos - 1 - m >= 0) x
      WHERE length(head) = n AND head <> seq""",
    "co": "SELECT *, coalesce(hchr = tchr AND tail_dir = 'f' AND tail_pos - head_pos = n - 20 - 2 * m, false) AS straight FROM hd",
    "sn0": "SELECT *, list_filter(range(m, n - m), lambda i: substr(seq, i + 1, 1) <> substr(head, i + 1, 1)) AS mm FROM co WHERE straight",
    "sn": "SELECT seq, m, hchr AS chr, head_pos + i - m AS pos, substr(head, i + 1, 1) AS ref, substr(seq, i + 1, 1) AS alt FROM (SELECT *, unnest(mm) AS i FROM sn0 WHERE len(mm) BETWEEN 1 AND 5) x",
    "su": "SELECT chr, pos, ref, alt, count(DISTINCT seq) AS cnt FROM sn GROUP BY ALL",
    "su2": "SELECT *, cnt >= 16 AS strong, sum((cnt >= 16)::int) OVER (PARTITION BY chr ORDER BY pos, ref, alt) AS q FROM su",
    "li": """SELECT a.chr, a.pos, a.ref, a.alt, list({'p': b.pos, 'a': b.alt} ORDER BY b.pos, b.ref, b.alt) FILTER (WHERE b.pos IS NOT NULL) AS linked
      FROM su2 a LEFT JOIN su2 b ON b.strong AND b.chr = a.chr AND b.pos < a.pos AND b.pos >= a.pos - 98 AND b.q > a.q - 10 GROUP BY a.chr, a.pos, a.ref, a.alt""",
    "ww": """SELECT * FROM (SELECT li.*, substr(s, pos - 100 - k * 1000 + 1, 199) AS wild FROM li JOIN ch ON ch.chr = li.chr AND k = (pos - 100) // 1000 WHERE pos >= 100) x WHERE length(wild) = 199""",
    "mu": """SELECT *, coalesce(list_reduce(list_concat([{'p': cast(0 AS bigint), 'a': substr(wild, 1, 99) || alt || substr(wild, 101)}], linked),
      lambda x, y: {'p': cast(0 AS bigint), 'a': substr(x.a, 1, cast(y.p - (pos - 100) - 1 AS bigint)) || y.a || substr(x.a, cast(y.p - (pos - 100) + 1 AS bigint))}).a, substr(wild, 1, 99) || alt || substr(wild, 101)) AS mutant FROM ww""",
    "pr0": "SELECT chr, pos, ref, alt, tag, substr(s, i, 100) AS seq FROM (SELECT chr, pos, ref, alt, tag, s, unnest(range(1, length(s) - 98)) AS i FROM (SELECT chr, pos, ref, alt, 'w' AS tag, wild AS s FROM mu UNION ALL SELECT chr, pos, ref, alt, 'm', mutant FROM mu) x) y",
    "pr": "SELECT 'target' AS sample, seq, chr, pos, ref, alt, 't' || tag AS tag FROM pr0 UNION ALL SELECT 'control', seq, chr, pos, ref, alt, 'c' || tag FROM pr0",
    "ph": "SELECT pr.* FROM pr SEMI JOIN ru USING (sample, seq)",
    "gt0": "SELECT chr, pos, ref, alt, " + ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t}" for t in ("cw", "cm", "tw", "tm")) + " FROM ph GROUP BY ALL",
    "gt": "SELECT *, CASE WHEN cw >= 5 AND cm <= 1 THEN CASE WHEN tm >= 5 AND tw <= 1 THEN 'M' WHEN 10 * tm > 3 * (tm + tw) AND 10 * tm < 7 * (tm + tw) AND tw >= 5 THEN 'H' ELSE 'R' END ELSE 'N' END AS genotype FROM gt0 WHERE pos >= 100",
    # Structural variants
    "sv0": """SELECT *, CASE tail_dir WHEN 'f' THEN tail_pos - n + 19 + m ELSE tail_pos - 20 - m END AS t0 FROM co WHERE NOT straight""",
    "sv1": f"""SELECT * FROM (SELECT sv0.*, CASE tail_dir WHEN 'f' THEN substr(s, t0 - k * 1000 + 1, n) ELSE {_rc('substr(s, t0 - k * 1000 + 1, n)')} END AS tail FROM sv0 JOIN ch ON chr = tchr AND k = t0 // 1000 WHERE t0 >= 0) x
      WHERE length(tail) = n AND instr(head, 'N') = 0 AND instr(tail, 'N') = 0""",
    "sv2": """SELECT *, list_transform(range(1, n + 1), lambda i: (substr(seq, i, 1) <> substr(head, i, 1))::int) AS hm, list_transform(range(1, n + 1), lambda i: (substr(seq, i, 1) <> substr(tail, i, 1))::int) AS tm FROM sv1""",
    "sv3": """SELECT *, list_filter(range(10, n), lambda i: hm[i + 1] = 1 AND coalesce(hm[i + 2], 1) + coalesce(hm[i + 3], 1) + coalesce(hm[i + 4], 1) + coalesce(hm[i + 5], 1) + coalesce(hm[i + 6], 1) >= 2)[1] AS hi,
      list_filter(range(n - 10, 0, -1), lambda i: tm[i + 1] = 1 AND tm[(i - 1 + n) % n + 1] + tm[(i - 2 + n) % n + 1] + tm[(i - 3 + n) % n + 1] + tm[(i - 4 + n) % n + 1] + tm[(i - 5 + n) % n + 1] >= 2)[1] AS ti FROM sv2""",
    "sv4": "SELECT *, n - 20 - (tail_pos - head_pos) - 2 * m AS sz, hchr = tchr AND tail_dir = 'f' AS indel FROM sv3 WHERE hi > m + 26 AND ti < n - 25 - m AND list_sum(hm[1:hi]) = 0",
    "ev": """SELECT seq, m, hchr, head_pos + hi - m AS hpos, tchr, CASE tail_dir WHEN 'f' THEN tail_pos - n + ti + 20 + m ELSE tail_pos + n - ti - 20 - m END AS tpos, tail_dir AS dir,
      CASE WHEN indel THEN CASE WHEN sz > 0 THEN 'insertion' ELSE 'deletion' END WHEN hchr = tchr THEN 'inversion' ELSE 'translocation' END AS type, CASE WHEN indel THEN sz END AS size, cast(hi AS int) AS hi, cast(ti AS int) AS ti FROM sv4""",
    "rp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hchr, hpos, tchr, tpos ORDER BY dir, type, coalesce(cast(size AS varchar), ''), hi DESC, seq, ti) AS rn FROM ev) x WHERE rn = 1""",
    "rq": """SELECT *, abs(ti - hi) AS d, CASE WHEN hi <= ti THEN substr(seq, hi + 1, abs(ti - hi) + 1) ELSE substr(seq, ti + 2, abs(ti - hi) - 1) END AS inside,
      CASE WHEN hi = ti THEN 99 ELSE 100 - abs(ti - hi) END AS part, CASE WHEN hi < ti THEN hpos - 101 + abs(ti - hi) ELSE hpos - 100 END AS h0,
      CASE WHEN dir = 'f' THEN CASE WHEN hi <= ti THEN tpos ELSE tpos + abs(ti - hi) - 1 END WHEN hi < ti THEN tpos - 101 + abs(ti - hi) ELSE tpos - 100 END AS t0,
      CASE WHEN hi > ti THEN hpos - 100 - abs(ti - hi) ELSE hpos - 100 END AS w0 FROM rp""",
    "rs": f"""SELECT rq.*, substr(a.s, h0 - a.k * 1000 + 1, part) AS hp, CASE dir WHEN 'f' THEN substr(b.s, t0 - b.k * 1000 + 1, part) ELSE {_rc('substr(b.s, t0 - b.k * 1000 + 1, part)')} END AS tp, substr(c.s, w0 - c.k * 1000 + 1, 199) AS wild
      FROM rq JOIN ch a ON a.chr = hchr AND a.k = h0 // 1000 JOIN ch b ON b.chr = tchr AND b.k = t0 // 1000 JOIN ch c ON c.chr = hchr AND c.k = w0 // 1000 WHERE part >= 0 AND h0 >= 0 AND t0 >= 0 AND w0 >= 0""",
    "rt": "SELECT *, hp || inside || tp AS mutant FROM rs WHERE length(hp) = part AND length(tp) = part AND length(wild) = 199",
    "vp": """SELECT sample, hchr, hpos, tchr, tpos, dir, type, size, inside, tag, substr(s, i, 100) AS seq FROM (
      SELECT *, unnest(range(1, length(s) - 98)) AS i FROM (
        SELECT z.sample, z.p || 'w' AS tag, wild AS s, hchr, hpos, tchr, tpos, dir, type, size, inside FROM rt, (VALUES ('target', 't'), ('control', 'c')) z(sample, p)
        UNION ALL SELECT z.sample, z.p || 'm', mutant, hchr, hpos, tchr, tpos, dir, type, size, inside FROM rt, (VALUES ('target', 't'), ('control', 'c')) z(sample, p)) x) y""",
    "vh": "SELECT vp.* FROM vp SEMI JOIN ru USING (sample, seq)",
    "vg0": "SELECT hchr, hpos, tchr, tpos, dir, type, size, inside, " + ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t}" for t in ("cw", "cm", "tw", "tm")) + " FROM vh GROUP BY ALL",
    "vg": "SELECT *, CASE WHEN cw >= 5 AND cm <= 1 THEN CASE WHEN tm >= 5 AND tw <= 1 THEN 'M' WHEN 10 * tm > 3 * (tm + tw) AND 10 * tm < 7 * (tm + tw) AND tw >= 5 THEN 'H' ELSE 'R' END ELSE 'N' END AS genotype FROM vg0 WHERE hpos >= 100",
    "un": "SELECT sample, id, substr(seq, 1, CASE WHEN id % 10 = 0 THEN 80 WHEN id % 10 < 4 THEN 90 ELSE 100 END) AS seq FROM reads",
    "lh": "SELECT sample, length, count, cast(floor(100 * sum(count) OVER (PARTITION BY sample ORDER BY length DESC) / sum(count) OVER (PARTITION BY sample)) AS bigint) AS percent FROM (SELECT sample, length(seq) AS length, count(*) AS count FROM un WHERE seq NOT LIKE '%N%' GROUP BY ALL) x",
    "rg": "SELECT * FROM (SELECT gt.chr, pos, ref, alt, substr(s, pos - 250 - k * 1000 + 1, 500) AS region FROM gt JOIN ch ON ch.chr = gt.chr AND k = (pos - 250) // 1000 WHERE pos >= 250 AND genotype IN ('H', 'M')) x WHERE length(region) = 500",
}

# The k-mer method verifies the same way, from its own candidates with a support of 25.
_KMER = {"su": "ksu", "su2": "ksu2", "li": "kli", "ww": "kww", "mu": "kmu", "pr0": "kpr0", "pr": "kpr", "ph": "kph", "gt0": "kgt0", "gt": "kgt"}
CTES["ksu"] = "SELECT DISTINCT chr, pos, cont AS ref, CASE WHEN instr(alt, cont) > 0 THEN substr(alt, 1, instr(alt, cont) - 1) || substr(alt, instr(alt, cont) + 1) ELSE alt END AS alt, cast(25 AS bigint) AS cnt FROM km"
for _old, _new in list(_KMER.items())[1:]:
    CTES[_new] = re.sub(r"\b(FROM|JOIN|SELECT) (" + "|".join(_KMER) + r")\b", lambda m: f"{m[1]} {_KMER[m[2]]}", re.sub(r"\b(li|pr)\.", lambda m: f"{_KMER[m[1]]}.", CTES[_old]))
CTES["kg"] = "SELECT km.*, cw, cm, tw, tm, genotype FROM km JOIN kgt ON km.chr = kgt.chr AND km.pos = kgt.pos WHERE km.pos >= 100"

_CHROM = "CASE WHEN length({0}) <= 3 OR regexp_full_match({0}, '[0-9]+') THEN 'chr' || {0} ELSE {0} END"
_plain = "regexp_replace(regexp_replace(printf('%.3f', {0}), '0+$', ''), '\\.$', '')".format
_cut = "cast(trunc(({0}) * 1000) AS bigint) / 1000".format
_qual = "CASE WHEN pow(({0}) * 0.001, {1}) = 0 THEN 1000.0 ELSE cast(trunc(-10 * ({1}) * log10(({0}) * 0.001) * 1000) AS bigint) / 1000 END".format


def _vcf(source: str, chr_: str, pos: str, ref: str, alt: str, info: str, dp_info: str) -> str:
    return f"""SELECT {_CHROM.format(chr_)} AS chrom, {pos} AS pos, '.' AS id, {ref} AS ref, {alt} AS alt, {_qual('tw + tm', 'tm')} AS qual, '.' AS filter,
      {info} || 'GT=' || CASE genotype WHEN 'M' THEN '1/1' ELSE '0/1' END || ';AF=' || {_plain(_cut('tm / (tw + tm)'))} || ';DP=' || ({dp_info}) AS info,
      'GT:AD:DP' AS format, CASE genotype WHEN 'M' THEN '1/1' ELSE '0/1' END || ':' || tw || ',' || tm || ':' || (tw + tm) AS sample FROM {source} WHERE tw + tm > 0 AND genotype IN ('M', 'H')"""


CTES["va"] = _vcf("gt", "chr", "pos", "ref", "alt", "''", "tw + tm") + " AND tm > 2"
CTES["vi"] = """SELECT hchr, hpos, tchr, tpos, type, size, CASE WHEN length(substr(seq, hi, size + 1)) >= size THEN substr(seq, hi, size + 1) END AS ins
  FROM (SELECT *, row_number() OVER (PARTITION BY hchr, hpos, tchr, tpos, size ORDER BY dir, hi DESC, seq, ti) AS own FROM ev WHERE type = 'insertion') x WHERE own = 1"""
CTES["vs0"] = "SELECT vg.*, ins, type = 'deletion' AND size > -80 AS short FROM vg LEFT JOIN vi USING (hchr, hpos, tchr, tpos, type, size)"
CTES["vs1"] = "SELECT vs0.*, substr(s, hpos - 2 - k * 1000 + 1, CASE WHEN short THEN abs(size) + 1 ELSE 1 END) AS bases FROM vs0 JOIN ch ON chr = hchr AND k = (hpos - 2) // 1000"
CTES["vs"] = "SELECT * FROM (" + _vcf(
    "vs1", "hchr", "hpos - 1", "bases",
    "CASE WHEN short THEN substr(bases, 1, 1) WHEN type = 'deletion' THEN '<DEL>' WHEN type = 'insertion' THEN coalesce(ins, '<INS>') WHEN type = 'inversion' THEN '<INV>' ELSE substr(bases, 1, 1) || ']' || tchr || ':' || tpos END",
    """CASE type WHEN 'deletion' THEN 'SVTYPE=DEL;END=' || (tpos + 1) || ';' || CASE WHEN length(inside) > 0 THEN 'HOMLEN=' || length(inside) || ';HOMSEQ=' || inside || ';' ELSE '' END || 'SVLEN=' || size || ';'
       WHEN 'insertion' THEN 'SVTYPE=INS;END=' || (tpos + 1) || ';SVLEN=' || size || ';' WHEN 'inversion' THEN 'SVTYPE=INV;END=' || tpos || ';' ELSE 'SVTYPE=BND;' END""",
    "tw + tm") + " AND tm > 2) x WHERE ref <> alt"
CTES["ss"] = "SELECT hchr, hpos, tchr, tpos, dir, type, size, count(DISTINCT seq) AS cnt FROM ev GROUP BY ALL"
CTES["cs"] = "SELECT min(cnt) AS lim, max(most) AS most FROM (SELECT cnt, cume_dist() OVER (ORDER BY cnt) AS cd, max(cnt) OVER () AS most FROM ss) x WHERE cd >= 0.999"
CTES["cv"] = """SELECT * FROM (SELECT ss.*, lim, most, type = 'deletion' AND size > -80 AS short, substr(s, hpos - 2 - k * 1000 + 1, CASE WHEN type = 'deletion' AND size > -80 THEN abs(size) + 1 ELSE 1 END) AS bases
  FROM ss JOIN cs ON cnt >= lim JOIN ch ON chr = hchr AND k = (hpos - 2) // 1000 WHERE hpos >= 2) x LEFT JOIN vi USING (hchr, hpos, tchr, tpos, type, size)"""
CTES["cl"] = "SELECT min(cnt) AS lim, max(most) AS most FROM (SELECT cnt, cume_dist() OVER (ORDER BY cnt) AS cd, max(cnt) OVER () AS most FROM su) x WHERE cd >= 0.999"


# Alignment records: SNPs by read, structural variants by event and read.
_bars = "array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr({0}, i, 1) THEN '|' ELSE ' ' END), '')".format
CTES["rcs"] = f"""SELECT DISTINCT hchr AS chr, list_transform(mm, lambda i: head_pos + i - m) AS places,
  array_to_string(list_transform(mm, lambda i: '# ' || hchr || ' ' || (head_pos + i - m) || ' snp ' || substr(head, i + 1, 1) || ' ' || substr(seq, i + 1, 1)), chr(10)) || chr(10) || head || chr(10) || {_bars('head')} || chr(10) || seq AS line
  FROM sn0 WHERE len(mm) BETWEEN 1 AND 5"""
CTES["rcv0"] = """SELECT *, head_pos + hi - m AS hpos, CASE tail_dir WHEN 'f' THEN tail_pos - n + ti + 20 + m ELSE tail_pos + n - ti - 20 - m END AS tpos,
  CASE WHEN indel THEN CASE WHEN sz > 0 THEN 'insertion' ELSE 'deletion' END WHEN hchr = tchr THEN 'inversion' ELSE 'translocation' END AS type, CASE WHEN indel THEN sz END AS size FROM sv4"""
CTES["rcv"] = f"""SELECT DISTINCT hchr AS chr, [hpos] AS places, '# ' || hchr || ' ' || hpos || ' ' || tchr || ' ' || tpos || ' ' || tail_dir || ' ' || type || ' ' || coalesce(cast(size AS varchar), '')
  || chr(10) || head || chr(10) || {_bars('head')} || chr(10) || seq || chr(10) || {_bars('tail')} || chr(10) || tail AS line FROM rcv0"""
CTES["rc"] = "SELECT chr, cast(unnest(places) AS bigint) AS pos, line FROM (SELECT * FROM rcs UNION ALL SELECT * FROM rcv) x"

# Primers: pairs in order, those that are shorter than all before, at most the third of them.
_dimer = "len(list_filter(range(3, 20), lambda i: len(list_filter(range(1, i + 1), lambda j: substr(l, 20 - i + j, 1) = substr(r, j, 1))) >= i - 1)) > 0"


def _best(source: str, keys: str, length: str) -> dict[str, str]:
    """SQL of the best pair of primers: ``source`` has keys, v (its number), hd and tl (both halves)."""
    strong = "len(regexp_replace(w, '[AT]', '', 'g')) = 11"
    side = lambda half, order: f"SELECT v, i, w, row_number() OVER (PARTITION BY v ORDER BY {order}) AS o FROM (SELECT v, i, substr({half}, i + 1, 20) AS w FROM (SELECT v, {half}, unnest(range(0, 230)) AS i FROM {source}) x) y WHERE {strong}"
    return {
        f"{source}l": side("hd", "i DESC"),
        f"{source}r": side("tl", "i"),
        f"{source}p": f"SELECT s.*, a.w AS l, b.w AS r, a.o AS oa, b.o AS ob, {length} AS span FROM {source} s JOIN {source}l a ON a.v = s.v JOIN {source}r b ON b.v = s.v",
        f"{source}q": f"SELECT *, min(span) OVER (PARTITION BY v ORDER BY oa, ob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM {source}p WHERE span >= 70 AND NOT ({_dimer})",
        f"{source}b": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY span) AS last FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY oa, ob) AS rec FROM {source}q WHERE least IS NULL OR span < least) x WHERE rec <= 3) y WHERE last = 1",
        f"{source}o": f"SELECT {', '.join('s.' + k for k in keys.split(', '))}, coalesce(b.l, 'N') AS \"left\", coalesce({_rc('b.r')}, 'N') AS \"right\", coalesce(cast(b.span AS varchar), 'N') AS length, CASE WHEN b.v IS NULL THEN 'N' ELSE s.context END AS context FROM {source} s LEFT JOIN {source}b b ON b.v = s.v",
    }


CTES["ps"] = """SELECT row_number() OVER () AS v, *, substr(region, 1, 250) AS hd, substr(region, 251) AS tl, substr(region, 100, 150) || '[' || alt || '/' || ref || ']' || substr(region, 251, 149) AS context
  FROM (SELECT gt.*, substr(s, pos - 250 - k * 1000 + 1, 500) AS region FROM gt JOIN ch ON ch.chr = gt.chr AND k = (pos - 250) // 1000 WHERE pos >= 250 AND genotype IN ('H', 'M')) x WHERE length(region) = 500"""
CTES |= _best("ps", "chr, pos, ref, alt, cw, cm, tw, tm, genotype", "250 - (instr(region, a.w) - 1) + (instr(region, b.w) - 1 - 250) + 20")
CTES["pv0"] = """SELECT *, CASE WHEN type IN ('insertion', 'deletion') THEN least(hpos, tpos) ELSE hpos END AS a, CASE WHEN type IN ('insertion', 'deletion') THEN greatest(hpos, tpos) ELSE tpos END AS b FROM vg WHERE genotype IN ('H', 'M')"""
CTES["pv"] = f"""SELECT row_number() OVER () AS v, *, substr(hd, 230, 20) || ' ' || substr(tl, 1, 20) AS context FROM (
  SELECT pv0.*, substr(c.s, a - 250 - c.k * 1000 + 1, 250) AS hd, CASE type WHEN 'inversion' THEN {_rc('substr(d.s, b - d.k * 1000 + 1, 250)')} ELSE substr(d.s, b - d.k * 1000 + 1, 250) END AS tl
  FROM pv0 JOIN ch c ON c.chr = hchr AND c.k = (a - 250) // 1000 JOIN ch d ON d.chr = tchr AND d.k = b // 1000 WHERE a >= 250 AND b >= 0) x WHERE length(hd) = 250 AND length(tl) = 250"""
CTES |= _best("pv", "hchr, hpos, tchr, tpos, dir, type, size, inside, cw, cm, tw, tm, genotype", "250 - (instr(hd, a.w) - 1) + (instr(tl, b.w) - 1) + coalesce(length(inside), 0)")

_NAMED = r"\b(FROM|JOIN|SELECT) ({0})\b"


def _uses(name: str, found: set[str]) -> bool:
    return any(re.search(rf"\b(FROM|JOIN) {other}\b|, {other}\b", CTES[name]) for other in found)


def _variant(suffix: str, reads: str | None, **numbers: str) -> None:
    """The expressions again, with ``suffix``, over other reads (their SQL) or with other numbers in place of a read's length."""
    found, base = {"reads"}, list(CTES)
    while new := {n for n in base if n not in found and _uses(n, found)}:
        found |= new
    if reads:
        CTES[f"reads{suffix}"] = reads
    else:
        found -= {"reads"}
    own = "|".join(sorted(found, key=len, reverse=True))
    for n in base:
        if n in found:
            text = re.sub(rf"\b(FROM|JOIN|SELECT) ({own})\b(?!\.)", rf"\1 \2{suffix}", CTES[n])
            text = re.sub(rf"(?<![\w.'])({own})\.(?=[\w*])", rf"\1{suffix}.", text)
            for old, other in numbers.items():
                text = re.sub(rf"\b{old[1:]}\b", other, text) if n in ("li", "ww", "mu", "pr0", "gt") else text
            CTES[n + suffix] = text


_BASE = dict(CTES)
_variant("_2", second_sql())
_SECOND = dict(CTES)
CTES.clear()
CTES.update(_BASE)
_variant("_3", f"SELECT * FROM reads UNION ALL {rearranged_sql()}")
CTES.update(_SECOND)
LONG = 600
_FULL = dict(CTES)
CTES.clear()
CTES.update(_BASE)
_variant("_l", None, n98=str(LONG - 2), n99=str(LONG - 1), n100=str(LONG), n101=str(LONG + 1), n199=str(2 * LONG - 1))
CTES.update(_FULL)


def _with(select: str, length: int = LENGTH) -> str:
    """The select behind the fixture and every expression that it needs, in order of definition."""
    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN) {name}\b|, {name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    order: list[str] = []

    def place(name: str) -> None:
        for other in CTES:
            if other in needed and other != name and other not in order and re.search(rf"\b(FROM|JOIN) {other}\b", CTES[name]):
                place(other)
        if name not in order:
            order.append(name)

    for name in CTES:
        if name in needed:
            place(name)
    return fixture_sql(length) + "".join(f",\n{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + select


_SELECTS = {
    "reads_uniq": "SELECT sample, seq FROM ru",
    "kmer_count": "SELECT sample, kmer, cnt FROM kc",
    "ref_kmers": "SELECT kmer, chr, pos, dir FROM rk",
    "ref20_unique": "SELECT kmer, chr, pos, dir FROM r20",
    "ref_control_reads": f"SELECT DISTINCT 'ref' AS sample, unnest([w, {_rc('w')}]) AS seq FROM (SELECT substr(s, i + 1, 100) AS w FROM (SELECT s, unnest(range(0, least(1000, length(s) - 99), 2)) AS i FROM ch WHERE length(s) >= 100) x) y WHERE w NOT LIKE '%N%'",
    "last_base_pivot": "SELECT sample, prefix19, a, c, g, t FROM lb",
    "kmer_join": "SELECT * FROM kj",
    "kmer_edges": "SELECT * FROM ke",
    "kmer_map": "SELECT * FROM km",
    "cnv_counts": "SELECT chr, pos, dir, cast(coalesce(t.cnt, 0) AS bigint) AS target_cnt, cast(coalesce(c.cnt, 0) AS bigint) AS control_cnt FROM (SELECT kmer, cnt FROM kc WHERE sample = 'target') t FULL JOIN (SELECT kmer, cnt FROM kc WHERE sample = 'control') c USING (kmer) JOIN r20 USING (kmer)",
    "head_seed_map": "SELECT seq, m, hchr, head_pos FROM hs",
    "seed_pairs": "SELECT seq, m, hchr, head_pos, tchr, tail_pos, tail_dir FROM sp",
    "align_snps": "SELECT seq, m, chr, pos, ref, alt FROM sn",
    "snp_read_support": "SELECT chr, pos, ref, alt, cnt FROM su",
    "snp_probes": "SELECT sample, seq, chr, pos, ref, alt, tag FROM pr WHERE sample = 'target'",
    "snp_probe_hits": "SELECT sample, seq, chr, pos, ref, alt, tag FROM ph WHERE sample = 'target'",
    "snp_genotypes": "SELECT chr, pos, ref, alt, cw, cm, tw, tm, genotype FROM gt",
    "sv_junctions": "SELECT seq, m, hchr, hpos, tchr, tpos, dir, type, size, hi, ti FROM ev",
    "sv_read_support": "SELECT hchr, hpos, tchr, tpos, dir, type, size, count(DISTINCT seq) AS cnt FROM ev GROUP BY ALL",
    "sv_genotypes": "SELECT hchr, hpos, tchr, tpos, dir, type, size, inside, cw, cm, tw, tm, genotype FROM vg",
    "kmer_genotypes": "SELECT * FROM kg",
    "vcf_snp": "SELECT * FROM va",
    "vcf_kmer": "SELECT DISTINCT * FROM (" + _vcf("kg", "chr", "pos", "cont", "alt", "''", "tm") + ") x",
    "vcf_sv": "SELECT * FROM vs",
    "vcf_full": "SELECT * FROM va UNION ALL SELECT * FROM vs",
    "vcf_count": f"""SELECT {_CHROM.format('chr')} AS chrom, pos, '.' AS id, ref, alt, {_qual('cnt', 'cnt')} AS qual, '.' AS filter,
      'GT=' || CASE WHEN {_cut('cnt / most')} < 1 THEN '0/1' ELSE '1/1' END || ';AF=' || {_plain(_cut('cnt / most'))} || ';DP=' || cnt AS info, 'GT:DP' AS format,
      CASE WHEN {_cut('cnt / most')} < 1 THEN '0/1' ELSE '1/1' END || ':' || cnt AS sample FROM su, cl WHERE cnt >= lim""",
    "vcf_count_sv": f"""SELECT * FROM (SELECT {_CHROM.format('hchr')} AS chrom, hpos - 1 AS pos, '.' AS id, bases AS ref,
      CASE WHEN short THEN substr(bases, 1, 1) WHEN type = 'deletion' THEN '<DEL>' WHEN type = 'insertion' THEN coalesce(ins, '<INS>') WHEN type = 'inversion' THEN '<INV>' ELSE substr(bases, 1, 1) || ']' || tchr || ':' || tpos END AS alt,
      {_qual('cnt', 'cnt')} AS qual, '.' AS filter,
      CASE type WHEN 'deletion' THEN 'SVTYPE=DEL;END=' || (tpos + 1) || ';SVLEN=' || size || ';' WHEN 'insertion' THEN 'SVTYPE=INS;END=' || (tpos + 1) || ';SVLEN=' || size || ';' WHEN 'inversion' THEN 'SVTYPE=INV;END=' || tpos || ';' ELSE 'SVTYPE=BND;' END
      || 'GT=' || CASE WHEN {_cut('cnt / most')} < 1 THEN '0/1' ELSE '1/1' END || ';AF=' || {_plain(_cut('cnt / most'))} || ';DP=' || cnt AS info, 'GT:DP' AS format,
      CASE WHEN {_cut('cnt / most')} < 1 THEN '0/1' ELSE '1/1' END || ':' || cnt AS sample FROM cv) y WHERE ref <> alt""",
    "search_alignment_sv": "SELECT DISTINCT chr, pos, line FROM rc WHERE chr = '1' AND pos = 2000 AND line NOT LIKE '% snp %'",
    "alignment_records": "SELECT chr, pos, line FROM rc",
    "rearranged_junctions": "SELECT seq, m, hchr, hpos, tchr, tpos, dir, type, size, hi, ti FROM ev_3",
    "rearranged_genotypes": "SELECT hchr, hpos, tchr, tpos, dir, type, size, inside, cw, cm, tw, tm, genotype FROM vg_3",
    "rearranged_vcf": "SELECT * FROM vs_3",
    "long_read_snp_genotypes": "SELECT chr, pos, ref, alt, cw, cm, tw, tm, genotype FROM gt_l",
    "primer_pairs": "SELECT * FROM pso",
    "sv_primer_pairs": "SELECT * FROM pvo",
    "sv_genotype_matrix": """SELECT hchr, hpos, tchr, tpos, type, size, coalesce(max(a), 'W') AS t1, coalesce(max(b), 'W') AS t2
      FROM (SELECT hchr, hpos, tchr, tpos, type, size, genotype AS a, NULL AS b FROM vg_3 UNION ALL SELECT hchr, hpos, tchr, tpos, type, size, NULL, genotype FROM vg_2) x GROUP BY ALL""",
    "cnv_sorted": "SELECT chr, pos, dir, target_cnt, control_cnt, row_number() OVER (ORDER BY coalesce(try_cast(chr AS int), 0), pos, chr, dir) AS place FROM (SELECT chr, pos, dir, cast(coalesce(t.cnt, 0) AS bigint) AS target_cnt, cast(coalesce(c.cnt, 0) AS bigint) AS control_cnt FROM (SELECT kmer, cnt FROM kc WHERE sample = 'target') t FULL JOIN (SELECT kmer, cnt FROM kc WHERE sample = 'control') c USING (kmer) JOIN r20 USING (kmer)) z",
    "clip_reads": "SELECT sample, id, substr(seq, k * 30 + 1, 30) AS seq FROM (SELECT sample, id, seq, unnest(range(0, length(seq) // 30)) AS k FROM reads WHERE seq NOT LIKE '%N%' AND length(seq) >= 30) x",
    "auto_clip": "SELECT sample, cast(CASE WHEN count(*) > 1 THEN CASE WHEN max(length) FILTER (WHERE percent >= 90) > 200 THEN floor(max(length) FILTER (WHERE percent >= 90) / floor(max(length) FILTER (WHERE percent >= 90) / 100)) ELSE greatest(75, max(length) FILTER (WHERE percent >= 90)) END END AS bigint) AS clip FROM lh GROUP BY sample",
    "length_histogram": "SELECT sample, length, count, percent FROM lh",
    "search_alignment": "SELECT DISTINCT chr, pos, line FROM rc WHERE chr = '1' AND pos = 200 AND line LIKE '% snp %'",
    "genotype_matrix": """SELECT chr, pos, ref, alt, coalesce(max(a), 'W') AS t1, coalesce(max(b), 'W') AS t2
      FROM (SELECT chr, pos, ref, alt, genotype AS a, NULL AS b FROM gt UNION ALL SELECT chr, pos, ref, alt, NULL, genotype FROM gt_2) x GROUP BY ALL""",
    "primer_candidates": f"SELECT chr, pos, ref, alt, CASE WHEN i < 230 THEN 'left' ELSE 'right' END AS side, i, CASE WHEN i < 230 THEN w ELSE {_rc('w')} END AS primer FROM (SELECT chr, pos, ref, alt, i, substr(region, i + 1, 20) AS w FROM (SELECT *, unnest(list_concat(range(0, 230), range(250, 480))) AS i FROM rg) x) y WHERE length(regexp_replace(w, '[AT]', '', 'g')) = 11",
}

ORACLES = {name: _with(select, LONG if name.startswith("long_read") else LENGTH) for name, select in _SELECTS.items()}
