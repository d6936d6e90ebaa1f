"""Fill-in-the-middle, document fingerprints and vector codes against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fill_middle, fingerprints, vector_codes

DOCS = "doc_id long, text string, source string, n long, range string, output int"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 3, "r", 1) for i, t in rows], DOCS).repartition(3)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


ODD = [(1, words(50, 1)), (1, words(50, 1)), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all"), (5, words(60_000, 5)), (6, words(50, 1)), (7, "é" * 300 + " ünïcode \U0001f600 " + words(40, 7)), (8, "a <P> b"), (9, "x<S"), (10, "<<M>"), (-3, "\U0001f600" * 700)]


# --- fill-in-the-middle


def halves(doc_id, text):
    """n, form, prefix, middle and output by the rule, on code points."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_brute_force(spark):
    rng = random.Random(4)
    rows = ODD + [(i, "".join(rng.choice(["a", "é", "漢", "🙂", "<", "P", "S", "M", ">", "\n"]) for _ in range(rng.randrange(900)))) for i in range(100, 400)]
    formed = fill_middle.fill_in_middle(documents(spark, rows))
    assert formed.columns == ["doc_id", "text", "source", "range", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(str, formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()))
    fields = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(fields, (i, *halves(i, t)), strict=True)) + ")" for i, t in rows)
    assert got == want
    digest = {(r["doc_id"], r["restored_sha256"]) for r in fill_middle.digest(formed).collect()}
    assert digest == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {r["form"] for r in formed.select("form").collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    assert fill_middle.digest(fill_middle.fill_in_middle(documents(spark, ODD).where("false"))).count() == 0


def test_lines_as_units(spark):
    text = "one\ntwo\n\nthree"
    row = fill_middle.fill_in_middle(documents(spark, [(i, text) for i in range(60)]), unit="line", rate=100, spm_rate=0).collect()
    cuts = set()
    for r in row:
        prefix, suffix = r["output"].split("<S>")[0].removeprefix("<P>"), r["output"].split("<S>")[1].split("<M>")[0]
        lines = text.splitlines(keepends=True)
        assert r["n"] == 4 and prefix == "".join(lines[: r["prefix_chars"]]) and suffix == "".join(lines[r["prefix_chars"] + r["middle_chars"] :])
        cuts.add(r["prefix_chars"])
    assert len(cuts) > 2


@pytest.mark.parametrize("lane, block", [(3, 1), (4, 50), (7, 1 << 20), (256, 1 << 20)])
def test_lanes_agree_with_one_scan(monkeypatch, lane, block):
    monkeypatch.setattr(fill_middle, "LANE", lane)
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(lane)
    raw = [bytes(rng.choice([60, 80, 62, 0xC3, 0xA9, 0xF0, 0x9F, 0x99, 0x82, 0x80, 65]) for _ in range(rng.randrange(40))) for _ in range(200)]
    automaton = fill_middle.machine(("<P>", "<S>", "<M>"))
    got = fill_middle.cuts(pa.array(raw, pa.binary())[0:], np.arange(200) * 7, np.arange(200) * 13, automaton).to_pylist()
    for k, (data, row) in enumerate(zip(raw, got, strict=True)):
        starts, due, hits = [], 0, sum(data[i : i + 3] in (b"<P>", b"<S>", b"<M>") for i in range(len(data)))
        for i, byte in enumerate(data):
            if due and 0x80 <= byte < 0xC0:
                due -= 1
            else:
                starts.append(i)
                due = {0xC3: 1, 0xF0: 3}.get(byte, 0)
        n = len(starts)
        a, b = sorted((k * 7 % (n + 1), k * 13 % (n + 1)))
        at = [*starts, len(data)]
        assert row == {"n": n, "hits": hits, "first": a, "second": b, "first_bytes": at[a], "second_bytes": at[b]}


def test_sentinels_that_could_be_misread():
    for bad in [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c"), ("a", "xay", "c")]:
        with pytest.raises(ValueError):
            fill_middle._checked(bad)


# --- document fingerprints


def kept_runs(text, hash_of, k=fingerprints.K, window=fingerprints.WINDOW):
    """(hash, place) of the kept runs, one window after the other."""
    units = []
    for w in [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]:
        units += list(w) if len(w) > fingerprints.LONG else [w]
    grams = [tuple(units[i : i + k]) for i in range(len(units) - k + 1)] or ([tuple(units)] if units else [])
    hashes = [hash_of(g) for g in grams]
    kept = []
    for j in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[j : j + window]
        at = j + max(i for i, h in enumerate(part) if h == min(part))
        if (hashes[at], at) not in kept[-1:]:
            kept.append((hashes[at], at))
    return kept


@pytest.fixture(scope="module")
def gram_hash(spark):
    """Spark's hash of a run of units, and of runs shorter than K."""
    known = {}

    def learn(grams):
        new = sorted({g for g in grams if g not in known})
        for part in (new[i : i + 5000] for i in range(0, len(new), 5000)):
            df = spark.createDataFrame([(list(g),) for g in part], "g array<string>").withColumn("h", F.transform("g", lambda w: F.xxhash64(w)))
            five = F.xxhash64(*[F.get("h", F.lit(i)) for i in range(fingerprints.K)])
            for r in df.select("g", F.when(F.size("g") == fingerprints.K, five).otherwise(F.xxhash64("h")).alias("x")).collect():
                known[tuple(r["g"])] = r["x"]

    return known, learn


def test_fingerprints_by_brute_force(spark, gram_hash):
    known, learn = gram_hash
    rng = random.Random(8)
    texts = ["", " ", "one", "a b c d", "a b c d e", "x " * 40, "y" * 90, "漢字" * 40 + " tail of it", words(12, 3), words(13, 4), "  nbsp"] + [words(rng.randrange(90), i, 6) for i in range(40)]
    found = fingerprints.with_fingerprint(spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "i int, text string, words string"), "text", "hashes", "places").collect()
    grams = []
    for t in texts:
        kept_runs(t, lambda g: grams.append(g) or 0)
    learn(grams)
    for r in found:
        assert list(zip(r["hashes"], r["places"], strict=True)) == kept_runs(texts[r["i"]], known.__getitem__), texts[r["i"]]
        assert r["words"] == "w"


def test_every_shared_run_is_kept_in_both(spark):
    rng = random.Random(2)
    length = fingerprints.K + fingerprints.WINDOW - 1
    rows = []
    for i in range(60):
        shared, before, after = words(length, 1000 + i), [words(rng.randrange(30), 2000 + 4 * i + j) for j in range(2)], [words(rng.randrange(30), 5000 + 4 * i + j) for j in range(2)]
        rows.append((i, *[" ".join(filter(None, (before[j], shared, after[j]))) for j in range(2)], *[len(before[j].split()) for j in range(2)]))
    df = spark.createDataFrame(rows, "i int, a string, b string, na int, nb int")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "ha", "pa"), "b", "hb", "pb")
    for r in df.collect():
        own = {(h, p - r["na"]) for h, p in zip(r["ha"], r["pa"], strict=True)}
        other = {(h, p - r["nb"]) for h, p in zip(r["hb"], r["pb"], strict=True)}
        assert any(0 <= p <= length - fingerprints.K for _, p in own & other), r["i"]


@pytest.mark.parametrize("many", [False, True])
def test_fingerprints_of_documents_and_their_edits(spark, gram_hash, many):
    known, learn = gram_hash
    rows = ODD if not many else [(3 * i - 50, words(30 + i % 50, i % 90)) for i in range(300)]
    out = fingerprints.fingerprinted(documents(spark, rows))
    assert out.columns[:5] == ["doc_id", "text", "source", "n", "range"]
    got = fingerprints.digest(out).collect()
    key = {r["text"]: r["k"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]]))
    pairs = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        pairs.append((i, t, t[: len(t) - half] + u[:half], u))
    grams = []
    for p in pairs:
        for t in p[1:]:
            kept_runs(t, lambda g: grams.append(g) or 0)
    learn(grams)
    runs = lambda t: [h for h, _ in kept_runs(t, known.__getitem__)]
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    text = lambda hs: "".join(f"{h % (1 << 64):016x}" for h in hs)
    want = []
    for i, t, e, u in pairs:
        a, b, c = runs(t), runs(e), runs(u)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), near(a, b), near(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprints_of_one_and_of_no_document(spark):
    one = fingerprints.digest(fingerprints.fingerprinted(documents(spark, [(5, "a b c d e f g h")]))).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d"[:7]).hexdigest()
    assert fingerprints.digest(fingerprints.fingerprinted(documents(spark, [(5, "a")]).where("false"))).count() == 0


def test_rows_move_once_and_no_python_runs(spark):
    plan = fingerprints.digest(fingerprints.fingerprinted(documents(spark, ODD)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# --- vector codes


def codes_by_brute_force(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}, None
    dims = -(-max(1, max(len(r[1]) for r in kept)) // parts) * parts
    q = [[min(max(int(np.floor(256 * x)), -(1 << 28)), 1 << 28) for x in r[1]] + [0] * (dims - len(r[1])) for r in kept]
    w = dims // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for v in q[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(part(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for p in range(parts)] for v in q]
        for p in range(parts):
            books[p] = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [part(v, p) for v, f in zip(q, found, strict=True) if f[p] == i]) else e for i, e in enumerate(books[p])]
    out, errors = [], {}
    for r, v in zip(kept, q, strict=True):
        best = [near(v, p) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), r[2]))
        errors[r[2]] = errors.get(r[2], 0) + out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(map(str, [(i, c, e, errors[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out])), books


VECTORS = "vec_id long, embedding array<double>, label int, code string, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("n, dims", [(300, 64), (40, 32), (200, 21), (1, 16)])
def test_codes_by_brute_force(spark, n, dims):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, 0.02), 0.0, 0.25, -1e-9]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 2, [None] * dims, 2), (n + 3, [float("inf")] * dims, 2), (5, rows[0][1], 1), (None, rows[0][1][:7], None), (n + 4, [], 3), (n + 5, [1e30, -1e30], 3)] if n > 1 else []
    codes, books = vector_codes.compress(vectors(spark, rows))
    want, want_books = codes_by_brute_force(rows)
    assert sorted(map(str, map(tuple, vector_codes.digest(codes, books).collect()))) == want
    assert books.tolist() == want_books


def test_nearest_is_the_lowest_of_equals():
    rng = np.random.default_rng(1)
    for _ in range(40):
        entries, x = rng.integers(-3, 4, (64, 4)), rng.integers(-4, 5, (500, 4))
        entry, distance = vector_codes.Tree(entries).nearest(x)
        want = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == want.argmin(1)).all() and (distance == want.min(1)).all()
    same = vector_codes.Tree(np.ones((64, 4), np.int64))
    assert (same.nearest(np.zeros((3, 4), np.int64))[0] == 0).all()


def test_no_vectors_at_all(spark):
    assert vector_codes.digest(*vector_codes.compress(vectors(spark, [(1, None, 2), (2, [float("nan")], None)]))).count() == 0


def test_codes_stand_for_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).round(3).tolist(), 0) for i in range(500)]
    codes, books = vector_codes.compress(vectors(spark, rows))
    for r in codes.collect():
        apart = np.floor(np.array(rows[r["vec_id"]][1]) * 256) - vector_codes.decoded(np.array([r["codes"]]), books)[0] * 256
        assert round((apart**2).sum()) == r["error"]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_vector_codes"])
def test_new_queries_match_sql(spark, name):
    import os

    from helixframe.llm import queries

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
