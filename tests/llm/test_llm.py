import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ann, chat, common, decontaminate, graph, line_dedup, near_copies, packing, quality, simhash, suffix_dedup, token_files, url_filter
from helixframe.llm.common import tokenizer_path
from helixframe.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, bucket string, n_lines long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, 3, "b", 7) for i, t in rows], DOCS).repartition(3)


ODD = [(1, words(50, 1)), (1, words(50, 1)), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all"), (5, words(6000, 5)), (6, words(50, 1)), (7, "é" * 300 + " ünïcode \U0001f600 " + words(40, 7))]


# --- tokens, packing, files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    own = Encoder(tokenizer_path(name))
    rng = random.Random(3)
    alphabet = ["a", "B", "s", "t", "re", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "23", "é", "É", "e\u0301", "İ", "Σ", "!", "...", "\u00a0", "\u2003", "漢", "🙂", "<|endoftext|>", "<|StartOfText|>", "½", "\x1c", "\x85"]
    texts = ["", None, " ", "'", "x's", "'s 's", "don't  'll"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    ids, counts = own.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_plan_fills_like_best_fit():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 101) for _ in range(3000)] + [100] * 50
    patterns = packing.plan(dict(Counter(lengths)), 100)
    assert Counter(x for content, n in patterns for x in content for _ in range(n)) == Counter(lengths)
    assert all(sum(content) <= 100 for content, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.02 * sum(lengths) / 100 + 1
    assert packing.plan({}, 100) == []


def test_packing_is_gapless_and_complete(spark):
    rows = packing.best_fit_pack(documents(spark, ODD), capacity=64).collect()
    tok = Encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    want = Counter()
    for doc_id, text in ODD:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        head, at, piece = len(ids) % 64, 0, 0
        for size in [head] * (head > 0) + [64] * (len(ids) // 64):
            want[doc_id, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, piece = at + size, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_pack(documents(spark, [])).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    index = token_files.PerfectHash.build(keys)
    assert sorted(index.lookup(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("shard_ids", [1 << 23, 64])
def test_token_files_round_trip(spark, shard_ids):
    rows_in = ODD + [(-(2**63), "least id"), (2**63 - 1, "largest id")] + [(1, words(30, 40 + i)) for i in range(6)]
    docs = documents(spark, rows_in)
    manifest = token_files.write_token_files(docs, ranges=3, shard_ids=shard_ids)
    assert shard_ids > 64 or manifest.count() > 3
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    tok = Encoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    encoded = Counter()
    for doc_id, text in rows_in:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        encoded[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == encoded
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    named = [r.doc_id for r in rows if r.doc_id is not None]
    assert named == sorted(named) and rows[0].doc_id is None
    asked = spark.createDataFrame([(1,), (5,), (99,), (None,), (-(2**63),), (2**63 - 1,)], "doc_id long")
    got = token_files.lookup_documents(manifest, asked).collect()
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows_in if i in (1, 5, -(2**63), 2**63 - 1))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert token_files.read_token_files(token_files.write_token_files(documents(spark, []))).count() == 0


def test_lookups_read_a_few_bytes(spark, tmp_path):
    keys = np.arange(0, 300_000, 3)
    token_files.write_shard(str(tmp_path / "s"), keys, np.full(len(keys), 2), np.arange(2 * len(keys)) % 60_000, 60_000)
    with token_files.Shard(str(tmp_path / "s")) as shard:
        read, plain = [], shard.part

        def counted(*x):
            read.append(x[2] if len(x) > 2 else 10**9)
            return plain(*x)

        shard.part = counted
        for key in (0, 299_997, 3 * 777):
            assert [x.tolist() for x in shard.get(key)] == [[2 * key // 3 % 60_000, (2 * key // 3 + 1) % 60_000]]
        assert shard.get(1) == [] and sum(read) < 200


# --- decontamination


def hits_by_brute_force(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = find(text)
        if item is not None and w:
            n = min(len(w), 10)
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = find(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination_by_brute_force(spark):
    passage = words(30, 100)
    items = [(1, passage), (2, "short ITEM é"), (3, words(10, 101)), (None, words(20, 102)), (4, ""), (5, None), (10, "short item É"), (6, words(12, 103, 2)), (7, "one")] + [(100 + i, f"{words(5, i)} {passage} {words(5, 50 + i)}") for i in range(12)]
    docs = ODD + [(20, words(40, 8) + " " + passage.upper() + "! " + words(9, 9)), (21, " ".join(passage.split()[5:15])), (22, " ".join(passage.split()[5:14])), (23, "a short, item. é b"), (24, words(400, 104, 2)), (25, words(10, 101)), (26, "one " * 40)]
    got = decontaminate.contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == hits_by_brute_force(docs, items)
    assert decontaminate.contamination(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, ODD), empty).where("contaminated").count() == 0


def test_decontamination_of_a_long_text_that_is_an_item(spark):
    import time

    def seconds(n):
        text = words(n, n, 10**6)
        began = time.time()
        row = decontaminate.contamination(spark.createDataFrame([(1, text), (2, "clean")], "doc_id long, text string"), spark.createDataFrame([(7, text)], "item_id long, text string")).where("doc_id = 1").first()
        assert row.n_words == row.n_hit == n and row.n_items == 1
        return time.time() - began

    seconds(1000)
    one, four = seconds(15_000), seconds(60_000)
    assert four < 5 * one + 10


# --- nearest neighbours


def exact_neighbours(ids, vectors, q, k=20):
    score = (vectors * vectors[q]).sum(axis=1)
    score[q] = -np.inf
    return np.lexsort((ids, -score))[:k], score


def recall(got, ids, vectors, queries):
    share = []
    for q in queries:
        want, score = exact_neighbours(ids, vectors, q)
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(want) + 1))
        assert (np.diff(own["score"]) <= 0).all()
        np.testing.assert_allclose(own["score"], score[np.searchsorted(ids, own.vec_id)], atol=1e-9)
        share.append(np.isin(own.vec_id, ids[want]).mean())
    return np.mean(share)


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 16))
    base[300:360] = base[20]  # more copies than neighbours asked for
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(base)]
    odd = [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [1.0] * 15 + [float("inf")], 0), (9080, [1.0] * 15 + [None], 0), (None, [1.0] * 16, 0), (9100, [], 0), (9120, [1.0] * 3, 0)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")).toPandas()
    exact, ids = base.astype(np.float32).astype(float), np.arange(1500)
    assert recall(got, ids, exact, range(0, 1500, 20)) >= 0.9 and set(got.query_id) == set(range(0, 1500, 20))
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == exact_neighbours(ids, exact, 20)[0].tolist()
    few = ann.nearest_neighbours(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank int"))
    assert few.count() == 2
    again = ann.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, again)) == [(0, 1, 3, 1.0), (0, 1, 3, 2.0), (0, 2, 0, 0.5), (0, 2, 0, 0.5)]
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_varying_lengths_and_beside_a_huge_cluster(spark):
    rng = np.random.default_rng(6)
    free = rng.normal(size=(1000, 16)) * rng.lognormal(0, 1, size=(1000, 1))
    cluster = rng.normal(size=16) * 3 + rng.normal(size=(2000, 16)) * 0.05
    vectors = np.concatenate([free, cluster]).astype(np.float32)
    got = ann.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).toPandas()
    assert recall(got, np.arange(3000), vectors.astype(float), range(0, 3000, 20)) >= 0.9


# --- chat


def test_neighbours_of_doubles_are_scored_as_given(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base * (1 + i * 1e-12)).tolist()) for i in range(60)]
    found = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.array([v for _, v in rows])
    for q in (0, 20, 40):
        own = [r for r in found if r.query_id == q]
        want = sorted(((float((x[i] * x[q]).sum()), -i) for i in range(60) if i != q), reverse=True)[:20]
        assert [(r.score, -r.vec_id) for r in sorted(own, key=lambda r: r["rank"])] == want


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "<|sep|>\\<[INST]</s>"), (1, 2, "assistant", "ok <s> \\"), (1, 3, "assistant", ""), (1, 4, "we|>ird<|role:x|>", "z"), (1, None, None, None),
        (2, 0, "assistant", "x" * 100_000 + "<" * 1000), (3, 0, "user", "é\n\U0001f600"), (3, 0, "user", "é\n\U0001f600"), (None, 5, "assistant", "null id"),
    ] + [(4, i, "user" if i % 3 else "assistant", f"turn {i}") for i in range(200)] + [(5, 7, "assistant", f"\U0001f600<{i}" * 9) for i in range(700)] + [(6, i, "assistant", f"é[{i}]") for i in range(20_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(3)
    chats = chat.formatted(table)
    got = {r.conv_id: r for r in chat.parsed(chats).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    texts = {r.conv_id: r.formatted for r in chats.collect()}
    assert texts[1].count("<|sep|>") == 3  # one of them escaped
    assert chat.digest(chat.formatted(chat.with_probe(table.where("false")))).first().n_turns == 2


# --- URLs


def test_hosts_paths_and_rules(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y#z"), (2, "https://example.net"), (3, None), (4, "no scheme/net/"), (5, "x://ORG/fr/a"), (6, "http://badexample.net/en/"), (7, "http://example.com/de"), (8, "http://m.example.com/de/1#a/b"), (9, "http://h?u=http://b.net/"), (10, "a://b.net/c://d.org/fr/"), (1, "http://x.net/")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge(table)
    seen = Counter((r.page_id, r.host, r.path, r.rule) for r in got.collect())
    want = [(1, "a.example.net", "/en/x", "example.net/en/"), (2, "example.net", "", None), (3, "", "", None), (4, "", "", None), (5, "org", "/fr/a", "org/fr/"), (6, "badexample.net", "/en/", "net/"), (7, "example.com", "/de", None), (8, "m.example.com", "/de/1", "example.com/de/"), (9, "h", "", None), (10, "b.net", "/c://d.org/fr/", "net/"), (1, "x.net", "/", "net/")]
    assert seen == Counter(want)
    many = url_filter.RULES + [("block", f"h{i}.test", "/") for i in range(80)]
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(table, many).collect()) == seen
    assert url_filter.judge(table.where("false")).count() == 0


def url_features(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    found = re.search(r"\?([^#]*)", url)
    query, n, labels = found[1] if found else "", max(len(url), 1), host.split(".")
    share = [k / n for k in Counter(url).values()]
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), sum(c in "0123456789" for c in url) / n, sum("A" <= c <= "Z" for c in url) / n,
        sum(not (c.isascii() and c.isalnum()) for c in url) / n, -sum(x * np.log2(x) for x in share), query.count("&") + 1 if query else 0, len(query),
        host.count("-"), sum(c in "0123456789" for c in host), max(map(len, labels)), float("#" in url),
    ]


@pytest.mark.parametrize("n", [2, 64, 65])
def test_equally_long_rules_decide_alike_in_lists_of_any_length(spark, n):
    rules = [("block", "a.example.net", "/"), ("allow", "example.net", "/x/")] + [("block", f"h{i}.test", "/") for i in range(n - 2)]
    table = spark.createDataFrame([(1, "http://a.example.net/x/1"), (2, "http://b.example.net/x/1"), (3, "http://h1.test/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table, rules, spark.createDataFrame([], "url string, label int")).collect()}
    assert got == {1: ("a.example.net/", "block"), 2: ("example.net/x/", "allow"), 3: ("h1.test/" if n > 3 else None, "block" if n > 3 else "allow")}


def test_url_features_by_definition(spark):
    urls = ["HTTP://A-b.Example9.net/en/x1?y=1&z#top", "https://é.org", "no scheme", "", "x://h?u=http://b.net/", "https://a.b.c.d/e//f/?", "http://long.test/" + "aé9-" * 30_000, "http://u.test/a#b?c", None]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    found = {r.i: [r[c] for c in url_filter.FEATURES[:15]] for r in url_filter.with_features(url_filter.with_parts(table)).collect()}
    for i, u in enumerate(urls):
        assert found[i] == pytest.approx(url_features(u)), u


def test_odd_urls_pass_through_the_trees(spark):
    rows = [(i, f"http://{'bad-1' if i % 2 else 'good'}.s{i % 7}.test/{i}", i % 2) for i in range(200)]
    odd = [(1000, None), (1001, ""), (1002, "nothing"), (1003, "http://x.test/" + "é%" * 50_000), (1004, rows[1][1]), (1004, rows[1][1]), (None, "http://good.s1.test/")]
    got = url_filter.judge(spark.createDataFrame(odd, "page_id long, url string"), [], spark.createDataFrame([r[1:] for r in rows] + [(None, 1), ("http://n.test/", None)], "url string, label int")).collect()
    assert len(got) == 7 and {r.verdict for r in got} <= {"allow", "block"}
    assert [r.verdict for r in got if r.page_id == 1004] == ["block"] * 2


def test_labels_come_from_what_pages_show(spark):
    html = "<html><style>bad low</style><script>var x = 'low';</script><!-- low bad --><p>{}</p></html>".format
    docs = [(i, f"{'low bad junk' if i % 2 else 'fine good prose'} {words(30, i)}") for i in range(120)] + [(500, None), (None, "low"), (501, ""), (0, "fine good prose")]
    labels = [(i, 1 - i % 2) for i in range(120)] + [(500, 1), (None, 0), (7, 0), (501, None)]
    pages = [("a", html("good fine prose is all that stands here")), ("b", html("BAD low junk all over here")), ("c", html("")), ("d", None), (None, html("low bad junk")), ("b", html("bad low junk"))]
    table = spark.createDataFrame(pages, "url string, html string").withColumn("seen", F.lit("clash")).withColumn("label", F.lit(3))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert sorted(map(tuple, url_filter.taught_labels(table, documents(spark, docs), known).collect())) == [("a", 0), ("b", 1), ("b", 1)]
    for none in (known.where("quality = 1"), known.where("false")):
        assert url_filter.taught_labels(table, documents(spark, docs), none).count() == 0


def test_documents_to_learn_from_are_chosen_without_moving_texts(spark):
    rows = [(i, f"text {i % 7} {i}") for i in range(40)] + [(3, "text 3 3")] * 5 + [(5, None)]
    known = spark.createDataFrame([(i, float(i % 2)) for i in range(0, 40, 3)], "_id long, _quality double")
    docs = documents(spark, rows)
    plain = docs.join(known, F.col("doc_id") == F.col("_id")).where("text IS NOT NULL").orderBy(F.xxhash64("text"), "doc_id").select("text", "_quality")
    for most in (4, 9, 1000):
        found = url_filter.chosen_texts(docs, known, most)
        assert list(map(tuple, found.collect())) == list(map(tuple, plain.limit(most).collect()))
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        moved = [block for block in plan.split("\n\n") if "Exchange" in block.split("\n")[0] and "seen#" in block and "RoundRobin" not in block]
        assert not moved


def test_url_model_learns(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        bad = i % 4 == 0
        name = f"cheap-{rng.randrange(10**6)}-{rng.choice(['deal', 'win'])}" if bad else rng.choice(["news", "wiki", "blog", "docs"]) + rng.choice("abcdef")
        rows.append((i, f"http://{name}.test/{rng.randrange(100)}", int(bad)))
    table = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = url_filter.fit(table.select("url", "label"))
    area, n, ones = url_filter.held_out_quality(model, table.select("url", "label"))
    assert area >= 0.95 and 100 < n < 400 and ones < n
    found = model.score(url_filter.with_parts(table.where(url_filter.held_out(F.col("url")))))
    assert found.agg(F.avg((F.col("blocked").cast("int") == F.col("label")).cast("int"))).first()[0] >= 0.9


def test_url_suffixes_count_all_learned_rows_and_copies_fill_no_sample(spark):
    rows = [(f"http://h{i}.s{i % 40}.test/", int(i % 40 < 10)) for i in range(400)]
    first = spark.createDataFrame(rows, "url string, label int").where(~url_filter.held_out(F.col("url"))).orderBy(F.xxhash64("url")).first()
    many = rows + [tuple(first)] * 200
    model = url_filter.fit(spark.createDataFrame(many, "url string, label int"), train_rows=50)
    assert model.trees is not None
    learned = [(".".join(u.split("/")[2].split(".")[-2:]), y) for u, y in many if zlib.crc32(u.encode()) % 5]
    prior = np.mean([y for _, y in learned])
    for r in model.suffixes.where("kind = '2'").collect():
        own = [y for s, y in learned if s == r.suffix]
        assert own and r.rate == pytest.approx((sum(own) + 20 * prior) / (len(own) + 20))


# --- quality


def test_sum_of_squares_identity():
    machine = quality.FactorisationMachine()
    machine.factors = np.random.default_rng(0).normal(size=machine.factors.shape).astype(np.float32)
    index, value = quality.features(words(30, 1))
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) * value[a] * value[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    got, _ = machine.raw(index, value, np.array([0]))
    assert got[0] == pytest.approx(pairs, rel=1e-3)


def test_features_by_definition():
    text = "Good  words, GOOD 42!\nGood words\tüß\nGood words\tüß\n\n" + "x" * 9
    raw = text.encode()
    tokens, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, letters = len(raw), sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw)
    other = sum(b < 128 and not chr(b).isalnum() and chr(b) not in " \t\r\n" for b in raw)
    stats = [
        sum(65 <= b <= 90 for b in raw) / letters, sum(48 <= b <= 57 for b in raw) / n, other / n, sum(b >= 128 for b in raw) / n,
        sum(chr(b) in " \t\r" for b in raw) / n, min(1, 20 * raw.count(b"\n") / n), sum(chr(b) in "!|#$%&*{}<>=_~^" for b in raw) / len(tokens) / 2,
        sum(chr(b) not in " \t\r\n" for b in raw) / len(tokens) / 25, len(set(tokens)) / len(tokens), 1 - len(set(lines)) / len(lines),
        max(Counter(raw).values()) / n, sum(t.isalpha() for t in tokens) / len(tokens), np.log1p(len(tokens)) / 12, np.log1p(len(text)) / 14,
    ]
    weight = {}
    for t, k in Counter(tokens).items():
        weight[zlib.crc32(t) % 2**quality.BITS] = 1 + np.log(k)
    length = np.sqrt(sum(w * w for w in weight.values()))
    want = {i: w / length for i, w in weight.items()} | {2**quality.BITS + i * quality.BINS + min(quality.BINS - 1, int(quality.BINS * s**0.5)): 0.5 for i, s in enumerate(stats)}
    index, value = quality.features(text)
    assert dict(zip(index.tolist(), value.tolist(), strict=True)) == pytest.approx(want)
    assert len(quality.features(None)[0]) == len(quality.features("")[0]) == quality.STATS


def test_training_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, rows, labels: seen.append((len(rows), sorted(labels))))
    rows = [(3, words(20, i)) for i in range(50)] + [(i, words(20, i)) for i in range(10, 60)]
    quality.fit(documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"), train_rows=30)
    assert len(seen) == 1 and seen[0][0] <= 30


def test_quality_is_learned_from_labels_outside_the_hold_out(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, words(80, i).upper().replace(" ", "!! ") if bad else words(80, i)))
        labels.append((i, int(not bad), 0))
    odd = [(9001, None), (9002, ""), (None, "x")]
    found = quality.classify(documents(spark, rows + odd), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 603 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held if r.doc_id is not None} == {i for i, _ in rows + odd if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    known = [r for r in held if r.doc_id < 600]
    assert np.mean([(r.doc_id % 3 != 0) == bool(r.predicted) for r in known]) >= 0.95
    none = quality.classify(documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {1.0} and len(none) == len(ODD)


# --- lines


def general(line):
    """A line's tokens by the definition: variable ones generalised unless they are more than half."""
    tokens = line.split()
    shown = ["<*>" if any(c.isdigit() and c.isascii() or c == "@" for c in t) or "://" in t else t for t in tokens]
    return shown if 2 * sum(t == "<*>" for t in shown) <= len(tokens) or shown == tokens else tokens


def template_names(tokens):
    """(count, leading three, what is constant of the three thirds) of each template."""
    rest, n = tokens[3:], len(tokens)
    if n < 6:
        return [(n, *tokens)]
    a, b = len(rest) // 3, 2 * len(rest) // 3
    thirds = [tuple(rest[:a]), tuple(rest[a:b]), tuple(rest[b:])]
    return [(n, tuple(tokens[:3]), tuple(t if i != k else None for i, t in enumerate(thirds))) for k in range(3)]


def four_words(tokens):
    n = len(tokens)
    return {tuple(tokens[i : i + 4]) for i in {0, min(4, max(n - 8, 0)) if n > 8 else 0, max(n - 8, 0), max(n - 4, 0)} if n > 8 or i in (0, max(n - 4, 0))}


def lines_by_brute_force(rows, min_docs=3):
    """(doc_id, n_lines, n_dropped, text) by the definitions, without the operator's own functions."""
    texts = sorted({t for _, t in rows if t is not None})
    parts = {t: [(i, general(line)) for i, line in enumerate(t.split("\n")) if line.split()] for t in texts}
    near, holders = {}, {}
    for t, lines in parts.items():
        for i, tokens in lines:
            for w in four_words(tokens):
                near.setdefault(w, set()).add((t, i))
            for x in template_names(tokens):
                holders.setdefault(x, set()).add(t)
    asked = {t for own in holders.values() if len(own) >= min_docs for t in own}
    alone = lambda t, i, tokens: all({o for o in near[w] if o[0] in asked} == {(t, i)} for w in four_words(tokens))
    rest = [t for t in texts if t in asked and not any(alone(t, i, tokens) for i, tokens in parts[t])]
    shingles = {t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in rest}
    unit = {t: t for t in texts}
    for t in rest:
        for u in rest:
            if len(shingles[t] & shingles[u]) >= 0.8 * len(shingles[t] | shingles[u]):
                old, new = unit[u], unit[t]
                unit = {k: new if v == old else v for k, v in unit.items()}
    recurring = {x for x, held in holders.items() if len({unit[t] for t in held}) >= min_docs}
    out = Counter()
    for doc_id, t in rows:
        if t is None:
            out[doc_id, 0, 0, None] += 1
            continue
        gone = {i for i, tokens in parts[t] if set(template_names(tokens)) & recurring}
        kept = [line for i, line in enumerate(t.split("\n")) if i not in gone]
        out[doc_id, t.count("\n") + 1, len(gone), "\n".join(kept)] += 1
    return out


def deduplicated(spark, rows):
    table = documents(spark, rows)
    for name in ("_id", "_text_key", "text_key", "dropped", "gone", "_key", "line", "template"):
        table = table.withColumn(name, F.lit("clash"))
    found = line_dedup.drop_recurring(table)
    assert set(table.columns) <= set(found.columns) and found.where("gone <> 'clash' OR dropped <> 'clash'").count() == 0
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == lines_by_brute_force(rows)
    return {r[0]: r for r in got}


def test_line_dedup_drops_templates_and_keeps_copies(spark):
    body = {i: [words(12, 100 * i + j) for j in range(4)] for i in range(8)}
    rows = []
    for i in range(6):
        lines = list(body[i])
        lines.insert(i % 4, f"Posted on 2024-0{i + 1}-11 by user{i} under general news")
        lines.insert(2, "All rights reserved worldwide.")
        rows.append((i, "\n".join(lines)))
    rows += [(50 + i, "\n".join(body[7])) for i in range(5)]  # copies of a whole document
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, "All rights reserved worldwide."), (0, rows[0][1])]
    got = deduplicated(spark, rows)
    for i in range(6):
        assert got[i] == (i, 6, 2, "\n".join(body[i]))
    assert all(got[50 + i][2] == 0 for i in range(5))
    assert line_dedup.drop_recurring(documents(spark, [])).count() == 0


@pytest.mark.parametrize("documents_with_block", [6, 12])
def test_line_dedup_drops_a_long_block_beside_one_own_line(spark, documents_with_block):
    block = [words(9, 5000 + i, 10**6) for i in range(20)]
    rows = [(i, "\n".join([*block, words(9, 700 + i, 10**6)])) for i in range(documents_with_block)]
    rows += [(50 + i, f"one short line that is all of this document {'abcdef'[i]}") for i in range(6)]
    got = deduplicated(spark, rows)
    assert [got[i][2] for i in range(documents_with_block)] == [20] * documents_with_block
    # One template in six documents that are no copies of each other.
    assert [got[50 + i][2] for i in range(6)] == [1] * 6


@pytest.mark.parametrize("n", [6, 9, 24, 25, 30, 200])
def test_line_dedup_generalises_lines_of_any_length(spark, n):
    names = ["anna", "bert", "carl", "dora", "emil", "fritz"]
    base = words(n, 9, 10**6).split()
    rows = [(i, "\n".join([words(9, 70 + i, 10**6), " ".join([*base[:-1], name]), words(9, 80 + i, 10**6)])) for i, name in enumerate(names)]
    got = deduplicated(spark, rows)
    assert [got[i][2] for i in range(6)] == [1] * 6


def test_line_dedup_leaves_edited_copies_and_finds_families_in_one_leaf(spark):
    base = [words(14, 300 + j, 10**6).split() for j in range(12)]
    rows = []
    for i in range(40):
        lines = [list(x) for x in base]
        lines[i % 12][i % 14] = f"edit{'xyz'[i % 3]}{'abcdefgh'[i % 8]}"
        rows.append((i, "\n".join(map(" ".join, lines))))
    first, second = "this page was seen last by {} of the staff here", "this page was made to show {} how things are done"
    rows += [(100 + i, f"{words(9, 900 + i, 10**6)}\n{first.format(words(1, i, 10**6))}\n{second.format(words(1, 50 + i, 10**6))}") for i in range(5)]
    got = deduplicated(spark, rows)
    assert [got[i][2] for i in range(40)] == [0] * 40
    assert [got[100 + i][2] for i in range(5)] == [2] * 5


def test_line_dedup_drops_lines_of_documents_that_share_all_of_them(spark):
    shared = [words(9, 4000 + i, 10**6) for i in range(6)]
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.sample(shared, 4))) for i in range(40)]
    rows += [(100 + i, "\n".join(words(9, 4100 + j, 10**6) for j in range(5))) for i in range(10)]  # copies of one document
    got = deduplicated(spark, rows)
    assert sum(got[i][2] for i in range(40)) == 160 and all(got[100 + i][2] == 0 for i in range(10))


def test_line_dedup_of_a_very_long_text(spark):
    long_ = "\n".join(words(9, i, 10**6) for i in range(20_000))
    got = deduplicated(spark, [(1, long_), (2, "one line")] + [(3 + i, f"{words(9, 7, 10**6)}\n{words(9, 90_000 + i, 10**6)}") for i in range(3)])
    assert got[1][2] == 1 and got[3][2] == 1 and got[2][2] == 0


# --- SimHash


def components_by_brute_force(rows, radius, shingle):
    prints = {}
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (doc_id, text) in enumerate(rows):
        prints[i] = simhash.fingerprint(text, shingle)
        root[i] = i
    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((rows[i][0], prints[i], least.get(find(i))) for i in prints)


def test_fingerprint_by_definition():
    import xxhash

    text = "The  quick\x0bBROWN\u00a0fox É é\njumps the quick BROWN\u00a0fox"
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + 3]).encode(), 42) for i in range(len(tokens) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("one Two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("radius, block", [(2, 1024), (2, 4), (6, 4)])
def test_near_duplicates_by_brute_force(spark, radius, block):
    base = words(400, 1).split()
    rows = list(ODD)
    for i in range(60):
        edited = list(base)
        for k in range(i % 7):
            edited[(37 * i + 91 * k) % 400] = f"e{i}"
        rows.append((100 + i, " ".join(edited)))
    rows += [(200 + i, words(60, 300 + i)) for i in range(60)]
    got = simhash.near_duplicates(documents(spark, rows), radius, block=block).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == components_by_brute_force(rows, radius, 3)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_places_are_bounded_and_few(spark):
    rng = random.Random(1)
    signed = lambda x: x - 2**64 if x >> 63 else x
    dense = {sum(1 << b for b in rng.sample(range(0, 32, 2), 5)) for _ in range(2000)}  # all agree in the upper half
    far = {rng.getrandbits(64) for _ in range(20_000)}
    fps = spark.createDataFrame([(signed(x),) for x in dense | far], "node long")
    found = simhash.places(fps, 2, 256).groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("home")).collect()
    assert max(r.n for r in found) <= 2 * 256 * 1.5
    assert sum(r.n for r in found) < 40 * (len(dense) + len(far))


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    table = spark.createDataFrame([(i, ["x" * 50, None], [(1, "y")]) for i in range(20)] + [(None, None, None)], "a long, b array<string>, c array<struct<d:int,e:string>>")
    hinted = lambda: "broadcast" in common.bounded(table)._jdf.queryExecution().toString().lower()
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10**6)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    assert not hinted()


def test_keep_one(spark):
    base = words(300, 1, 5000).split()
    near = [*base[:150], "changed", *base[151:]]
    rows = [(3, " ".join(base)), (4, " ".join(near)), (2, words(300, 2, 5000)), (5, " ".join(base)), (3, " ".join(base)), (None, "x"), (9, None)]
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "9", "None"] and kept.columns == documents(spark, rows).columns


def test_keep_one_tells_texts_under_one_id_apart(spark):
    base = words(300, 1, 5000).split()
    first, near = " ".join(base), " ".join([*base[:150], "changed", *base[151:]])
    lone = [words(300, s, 5000) for s in range(10, 14)]
    rows = [(1, first), (7, near), (7, lone[0]), (7, lone[1]), (8, lone[2]), (8, lone[2]), (None, lone[3]), (None, lone[3]), (None, first)]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, first), (7, lone[0]), (7, lone[1]), (8, lone[2]), (None, lone[3])])


def edited(base, places, mark):
    return " ".join(f"{mark}n{i}" if i in places else w for i, w in enumerate(base.split()))


def test_keep_one_decides_by_exact_similarity(spark):
    rows = []
    for i in range(60):  # 180 shingles: four words apart are 160 of 200, five words apart 155 of 205
        base = words(184, 700 + i, 10**6)
        rows += [(1000 + i, base), (2000 + i, edited(base, {20, 60, 100, 140}, f"a{i}")), (3000 + i, edited(base, {30, 70, 110, 150, 170}, f"b{i}"))]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert kept == {1000 + i for i in range(60)} | {3000 + i for i in range(60)}


def test_keep_one_gathers_no_place_and_links_copies_by_their_original(spark, monkeypatch):
    by_key = simhash.by_key

    def in_blocks(frame, keys, *rest, **options):
        """Only fingerprints are gathered by place, two blocks at most."""
        assert set(frame.columns) == {"place", "node", "home"} and (frame.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= 2 * simhash.BLOCK
        return by_key(frame, keys, *rest, **options)

    monkeypatch.setattr(simhash, "by_key", in_blocks)
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    base = words(54, 1, 10**6)  # 50 shingles: a copy shares 45 of 55 with the base, with another copy 40 of 60 or less
    rows = [(i, edited(base, {5 + i % 44}, f"c{i}")) for i in range(1, 101)] + [(500, base)] + [(600 + i, words(54, 50 + i, 10**6)) for i in range(100)]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert kept == {1} | {600 + i for i in range(100)}


def test_fewest_agreements_of_min_hashes():
    assert near_copies.fewest(135, 1.0) == 135 and near_copies.fewest(135, 0.0) == 0
    for similarity in (0.5, 0.8, 0.95):
        chance = lambda k: math.comb(135, k) * similarity**k * (1 - similarity) ** (135 - k)
        least = near_copies.fewest(135, similarity)
        assert sum(map(chance, range(least))) <= near_copies.MISS < sum(map(chance, range(least + 1)))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_likely_pairs_of_buckets_by_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 135, np.uint8)
    nodes = []
    for i in range(60):  # two nodes of a bucket agree in 40 to 135 of 135 bytes
        own = base.copy()
        places = rng.choice(135, int(rng.integers(0, 70)), replace=False)
        own[places] = rng.integers(0, 256, len(places), np.uint8)
        nodes.append((int(rng.integers(-(2**62), 2**62)), bytearray(own.tobytes())))
    left = [(b, nodes[i][0], nodes[i // 3][0]) for b, ids in ((1, range(60)), (2, range(20)), (3, [4, 50])) for i in ids]
    sizes = Counter(b for b, _, _ in left)
    frame = spark.createDataFrame([(b, n, r, sizes[b]) for b, n, r in left], "bucket long, node long, root long, n long")
    got = near_copies.likely(frame, spark.createDataFrame(nodes, "node long, sketch binary"), 0.8, block).collect()
    sketch = {n: np.frombuffer(bytes(s), np.uint8) for n, s in nodes}
    least = near_copies.fewest(135, 0.8)
    want = {(u, v) for b, u, r in left for c, v, q in left if b == c and u < v and r != q and (sketch[u] == sketch[v]).sum() >= least}
    assert len(want) > 20 and Counter(map(tuple, got)) == Counter(want)


def test_sketches_leave_no_near_copy_out():
    base = words(300, 8, 10**6)
    sets = [np.unique(simhash.shingle_hashes(edited(base, set(range(k, 300, 100)), f"e{k}"), 5)) for k in range(40)]
    marks = [np.frombuffer(near_copies.signature(x)[1], np.uint8) for x in sets]
    near = 0
    for i, j in itertools.combinations(range(40), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
            near += 1
            assert (marks[i] == marks[j]).sum() >= near_copies.fewest(135, 0.8)
    assert near > 300


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


# --- repeated strings


def removed_by_brute_force(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_by_brute_force(spark, monkeypatch):
    passage = words(120, 50, 10**6)
    rows = list(ODD) + [(30, "a" * 700), (31, "ab" * 400), (32, passage[:199]), (33, passage[:200])]
    for i in range(25):
        cut = (i * 13) % 40
        rows.append((100 + i, words(30 + i, 900 + i, 10**6) + passage[cut : len(passage) - 3 * i] + words(20, 950 + i, 10**6)))
    rows += [(200, words(80, 7, 10**6) + words(80, 7, 10**6)), (201, passage + passage[:250])]
    # Short texts around one string: every start of the string is the last or the first that repeats.
    rows += [(300 + i, words(3, i, 10**6)[: i % 70] + passage[300 : 500 + i % 9] + words(9, 60 + i, 10**6)[: i % 31]) for i in range(60)]
    rows += [(400, words(2000, 77, 10**6)), (401, "x" + words(2000, 77, 10**6)[:9000])]
    want = removed_by_brute_force(rows, 200)
    for merge in (4096, 16):
        monkeypatch.setattr(suffix_dedup, "MERGE", merge)
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, rows)))
        assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_parts_cover_all_starts():
    for window in (2, 4, 48, 64):
        assert [j for a, b in suffix_dedup.parts(window) for j in range(a, b + 1)] == list(range(window))


def test_a_core_in_many_texts_is_split(spark):
    passage = words(60, 3, 10**6)
    rows = [(i, words(30, 10_000 + i, 10**6) + passage + words(30, 20_000 + i, 10**6)) for i in range(600)]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "row long, raw binary")
    found = suffix_dedup.repeated_ranges(texts, 200).select("row", "first", "stop").distinct().groupBy("row").agg(F.min("first").alias("a"), F.max("stop").alias("b")).collect()
    for r in found:
        text = rows[r.row][1]
        at = text.index(passage)
        assert r.a <= at and at - r.a < 8 and r.b >= at + len(passage) and r.b - at - len(passage) < 8
    assert len(found) == 600


def test_merge_by_brute_force():
    rng = random.Random(4)
    strings, left = [], []
    for _ in range(200):
        n = rng.randrange(0, 6)
        left.append(n)
        strings.append(bytes(rng.choice(b"ab") for _ in range(n + rng.randrange(2, 8))))
    cores = np.array([rng.randrange(3) for _ in strings])
    copies = np.array([1 + (rng.random() < 0.05) for _ in strings])
    symbol = [s[:k].decode() + "XYZ"[c] + s[k:].decode() for s, k, c in zip(strings, left, cores, strict=True)]
    starts = np.array([min(k + 1, len(s) - 2) for s, k in zip(symbol, left, strict=True)])
    got = suffix_dedup.merged_repeats(strings, np.array(left), cores, np.array([i % 3 for i in range(200)]), starts, 3, copies)
    count = Counter()
    for s, n in zip(symbol, copies.tolist(), strict=True):
        for i in range(len(s) - 2):
            count[s[i : i + 3]] += n
    for s, k, mask in zip(symbol, starts, got.tolist(), strict=True):
        assert [mask >> i & 1 == 1 for i in range(k)] == [count[s[i : i + 3]] > 1 for i in range(k)]


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    passage = words(30, 4000, 10**6)
    rows = [(i, words(150, i, 10**5) if i % 4 else words(150, i, 10**5).upper().replace(" ", "### ")) for i in range(160)]
    rows += [(200, rows[1][1]), (201, words(80, 600, 10**6) + " " + passage), (202, None), (203, "")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        seen[name] = {r.doc_id for r in docs.collect()}
    bad = {i for i in range(160) if i % 4 == 0}
    assert not seen["quality classifier"] & bad and len(seen["quality classifier"]) >= 120
    assert seen["simhash near-dedup"] == seen["line dedup"] - {200} - ({203} if 202 in seen["line dedup"] else set())
    assert seen["benchmark decontamination"] == seen["simhash near-dedup"] - {201}
    assert seen["best-fit packing"] == seen["benchmark decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["best-fit packing"]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert json.dumps(entry.oracle_sql())


def test_ranges_that_overlap_or_touch_are_one():
    rng = random.Random(3)
    for _ in range(200):
        ranges = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 12)))]
        gone = sorted({i for a, b in ranges for i in range(a, b)})
        wanted = [(a, next(b for b in range(a + 1, 99) if b not in gone)) for a in gone if a - 1 not in gone]
        found = suffix_dedup.runs_of(np.array([a << 32 | b for a, b in ranges], np.int64))
        assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in found] == wanted


def test_spent_tables_of_suffix_dedup_leave_the_disk_and_texts_stay(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    some = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(30)]
    docs = spark.createDataFrame([(i, some[i % 30] + " ".join(rng.choice(words) for _ in range(60))) for i in range(60)], "doc_id long, text string")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(docs))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before}
    assert not left & {"cores", "entries", "blocks", "open-entries"} and "suffix-texts" in left
    assert found.agg(F.sum("n_removed")).first()[0] > 0
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_frees_the_disk_after_each_comparison(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(near_copies, "freed", lambda df, *spent: calls.append(df.columns) or common.freed(df, *spent))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, "end" * (i % 2)])) for i in range(4)] + [(9, "something else")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
    assert ["u", "v"] in calls and ["node", "shingles"] in calls
    kept, spent = common.stored(docs, "kept-table"), common.stored(docs, "spent-table")
    assert common.freed(kept, spent).count() == 5
    assert not any(name.startswith("spent-table") for name in os.listdir(spark.conf.get("spark.checkpoint.dir")))
