"""Benchmark decontamination by winnowing, in Spark expressions only.

Words are the longest runs outside ``GAP`` (so of digits, letters and all that is not ASCII), with A-Z lower-cased. A *window* is ``SPAN`` consecutive words of an
item; an item with fewer words (but some) is one window as it stands.

Winnowing keeps, of every ``SPAN - K + 1`` neighbouring K-gram hashes, the smallest. Two equal windows of ``SPAN``
words contain equal K-grams, hence an equal smallest one: every shared window is met by a shared fingerprint.

1. Items and documents are turned into sets of fingerprints with the same expressions; the semi-join on fingerprints
   gives candidate documents.
2. Hits are extended: in candidates, the places of grams that are fingerprints of items are found; around each, the windows
   that can contain it are spelled out and joined with the items' windows word by word (string equality, so hash collisions cannot add hits).

Items shorter than ``SPAN`` have one fingerprint, the hash of all their words; documents are hashed at those lengths
too, which costs one pass per distinct short length (at most ``SPAN - 1``, none if there are no short items).

Benchmark tables are broadcast only within the rows and bytes of ``common.bounded``, measured first; beyond that Spark shuffles the join.

Edge cases: null texts and texts without words have no windows and n_words 0; rows that repeat a doc_id are told
apart by their text, and equal ones share one result each; empty tables give no hits; an item repeated under
another id counts as its own item, a null item_id is ignored; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, materialise, stored

#: What stands between words, before A-Z are lower-cased. Splitting here is several times as fast as extracting words by a pattern.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN, K = 10, 7


def _cut(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def words(text: Column) -> Column:
    return _cut(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _grams(hashes: str, n: int) -> Column:
    """Hashes of all n-grams, from the array of word hashes; null where there is none."""
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.when(F.size(hashes) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)])))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def fingerprints(rows: DataFrame, keep: list[str], lengths: list[int], span: int, k: int) -> DataFrame:
    """One row per fingerprint: ``keep``, n (0: winnowed, else the short length) and h."""
    width = span - k + 1
    grams = _hashed(rows).withColumn("grams", _grams("hashes", k))
    minima = F.transform(F.sequence(F.lit(0), F.size("grams") - width), lambda i: F.least(*[F.get("grams", i + j) for j in range(width)]))
    none = F.array().cast("array<bigint>")
    found = [(0, F.when(F.size("grams") >= width, minima))] + [(n, _grams("hashes", n)) for n in lengths]
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.array_distinct(F.coalesce(h, none)).alias("hs")) for n, h in found])
    return grams.select(*keep, F.explode(parts).alias("f")).select(*keep, "f.n", F.explode("f.hs").alias("h"))


def _places(rows: DataFrame, keep: list[str], lengths: list[int], k: int) -> DataFrame:
    """``keep``, n, h and at of every gram of ``k`` words (n = 0) or of a short length."""
    none = F.array().cast("array<bigint>")
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.coalesce(_grams("hashes", n or k), none).alias("hs")) for n in [0, *lengths]])
    each = _hashed(rows).select(*keep, F.explode(parts).alias("f"))
    return each.select(*keep, "f.n", F.posexplode("f.hs").alias("at", "h"))


def _spelled(at: Column, n: Column, span: int) -> Column:
    """``n`` (``span`` at most) of the column ``words`` from a place on, space-joined. Slicing would copy all words for each window."""
    return F.concat_ws(" ", *[F.when(n > j, F.get("words", at + j)) for j in range(span)])


def benchmark_windows(items: DataFrame, span: int) -> DataFrame:
    """item_id, n (0 for windows of ``span`` words, else the item's length) and the window's words, space-joined."""
    split = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0")
    n = F.size("words")
    at = F.when(n >= span, F.sequence(F.lit(1), n - (span - 1))).otherwise(F.array(F.lit(1)))
    return split.select("item_id", F.when(n >= span, 0).otherwise(n).alias("n"), F.explode(F.transform(at, lambda i: _spelled(i - 1, F.least(n, F.lit(span)), span))).alias("window")).distinct()


def _matches(keyed: DataFrame, items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n (0: ``span`` words), at and holders of all occurrences of items' windows; holders and their item_ids).

    ``holders`` names the set of items that hold a window, so a passage of many items and documents does not become a row for each two of them.
    """
    split = items.where("item_id IS NOT NULL").select(words(F.col("text")).alias("words")).where("size(words) > 0")
    # At most span - 1 numbers.
    lengths = sorted(r[0] for r in split.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    # Short items count as a whole only, long ones by winnowing only.
    own = fingerprints(split, ["words"], lengths, span, k).where(f"n = 0 AND size(words) >= {span} OR n = size(words)")
    wanted = materialise(own.select("n", "h").distinct())
    found = fingerprints(keyed.withColumn("words", words(F.col("text"))), ["doc_id", "text_key"], lengths, span, k)
    met = materialise(found.join(bounded(wanted), ["n", "h"], "left_semi").select("doc_id", "text_key").distinct())
    of = lambda t: [keyed["doc_id"].eqNullSafe(t["doc_id"]), keyed["text_key"] == t["text_key"]]
    asked = keyed.join(bounded(met), of(met), "left_semi").withColumn("words", words(F.col("text")))
    hits = _places(asked, ["doc_id", "text_key"], lengths, k).join(bounded(wanted), ["n", "h"], "left_semi").select("doc_id", "text_key", "n", "at").distinct()
    # The places of a document's hits: no more than it has words, for each short length.
    candidates = materialise(hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("n", "at")).alias("hits")))
    windows = benchmark_windows(items, span).groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = stored(windows.withColumn("holders", F.sha2(F.array_join("items", ","), 256)), "benchmark-windows")
    texts = keyed.join(bounded(candidates), of(candidates), "inner").select(keyed["doc_id"], keyed["text_key"], words(F.col("text")).alias("words"), "hits")
    # A gram at place p lies in the windows that start from p - (span - k) to p; a short item's window starts at p. A start is one number, place and length,
    # and windows are spelled where the words are, so the work on a text is linear in its hits.
    start = lambda at, n: at.cast("long") * span + n
    reach = lambda t: F.transform(F.sequence(F.greatest(t["at"] - (span - k), F.lit(0)), t["at"]), lambda i: start(i, F.lit(0)))
    starts = F.flatten(F.transform("hits", lambda t: F.when(t["n"] > 0, F.array(start(t["at"], t["n"]))).otherwise(reach(t))))
    placed = texts.withColumn("starts", F.array_distinct(starts))
    one = lambda s: F.struct((s % span).cast("int").alias("n"), F.floor(s / span).cast("int").alias("at"))
    fits = lambda p: (p["n"] > 0) | (p["at"] + span <= F.size("words"))
    window = lambda p: F.struct(p["n"].alias("n"), p["at"].alias("at"), _spelled(p["at"], F.when(p["n"] > 0, p["n"]).otherwise(span), span).alias("window"))
    spelled = placed.select("doc_id", "text_key", F.explode(F.transform(F.filter(F.transform("starts", one), fits), window)).alias("s")).select("doc_id", "text_key", "s.*")
    found = spelled.join(bounded(windows.select("n", "window", "holders")), ["n", "window"]).select("doc_id", "text_key", "n", "at", "holders")
    return found, windows.select("holders", "items").dropDuplicates(["holders"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    keyed = _keyed(docs)
    covered = F.sequence(F.col("at"), F.col("at") + F.when(F.col("n") > 0, F.col("n")).otherwise(span) - 1)
    found, holders = _matches(keyed, items, span, k)
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(covered)))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("holders")).alias("sets"),
    )
    per_doc = stored(per_doc.withColumn("list", F.sha2(F.array_join("sets", ","), 256)), "contaminated")
    # Documents with the same windows have one list of items, which is made once.
    lists = per_doc.select("list", "sets").dropDuplicates(["list"]).select("list", F.explode("sets").alias("holders"))
    lists = lists.join(bounded(holders), "holders").select("list", F.explode("items").alias("item_id")).distinct()
    lists = lists.groupBy("list").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    results = stored(per_doc.drop("sets").join(bounded(stored(lists, "item-lists")), "list").drop("list"), "contamination")
    counted = keyed.select("doc_id", "text_key", F.size(_cut(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(bounded(results), [counted["doc_id"].eqNullSafe(results["doc_id"]), counted["text_key"] == results["text_key"]], "left")
    return out.select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def contaminated_keys(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, text_key) of the contaminated documents."""
    return materialise(_matches(_keyed(docs), items, span, k)[0].select("doc_id", "text_key").distinct())


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose (doc_id, text_key) is not in ``keys``."""
    key, doc, found_key = (free_name(c, docs.columns) for c in ("own_key", "found_doc", "found_key"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = bounded(keys.select(F.col("doc_id").alias(doc), F.col("text_key").alias(found_key)))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(key) == F.col(found_key)), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0) x),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n) x),
m AS (SELECT DISTINCT r, n, i, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM m) q) z GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT r, item_id FROM m) q GROUP BY r)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
