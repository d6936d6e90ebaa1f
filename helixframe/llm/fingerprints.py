"""Document fingerprints by winnowing, in Spark expressions only.

A text's units are its words (runs without white space); a word of more than ``LONG`` code points counts as its single code points, so
texts without spaces have units too. Every unit is hashed once, and each run of ``K`` units takes a hash from the hashes of its units. Of
every ``WINDOW`` neighbouring runs the smallest hash is kept, of equal ones the rightmost, with its place (in units). Two
texts that share ``K + WINDOW - 1`` units in a row keep a common hash at corresponding places in them.

A text of fewer than ``K`` units (but some) is one run as it stands; fewer than ``WINDOW`` runs are one window. The likeness of two
fingerprints is the share of their distinct hashes that both hold, 1 if neither has any.

``with_next`` puts every document beside the next one: rows are dealt by ranges of doc_id (even ranges, from its quantiles) and each range
looks one row ahead. The first ids of a range are shown to the range before it, those of the first to the last, so all texts move once.

Edge cases: null text counts as empty, with an empty fingerprint; rows of one doc_id are ordered by their text's hash, null ids come
first; a table of one row has itself as the next; empty tables give no rows; extra columns are kept, but for those named like a result;
doc_id must be a number. Work on a text is linear in its length.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, shuffle_width

K, WINDOW, LONG = 5, 8, 24
GAP = r"[\x20\x09-\x0D]+"
#: Ranges of doc_id for each shuffle partition, so that unlike loads even out.
RANGES = 4
RESULT = ["n_chars", "edited", "hashes", "places", "edited_hashes", "edited_places", "near_edited", "near_next"]


def units(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _spelled(words: str) -> Column:
    """Long words as their code points."""
    long_ = lambda w: F.length(w) > LONG
    return F.when(F.exists(words, long_), F.flatten(F.transform(words, lambda w: F.when(long_(w), F.split(w, "")).otherwise(F.array(w))))).otherwise(F.col(words))


def with_fingerprint(df: DataFrame, text: str, hashes: str, places: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add the arrays ``hashes`` and ``places`` of the kept runs of column ``text``, in order of places."""
    # Each step is a column of its own and referred to several times, so Spark evaluates it once per row.
    words, own, grams, least, starts = (free_name(c, df.columns, [hashes, places]) for c in ("words", "own", "grams", "least", "starts"))
    rows = df.withColumn(words, units(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn(own, F.transform(_spelled(words), lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.size(own) - k)
    whole = F.when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(grams, F.when(F.size(own) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(k)]))).otherwise(whole))
    at = F.sequence(F.lit(0), F.size(grams) - window)
    one = F.when(F.size(grams) > 0, F.array(F.array_min(grams))).otherwise(F.col(grams))
    rows = rows.withColumn(least, F.when(F.size(grams) >= window, F.transform(at, lambda i: F.least(*[F.get(grams, i + j) for j in range(window)]))).otherwise(one))
    # A window keeps another run than the one before if its least hash differs, or if the run that it adds has the same hash.
    new = lambda j: (j == 0) | (F.get(least, j) != F.get(least, F.greatest(j - 1, F.lit(0)))) | (F.get(grams, j + window - 1) == F.get(least, j))
    each = F.when(F.size(least) > 0, F.filter(F.sequence(F.lit(0), F.size(least) - 1), new)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(starts, each)
    last = lambda j: F.coalesce(*[F.when(F.get(grams, j + i) == F.get(least, j), j + i) for i in reversed(range(window))])
    return rows.withColumns({hashes: F.transform(starts, lambda j: F.get(least, j)), places: F.transform(starts, last)}).drop(words, own, grams, least, starts)


def likeness(a: str, b: str) -> Column:
    """Share of the distinct hashes that both arrays hold."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def _edges(ids: DataFrame, count: int) -> list[float]:
    """Bounds between ``count`` (two or more) ranges of about as many rows each."""
    found = ids.agg(F.percentile_approx(F.col("id").cast("double"), [i / count for i in range(1, count)], 10_000)).first()[0]
    return [float("-inf"), *sorted(set(found or [0.0])), float("inf")]


def with_next(docs: DataFrame, shown: dict[str, str]) -> DataFrame:
    """Every row with columns of the row that follows it by doc_id, the first's for the last: ``shown`` names them."""
    key, turn, number, range_, first, before = (free_name(c, docs.columns, list(shown.values())) for c in ("key", "turn", "number", "range", "first", "before"))
    spark = docs.sparkSession
    bounds = _edges(docs.select(F.col("doc_id").alias("id")), RANGES * shuffle_width(spark))
    placed = Bucketizer(splits=bounds, inputCol=number, outputCol=range_, handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        # Ids that are null come first, in a range of their own.
        out = placed.transform(df.withColumn(number, F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
        return out.withColumn(range_, F.when(F.col("doc_id").isNull(), -1).otherwise(F.col(range_)).cast("int")).drop(number)

    # One row for each range.
    firsts = ranged(docs.select("doc_id")).groupBy(range_).agg(F.min("doc_id").alias("id")).collect()
    firsts = sorted((r[range_], r["id"]) for r in firsts)
    shift = [(id_, firsts[i - 1][0]) for i, (_, id_) in enumerate(firsts)]
    seen = F.broadcast(spark.createDataFrame(shift, docs.select(F.col("doc_id").alias(first), F.lit(0).alias(before)).schema))
    rows = ranged(docs).join(seen, F.col("doc_id").eqNullSafe(F.col(first)), "left")
    one = lambda c, n: F.struct(F.col(c).alias("range"), F.lit(n).alias("turn"))
    roles = F.when(F.col(before).isNotNull(), F.array(one(range_, 0), one(before, 1))).otherwise(F.array(one(range_, 0)))
    role = free_name("role", rows.columns)
    rows = rows.withColumn(role, F.explode(roles)).withColumns({range_: F.col(f"{role}.range"), turn: F.col(f"{role}.turn"), key: F.xxhash64("text")})
    ahead = Window.partitionBy(range_).orderBy(turn, "doc_id", key, "text")
    taken = [F.lead(c).over(ahead).alias(n) for c, n in shown.items()]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], turn, *taken).where(F.col(turn) == 0).drop(turn)


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the following text's begin."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The documents with their fingerprint (hashes, places), n_chars, the edited text and its fingerprint, and both likenesses."""
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    following, next_hashes = free_name("following", docs.columns, RESULT), free_name("next_hashes", docs.columns, RESULT)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    rows = with_next(with_fingerprint(rows, "text", "hashes", "places"), {"text": following, "hashes": next_hashes})
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("edited", edited(whole("text"), whole(following)))
    rows = with_fingerprint(rows, "edited", "edited_hashes", "edited_places")
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], F.length(whole("text")).cast("long").alias("n_chars"), "edited", "hashes", "places", "edited_hashes", "edited_places",
        likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", next_hashes).alias("near_next"),
    )


def spelled(hashes: str) -> Column:
    """A fingerprint as text: 16 hex digits for each kept run, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("hashes").alias("fingerprint"), spelled("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next"
    )
