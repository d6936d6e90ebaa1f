"""Line dedup with a log-template tree.

Every line descends a tree of fixed depth: first its number of tokens, then its ``DEPTH`` leading tokens. Tokens that hold a
digit, an "@" or "://" are variable fields, ``<*>``, before the descent, unless they are more than half of the line. In its leaf a line belongs
to templates: the rest of its tokens is cut into a first, middle and last third, and a template keeps two thirds
as constants and generalises the other one. So a line of ``SPLIT`` tokens or more has three templates, and lines that differ in a
run of fields within one third share one; shorter lines are their own template. There is no other limit on the length of a line, on templates in a leaf or
on lines of a template.

A template recurs if ``MIN_DOCS`` documents hold a line of it, copies of a document counting once. Copies of a text are known by its
hash. Edited copies are looked for among the documents without a line of their own (one that resembles no line of another text; lines resemble
each other if they share one of four windows of ``WINDOW`` words, two from either end): those whose sets of five-word shingles agree in
one of ``BANDS`` bands of ``ROWS`` min-hashes, and what these link to, are one document. A pair of Jaccard similarity s does so with probability
1 - (1 - s^ROWS)^BANDS: 0.99 at 0.92, 0.98 at 0.9, 0.44 at 0.8, 0.006 at 0.6; groups of several copies hang together by any of their pairs. That only counts copies, so pairs
are not compared in full, and the work is linear in the documents. So a block of boilerplate is found however long it is
beside the text around it, and documents that consist of shared lines only lose them, but groups of near copies are left to document-level deduplication.

All lines of recurring templates are dropped from every document, first occurrence included. Blank lines stay.

Edge cases: null text stays null with no lines; rows are judged by their text alone, so repeated rows, ids and null ids
work like any others; empty tables give no rows; extra columns are carried along under any name, except that the
result's ``n_lines`` and ``n_dropped`` take the place of columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import bounded, free_name, materialise, stored
from .graph import components

DEPTH = 3
SPLIT = DEPTH + 3
WINDOW = 4
MIN_DOCS = 3
ROWS, BANDS, SHINGLE = 16, 20, 5
VARIABLE = re.compile(r"[0-9@]|://")
TEMPLATES, WINDOWS = ["t0", "t1", "t2"], ["w0", "w1", "w2", "w3"]
LINES = "text_key long, line int, line_key long, " + ", ".join(f"{c} long" for c in TEMPLATES + WINDOWS)


def masked(line: str) -> list[str]:
    """The line's tokens, variable ones as ``<*>``; a line with more variable tokens than others says nothing and stays as it is."""
    tokens = line.split()
    if not VARIABLE.search(line):
        return tokens
    general = ["<*>" if VARIABLE.search(t) else t for t in tokens]
    return general if 2 * general.count("<*>") <= len(tokens) else tokens


def templates(tokens: list[str]) -> list[str]:
    """The templates of a line: its leaf and what is constant behind the leading tokens."""
    n = len(tokens)
    leaf = f"{n} {' '.join(tokens[:DEPTH])}"
    rest = tokens[DEPTH:]
    if n < SPLIT:
        return [f"{leaf}\n{' '.join(rest)}"]
    a, b = len(rest) // 3, 2 * len(rest) // 3
    first, middle, last = " ".join(rest[:a]), " ".join(rest[a:b]), " ".join(rest[b:])
    return [f"{leaf}\n{first}\n{middle}\n<*>", f"{leaf}\n{first}\n<*>\n{last}", f"{leaf}\n<*>\n{middle}\n{last}"]


def ends(tokens: list[str]) -> list[str]:
    """Windows of WINDOW words: the first two and, for lines that have more words, the last two."""
    n = len(tokens)
    starts = {0} if n <= WINDOW else {0, n - WINDOW} if n <= 2 * WINDOW else {0, WINDOW, n - 2 * WINDOW, n - WINDOW}
    return [" ".join(tokens[i : i + WINDOW]) for i in sorted(starts)]


def parse(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: hashes of its place, its templates and its windows (the first again where there are fewer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        def h(text: str) -> int:
            x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            return x - (1 << 64) if x >> 63 else x

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(np.array(rows, np.int64), columns=["text_key", "line", "line_key", *TEMPLATES, *WINDOWS]).astype({"line": np.int32})

        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["text"], strict=True):
                for i, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    if tokens:
                        own, near = [h(t) for t in templates(tokens)], [h(t) for t in ends(tokens)]
                        rows.append((key, i, h(f"{key} {i}"), *own, *own[:1] * (3 - len(own)), *near, *near[:1] * (4 - len(near))))
                        if len(rows) >= 50_000:
                            yield frame(rows)
                            rows = []
        if rows:
            yield frame(rows)

    return docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, LINES)


def _each(lines: DataFrame, columns: list[str], name: str, *keep: str) -> DataFrame:
    return lines.select(*keep, F.explode(F.array_distinct(F.array(*columns))).alias(name))


def independent(lines: DataFrame) -> DataFrame:
    """text_key of the texts with a line none of whose windows stands in another line, copies of the text apart."""
    seen = _each(lines.withColumn("n", F.size(F.array_distinct(F.array(*WINDOWS)))), WINDOWS, "window", "text_key", "line_key", "n")
    lone = seen.groupBy("window").agg(*[f(c).alias(a) for f, c, a in [(F.min, "line_key", "line_key"), (F.max, "line_key", "other"), (F.min, "text_key", "text_key"), (F.min, "n", "n")]]).where("line_key = other")
    return lone.groupBy("line_key").agg(F.count("*").alias("lone"), F.min("n").alias("n"), F.min("text_key").alias("text_key")).where("lone = n").select("text_key").distinct()


def copy_groups(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key and ``unit`` of the ``wanted`` texts (text_key): one unit for each group of copies."""
    keyed = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(bounded(wanted), "text_key", "left_semi").dropDuplicates(["text_key"])
    signed = materialise(near_copies.with_signature(texts.select(F.col("text_key").alias("doc_id"), "text_key", "text"), SHINGLE, ROWS, BANDS).select("text_key", "node", "bands"))
    # Equal sets are one node; nodes of a band are linked to its least.
    rows = signed.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last").select("band", "u")
    links = materialise(rows.join(least, "band").where("u <> node").select("u", F.col("node").alias("v")).distinct())
    found = components(links).withColumnRenamed("node", "_node")
    return signed.join(bounded(found), F.col("node") == F.col("_node"), "left").select("text_key", F.xxhash64(F.lit("copies"), F.coalesce("root", "node")).alias("unit"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """text_key and ``gone`` (whether a line goes, by its number) of the texts that lose lines."""
    lines = stored(parse(docs), "lines")
    rows = _each(lines, TEMPLATES, "template", "text_key", "line")
    twice = rows.groupBy("template").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("template")
    shared = stored(rows.join(bounded(stored(twice, "templates-twice")), "template", "left_semi"), "lines-shared")
    texts = shared.select("template", "text_key").distinct()
    many = stored(texts.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"), "templates-many")
    texts = stored(texts.join(bounded(many), "template", "left_semi"), "texts-many")
    asked = stored(texts.select("text_key").distinct(), "texts-asked")
    own = stored(independent(lines.join(bounded(asked), "text_key", "left_semi")), "texts-own")
    units = stored(copy_groups(docs, asked.join(bounded(own), "text_key", "left_anti")), "texts-units")
    # A document that is no copy is a unit of its own.
    counted = texts.join(bounded(units), "text_key", "left").select("template", F.coalesce("unit", "text_key").alias("unit")).distinct().groupBy("template").agg(F.count("*").alias("n"))
    recurring = stored(counted.where(F.col("n") >= min_docs).select("template"), "templates-recurring")
    # A text's dropped lines are no more than it has lines.
    dropped = shared.join(bounded(recurring), "template", "left_semi").select("text_key", "line").distinct()
    dropped = dropped.groupBy("text_key").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    before = lambda i: F.coalesce(F.get("lines", F.when(i > 0, i - 1)), F.lit(-1))
    flags = F.transform("lines", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - before(i) - 1), F.array(F.lit(True))))
    return stored(dropped.select("text_key", F.flatten(flags).alias("gone")), "lines-dropped")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """The documents with ``text`` less its recurring lines, and n_lines and n_dropped unless ``counts`` is false."""
    key, flags = free_name("text_key", docs.columns), free_name("gone", docs.columns)
    gone = recurring_lines(docs, min_docs).select(F.col("text_key").alias(key), F.col("gone").alias(flags))
    joined = docs.withColumn(key, F.xxhash64("text")).join(bounded(gone), key, "left")
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False))), "\n")
    text = F.when(F.col(flags).isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text")
    if not counts:
        return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return joined.select(
        *[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0)).cast("long").alias("n_dropped"),
    )
