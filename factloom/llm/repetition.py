"""Repetition inside single documents.

`repeated_share` measures which words lie in stretches that already stood earlier in the same text: document by document, no
shuffle. `line_first` is line-first cleaning: punctuation, navigation and boilerplate rules per line, the boilerplate
learnt from the corpus, remove lines, and documents that lose too much text are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.session import stage

#: Words; in scripts that write no spaces every character is one.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^\W\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")


def repeated_words(text: str | None, stretch: int = 5) -> tuple[int, int]:
    """(words, words in repeats). A word lies in a repeat if some window of `stretch` words around it equals a window
    that begins earlier; case and punctuation aside. Windows are compared by 64-bit hashes of their words."""
    words = _WORD.findall(text.casefold()) if text else []
    n = len(words)
    if n <= stretch:
        return n, 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    g = np.zeros(n - stretch + 1, np.uint64)
    for k in range(stretch):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n - stretch + 1 + k]
    order = np.argsort(g, kind="stable")
    s = g[order]
    again = np.zeros(len(g), bool)
    again[order[1:][s[1:] == s[:-1]]] = True
    if not again.any():
        return n, 0
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + stretch, -1)
    return n, int((np.cumsum(edge[:n]) > 0).sum())


def repeated_share(df: DataFrame, id_: str, text: str, stretch: int = 5) -> DataFrame:
    """(id, n_words, n_repeated, share) for every row. Null and empty texts have no words and share 0; repeated rows
    give repeated results; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [repeated_words(t, stretch) for t in b.column(1).to_pylist()]
            n, r = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
            yield pa.record_batch({"id": b.column(0), "n_words": n, "n_repeated": r, "share": r / np.maximum(n, 1)})

    kind = df.schema[id_].dataType.simpleString()
    return df.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_words bigint, n_repeated bigint, share double").withColumnRenamed("id", id_)


def line_rules(x: F.Column, least_words: int = 3) -> F.Column:
    """Whether a line fails by itself: navigation (items parted by two separators or more), or a scrap without closing
    punctuation. Code (indented lines) passes."""
    few = F.regexp_count(x, F.lit(r"(?U)\w+")) < least_words
    scrap = few & ~x.rlike(r"[.!?…:;»”\"。！？]$") & ~x.rlike(r"^(\s{4}|\t)")
    return scrap | x.rlike(r"(?U)^[^|·»/>]*([|·»]|\s[/>]\s)[^|·»/>]*([|·»]|\s[/>]\s)")


def boilerplate(lines: DataFrame, least_docs: int = 5, doc_share: float = 0.0005) -> DataFrame:
    """(_h): hashes of the lines, numbers aside, that stand in `doc_share` of all documents and in `least_docs` at least: what no
    single document says. lines: _id, _h, a row per document and distinct line. There are at most (lines per document /
    doc_share) of them, whatever the number of documents; counts are combined map-side."""
    n = lines.groupBy(F.col("_h").alias("_hb")).agg(F.count(F.lit(1)).alias("_docs"))
    every = lines.select(F.countDistinct("_id").alias("n")).scalar()
    return n.filter((F.col("_docs") >= least_docs) & (F.col("_docs") >= doc_share * every)).select("_hb")


def line_first(df: DataFrame, id_: str, text: str, least_words: int = 3, most_lost: float = 0.3, least_docs: int = 5, doc_share: float = 0.0005) -> DataFrame:
    """(id, n_lines, n_kept, n_words, n_words_kept, lost, rejected) per distinct row. A line is removed if it fails the rules by
    itself, is boilerplate of the corpus (learnt from how many documents it stands in), or stood earlier in the document.
    A document losing more than `most_lost` of its words is rejected; texts without words lose nothing and are not rejected.
    Null texts count as empty; ids should be unique, rows of one id are read as one text each; an empty table
    gives an empty result; other columns are not read. Lines leave their texts as hashes and word counts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: F.length(F.trim(x)) > 0)
    one = lambda x: F.struct(F.xxhash64(F.regexp_replace(F.lower(F.trim(x)), r"\d+", "9")).alias("h"), F.xxhash64(x).alias("e"), F.regexp_count(x, F.lit(r"(?U)\w+")).alias("w"), line_rules(x, least_words).alias("bad"))
    d = df.select(F.col(id_).alias("_id"), F.xxhash64(t).alias("_text"), F.transform(lines, one).alias("_full")).distinct()
    d = d.select("_id", "_text", F.size("_full").alias("n_lines"), F.aggregate("_full", F.lit(0), lambda s, x: s + x["w"]).alias("n_words"), F.array_distinct("_full").alias("_once"))
    d = stage(d.withColumn("_key", F.xxhash64("_id", "_text")), "documents")
    each = d.select("_key", F.explode("_once").alias("x")).select("_key", "x.*")
    common = boilerplate(each.select(F.col("_key").alias("_id"), F.col("h").alias("_h")).distinct(), least_docs, doc_share)
    kept = each.filter("NOT bad").join(common, F.col("h") == F.col("_hb"), "left_anti").groupBy(F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("n_kept"), F.sum("w").alias("n_words_kept"))
    d = d.select("_id", "_key", "n_lines", "n_words").join(kept, F.col("_key") == F.col("_k"), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    d = d.select(F.col("_id").alias(id_), "n_lines", z("n_kept"), "n_words", z("n_words_kept"))
    lost = F.when(F.col("n_words") > 0, 1 - F.col("n_words_kept") / F.col("n_words")).otherwise(0.0)
    return d.withColumn("lost", F.round(lost, 6)).withColumn("rejected", F.col("lost") > most_lost)
