"""Benchmark decontamination: pigeonhole edit matching.

An item with a budget of e edits is split into e + 1 pieces: wherever the item stands with at most e edits, one of the
pieces stands there unchanged. All pieces go into one Aho-Corasick automaton that runs over each document's whole text; a
hit fixes where the item would have to be, and Myers' bit-parallel edit distance verifies that place.

The items are sent to the tasks in blocks of a bounded number of characters, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, packed, same_row, saved, table

#: Edits allowed for a character of the item.
RATE = 0.05
#: Characters of items in one pass.
BLOCK_CHARS = 2_000_000
MATCHES = "_id long, _h long, item_id long, distance long, start long, end long"


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to any substring of text, and where the first such substring ends."""
    places: dict[str, int] = {}
    for k, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for k, c in enumerate(text, 1):
        eq = places.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, k
    return best, end


def within(a: str, b: str) -> bool:
    """Whether no word ends between two neighbouring characters; scripts without spaces have no such rule."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best place in the normalised text."""
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                s = last - size + 1 - offset
                if self.items[n][2] or not (s > 0 and within(text[s - 1], text[s]) or last + 1 < len(text) and within(text[last], text[last + 1])):
                    starts.setdefault(n, set()).add(s)
        out = []
        for n, at in starts.items():
            item_id, item, budget = self.items[n]
            best, until = (budget + 1, 0), None
            for s in sorted(at):
                if until is not None and s <= until:  # its window is within the last one
                    continue
                low = max(0, s - budget)
                distance, end = myers(item, text[low : s + 2 * budget + len(item) + budget])
                until = s + budget
                if distance < best[0]:
                    best = (distance, low + end)
            if best[0] <= budget:
                out.append((item_id, best[0], max(0, best[1] - len(item)), best[1]))
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    own = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).distinct()
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        items = [(r.i, normalised(r.t)) for r in rows]
        if items := sorted({x for x in items if x[1]}, key=str):
            yield items


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """_id, _h (the document), item_id, distance, start, end (in the normalised text): the best place of each item.

    Every item is searched in every whole text, one without a budget of edits at word boundaries only; case and white space don't count. Null texts
    and null items match nothing. Repeated rows match once each; repeated items count once.
    """
    spark = docs.sparkSession
    base = packed(docs, id_col, text_col).select("_id", "_h", "_text")
    parts = []
    for items in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, rate)
            for pdf in batches:
                rows = [(i, h, *m) for i, h, t in zip(pdf["_id"], pdf["_h"], pdf["_text"], strict=True) for m in matcher.matches(normalised(t))]
                if rows:
                    yield pd.DataFrame(rows, columns=["_id", "_h", "item_id", "distance", "start", "end"]).astype({"_id": "Int64", "item_id": "Int64"})

        parts.append(base.mapInPandas(run, MATCHES))
    if not parts:
        return spark.createDataFrame([], MATCHES)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item stands; all their columns are kept as they are."""
    found = benchmark_matches(docs, benchmark, id_col, text_col, **options)
    found = saved(found.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).distinct())
    base = packed(docs, id_col, text_col)
    return join_small(base, found, same_row(base, found), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), "item_id", "distance", "start", "end")
