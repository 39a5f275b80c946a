"""Importance resampling towards a target distribution, with DuckDB in each partition.

Documents are weighed by their hashed word n-grams. Within a Spark task, DuckDB takes the words of a slice of texts with
unnest, forms n-grams with window functions, and hashes them with a registered CRC function of zlib: it hashes each
different word once, and the CRC of an n-gram follows from those of its words. Bucket counts are spilled to Parquet: a
row for each document, and one with the counts of the whole task. Spark merges the tasks' counts of the corpus and of the
target, scores the documents' rows by the gain of each bucket, and ranks them by score in ranges.

A task holds a slice of PIECE_BYTES of text at a time; a longer text is cut at spaces, each piece with the words that
follow it, so that no n-gram is lost or counted twice.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import saved, table
from relcheck.operators.ranges import in_ranges

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
MIN_WORDS = 20
PER_CENT = 5
SEED = 42
#: Bytes of text that DuckDB is given at once, and the memory it may take before it spills to disk.
PIECE_BYTES = 2 << 20
DUCK_MEMORY = "256MB"
#: Lower case for A to Z, a space for all other ASCII but letters and digits; bytes of longer characters stay.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The words of a slice with the CRCs of each word and of a space and the word, made once for each different word.
WORDS_SQL = """
with given as (select doc, own, string_split(text, ' ') as ws from slice),
each as (select doc, own, unnest(ws) as word, unnest(range(len(ws))) as i from given),
placed as (select doc, i < own as own, word, row_number() over () as place from each where word <> ''),
hashed as (select word, crc32(word) as c, crc32(' ' || word) as s, strlen(word) + 1 as n from (select distinct word from placed))
select doc, own, place, c, s, n from placed join hashed using (word)
"""


def grams_sql(longest: int, buckets: int) -> str:
    """Bucket counts of each document: n-grams of 1 to longest words, by windows over its words in order."""
    gram, steps = "c", []
    for k in range(1, longest):
        steps.append(f"lead(s, {k}) over w as s{k}, lead(n, {k}) over w as n{k}")
    sums = [gram]
    for k in range(1, longest):
        gram = f"xor(crc32_shift({gram}, n{k}), s{k})"
        sums.append(gram)
    windows = "".join(", " + s for s in steps)
    grams = ", ".join(sums)
    return f"""
with windows as (select doc, own, c{windows} from words window w as (partition by doc order by place)),
grams as (select doc, unnest([{grams}]) as crc from windows where own)
select doc, (crc % {buckets})::usmallint as bucket, count(*)::uinteger as n from grams where crc is not null group by all order by doc, bucket
"""


def shift_tables(longest: int = 64) -> np.ndarray:
    """For each number of bytes up to longest, what zero bytes after it do to a CRC, by the CRC's bytes: 4 x 256 values.
    CRCs are linear in that sense, so a joint text's CRC is the shifted one of its head, xor that of its tail."""
    bits = [1 << k for k in range(32)]
    zero = zlib.crc32(b"\0", 0)
    one = [zlib.crc32(b"\0", b) ^ zero for b in bits]  # a CRC's single bits, one byte on

    def of(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for part in range(4):
            for bit in range(8):
                out[part, (np.arange(256) >> bit) & 1 == 1] ^= np.uint32(columns[8 * part + bit])
        return out

    def applied(t: np.ndarray, x: int) -> int:
        return int(t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24])

    step, columns, tables = of(one), bits, []
    for _ in range(longest + 1):
        tables.append(of(columns))
        columns = [applied(step, c) for c in columns]
    return np.stack(tables)


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind, copy=False)


class Hasher:
    """The two functions that DuckDB is given."""

    def __init__(self):
        self.tables = shift_tables()

    @staticmethod
    def crc32(words: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.uint32())

    def shift(self, crcs: pa.Array, lengths: pa.Array) -> pa.Array:
        """Each CRC as it is after so many zero bytes; null where either is."""
        x, n = numbers(crcs, np.uint32), numbers(lengths, np.int64)
        most = len(self.tables) - 1
        while n.any():
            t = np.minimum(n, most)
            x = self.tables[t, 0, x & 255] ^ self.tables[t, 1, x >> 8 & 255] ^ self.tables[t, 2, x >> 16 & 255] ^ self.tables[t, 3, x >> 24]
            n = n - t
        return pa.array(x, pa.uint32(), mask=~(crcs.is_valid().to_numpy(zero_copy_only=False) & lengths.is_valid().to_numpy(zero_copy_only=False)))


def connect():
    """A DuckDB connection of one thread that spills to the worker's own temporary folder, with the CRC functions."""
    import duckdb

    con, hasher = duckdb.connect(), Hasher()
    con.execute(f"set threads = 1; set memory_limit = '{DUCK_MEMORY}'; set temp_directory = '{tempfile.mkdtemp()}'")
    con.create_function("crc32", hasher.crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    con.create_function("crc32_shift", hasher.shift, ["UINTEGER", "BIGINT"], "UINTEGER", type="arrow", null_handling="special")
    return con


def pieces(text: bytes, most: int, longest: int) -> Iterator[tuple[bytes, bytes]]:
    """A cleaned text in pieces of about `most` bytes that end at spaces, each with the words (longest - 1) after it."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= most else text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        follow, to = [], end
        while to < len(text) and len(follow) < longest - 1:
            while to < len(text) and text[to] == 32:
                to += 1
            stop = text.find(b" ", to)
            stop = len(text) if stop < 0 else stop
            if stop > to:
                follow.append(text[to:stop])
            to = stop
        yield text[at:end], b" ".join(follow)
        at = end


def counter(buckets: int, longest: int, piece_bytes: int):
    """Bucket counts of the documents of a task: their rows, then one row with the task's own counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, whole, schema = connect(), np.zeros(buckets, np.int64), None
        sql = grams_sql(longest, buckets)

        def flush(held: list[tuple[int, bytes, bytes]], sums: dict[int, list]) -> None:
            rows = [(d, t.count(b" ") + 1, t + b" " + after) for d, t, after in held]
            slice_ = pa.table({"doc": pa.array([r[0] for r in rows], pa.int32()), "own": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2].decode() for r in rows], pa.string())})
            con.register("slice", slice_)
            con.execute(f"create or replace temp table words as {WORDS_SQL}")
            for d, n in con.execute("select doc, count(*) from words where own group by doc").fetchall():
                sums.setdefault(d, [0, []])[0] += n
            found = con.sql(sql).to_arrow_table()
            doc, bucket, n = (numbers(found[c].combine_chunks(), kind) for c, kind in (("doc", np.int64), ("bucket", np.uint16), ("n", np.uint32)))
            ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                sums.setdefault(int(doc[a]), [0, []])[1].append((bucket[a:b], n[a:b]))
            con.unregister("slice")

        def rows_of(batch: pa.RecordBatch, a: int, b: int, sums: dict[int, list]) -> pa.RecordBatch:
            told: list[tuple[int, int, bytes, bytes]] = []
            for d in range(a, b):
                words, parts = sums.pop(d, (0, []))
                if len(parts) > 1:
                    full = np.zeros(buckets, np.int64)
                    for x, n in parts:
                        full[x] += n
                    parts = [(np.flatnonzero(full).astype(np.uint16), full[full > 0])]
                x, n = parts[0] if parts else (np.zeros(0, np.uint16), np.zeros(0, np.uint32))
                whole[x] += n
                told.append((words, int(n.sum()), x.tobytes(), n.astype(np.uint64 if n.max(initial=0) > 255 else np.uint8).tobytes()))
            columns = [pa.array(x, t) for x, t in zip(zip(*told, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            none = pa.nulls(b - a, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *columns, none], names=["row", "n_words", "n_features", "buckets", "counts", "whole"])

        for batch in batches:
            texts, sums, held, size, done = batch.column("text"), {}, [], 0, 0
            for d in range(batch.num_rows):
                for text, after in pieces(texts[d].as_buffer().to_pybytes().translate(CLEAN) if texts[d].is_valid else b"", piece_bytes, longest):
                    held.append((d, text, after))
                    size += len(text) + len(after)
                    if size >= piece_bytes:
                        flush(held, sums)
                        held, size = [], 0
                if d + 1 == batch.num_rows and held:
                    flush(held, sums)
                    held, size = [], 0
                if not held and (sums or d + 1 == batch.num_rows):
                    out = rows_of(batch, done, d + 1, sums)
                    schema, done = out.schema, d + 1
                    yield out
        if schema is not None:
            last = [pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([whole.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(last, schema=schema)

    return count


def counted(docs: DataFrame, buckets: int, longest: int, piece_bytes: int) -> DataFrame:
    """The spilled table of docs, which has `row` and `_text`: row, n_words, n_features, buckets, counts; and, in the tasks'
    own rows, whole."""
    given = docs.select("row", F.col("_text").cast("string").cast("binary").alias("text"))
    schema = f"row {given.schema['row'].dataType.simpleString()}, n_words long, n_features long, buckets binary, counts binary, whole array<long>"
    return saved(given.mapInArrow(counter(buckets, longest, piece_bytes), schema))


def bucket_sums(spilled: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all tasks by bucket: as many numbers as there are buckets come to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in spilled.where("whole is not null").select(F.posexplode("whole").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier the target has a bucket than the corpus, both smoothed by one."""
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + k) / ((int(x) + 1) * (t + k)))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, n in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                own = np.frombuffer(b.as_buffer(), np.uint16)
                wide = len(n.as_buffer()) != len(own)
                out.append(int(gain[own] @ np.frombuffer(n.as_buffer(), np.uint64 if wide else np.uint8).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), batch.column("n_features"), pa.array(out, pa.int64())], names=["row", "n_words", "n_features", "weight"])

    return weigh


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    with_text: bool = False,
    min_words: int = MIN_WORDS,
    per_cent: int = PER_CENT,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """docs (without their texts unless with_text) with n_words, n_features, weight, score and rank.

    rank: 1, 2, 3... by score (ties: the smaller id, then arbitrary) of the best per_cent of documents with min_words
    words or more; null for all others. The score is the weight plus Gumbel noise by a hash of the id, so the best are a
    sample without replacement by weight. Null text: no features, weight 0. A null id is hashed as an empty one and stands
    last among ties. Repeated rows are documents of their own and have equal scores. An empty target counts as nothing
    seen; empty docs give an empty result. Columns of docs with the name of an added one are replaced.
    """
    if buckets > 1 << 16:
        raise ValueError("bucket numbers are kept in 16 bits")
    kept = [c for c in docs.columns if (with_text or c != text_col) and c.lower() not in ("n_words", "n_features", "weight", "score", "rank")]
    row = F.struct(F.col(id_col).cast("string").alias("id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    own = counted(docs.select(row.alias("row"), F.col(text_col).alias("_text")), buckets, longest, piece_bytes)
    aim = counted(target.select(F.struct(F.lit(0).alias("k")).alias("row"), F.col(target_text).alias("_text")), buckets, longest, piece_bytes)
    gain = gains(bucket_sums(own, buckets), bucket_sums(aim, buckets))
    rows = own.where("whole is null").select("row", "n_words", "n_features", "buckets", "counts")
    schema = f"row {own.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long"
    weighed = rows.mapInArrow(weigher(gain), schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("row.id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.select("*", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("able"))
    number = F.col("row.id").cast("bigint") if dict(docs.dtypes)[id_col] != "string" else F.col("row.id")
    placed = in_ranges(scored, [F.col("able")], [F.desc("score"), number.asc_nulls_last()], rank="place", size="all")
    drawn = F.col("able") & (F.col("place") <= F.floor(F.col("all") * per_cent / 100))
    return placed.select(
        *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank")
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
