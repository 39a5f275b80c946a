"""LM scoring: a hierarchical Pitman-Yor model of words in context, seated by Gibbs sampling.

Each word is a context restaurant for the words that follow it; all of them share one parent restaurant, whose parent is
uniform over the known words and one unknown. A customer of a context restaurant who opens a table is a customer of the
parent. Rounds of blocked Gibbs: in each, the number of tables of every section (context, word) is drawn from its
conditional, given the restaurant's other tables and the parent's probability of the word as the round before left them;
then the parent's tables of every word are drawn in the same way. The first BURN_IN rounds are thrown away; a text's score
averages the predictive probabilities of the SAMPLES seatings that follow, token by token.

On Spark: each task packs its documents' tokens into one blob for each bucket of sections; a bucket counts its sections
and seats them; it exchanges numbers with the parts of the words (counts, customers, tables), which hold the parent and the
contexts' totals. Words have their hashes with them on the first way to the parts only; then both sides know their places.
The tokens are shuffled once. Pairs of words that make up HOT_SHARE of the corpus or more, which are a
bounded number in any corpus, are counted where they stand, so that no bucket gathers their tokens; their probabilities are
sent back to the documents. Seatings and the sums of their probabilities are a saved table in each round, so that no round
repeats another. Log probabilities are summed per document within a bucket, packed into one blob for each shard of the
documents, and summed over the buckets there: a row for each document and bucket is never made.
"""

from __future__ import annotations

import gc
import pickle
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import packed, saved, table, workspace
from relcheck.llm.shingles import STEP, U, mixed, parts, word_hashes

#: Discount of all restaurants: for one half the numbers of seatings have a closed form, so that tables are drawn exactly
#: from their conditional, however many the customers. Strengths of the context restaurants and of their parent.
DISCOUNT, STRENGTH, PARENT_STRENGTH = 0.5, 1.0, 1.0
#: Rounds of Gibbs that are thrown away, and rounds after them whose seatings are averaged.
BURN_IN, SAMPLES = 4, 4
#: Occurrences for a byte of the corpus that make a pair of words hot: at most 1 / HOT_SHARE pairs are.
HOT_SHARE = 2e-6
HOT_COUNT = 64
#: Customers up to which all weights of a section are products, without logarithms.
FEW = 32
#: Passes in which tokens are sent to a share of the buckets each, and scored: so much less is on the way at a time.
PASSES = 2
END = mixed(np.array([0x656E64], np.uint64))[0]
BUCKET_BYTES = 14 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER = LOWER.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def pairs_of(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of pairs (context, word); modulo the number of buckets they are the pairs' buckets."""
    return mixed(u * STEP + w)


def small(x: np.ndarray) -> np.ndarray:
    """x in the least unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


TOKENS = "bucket int, blob binary"


def tokens_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens of a batch, and each token's row."""
    texts = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in pdf["_text"]]
    words = [np.append(x, END) for a, b in parts(texts) for x in word_hashes(texts[a:b])]
    w = np.concatenate(words)
    return np.concatenate([[END], w[:-1]]), w, np.repeat(np.arange(len(words)), [len(x) for x in words])  # a text begins after an end


def heavy_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that make up HOT_SHARE of a batch; a pair that makes it up in the corpus does so in some batch."""
    for pdf in batches:
        if len(pdf):
            u, w, _ = tokens_of(pdf)
            pair, many = np.unique(pairs_of(u, w), return_counts=True)
            some = many >= max(HOT_COUNT, HOT_SHARE * pdf["_text"].map(len).sum())
            yield pd.DataFrame({"pair": pair[some].view(np.int64), "many": many[some]})


def is_hot(pair: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which pairs are in hot (ascending): a table of their low bits leaves few to look up."""
    out, mask = np.zeros(len(pair), bool), U((1 << max(16, (16 * len(hot)).bit_length())) - 1)
    if len(hot):
        low = np.zeros(int(mask) + 1, bool)
        low[hot & mask] = True
        some = np.flatnonzero(low[pair & mask])
        out[some] = hot[np.minimum(np.searchsorted(hot, pair[some]), len(hot) - 1)] == pair[some]
    return out


def numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(names, return_inverse=True), without sorting more than the different names."""
    index, names = pd.factorize(names)
    order = np.argsort(names)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return names[order], place[index]


def held_out(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if n else str(i).encode()) % 10 == 0 for i, n in zip(ids.tolist(), null.tolist(), strict=True)], bool)


def send_tokens(n_buckets: int, sent, turn: int, turns: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("_id", kind="stable", ignore_index=True)
            u, w, doc = tokens_of(pdf)
            ids, null, h = pdf["_id"].astype("Int64").fillna(0).to_numpy(np.int64), pdf["_id"].isna().to_numpy(), pdf["_h"].to_numpy(np.int64)
            learnt, pair = ~held_out(ids, null), pairs_of(u, w)
            bucket = (pair % U(n_buckets)).astype(np.min_scalar_type(n_buckets))
            names, wi = numbered(np.append(END, w))
            now = bucket % turns == turn
            pair, bucket, doc, ui, wi = pair[now], bucket[now], doc[now], wi[:-1][now], wi[1:][now]  # a context is the word before
            hot = is_hot(pair, sent.value)
            pair, at, where = np.unique(pair[hot], return_index=True, return_inverse=True)
            hb, hu, hw, hc = bucket[hot][at], ui[hot][at], wi[hot][at], np.bincount(where, learnt[doc[hot]], len(pair)).astype(np.int64)
            order = np.flatnonzero(~hot)
            order = order[np.argsort(bucket[order], kind="stable")]
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows, there = [], np.zeros(len(names), bool)
            for b in np.union1d(bucket[order], hb).tolist():
                own, mine = order[cut[b] : cut[b + 1]], hb == b
                local = [ui[own], wi[own], hu[mine], hw[mine]]
                there[:] = False
                for x in local:
                    there[x] = True
                place = np.cumsum(there, dtype=np.int32) - 1
                docs, many = np.unique(doc[own], return_counts=True)
                keys = np.diff(ids[docs], prepend=0), null[docs] if null.any() else null[:0], h[docs] if h.any() else h[:0]
                rows.append((b, pack(np.diff(names[there], prepend=U(0)), *[small(place[x]) for x in local], small(hc[mine]), small(many), *keys)))
            yield pd.DataFrame(rows, columns=["bucket", "blob"])

    return send


def whole_keys(steps: np.ndarray, null: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(steps)
    return np.cumsum(steps), null if len(null) else np.zeros(n, bool), h if len(h) else np.zeros(n, np.int64)


class Bucket:
    """Tokens of one bucket: their documents, and sections (context, word) with their training customers."""

    def __init__(self, blobs: pd.Series):
        names, local, docs, keys, counts, n, m = [], [[], [], [], []], [], [], [], 0, 0
        for blob in blobs:
            gaps, *four, hot, many, steps, null, h = unpack(blob)
            names.append(np.cumsum(gaps, dtype=np.uint64))
            for x, y in zip(local, four, strict=True):
                x.append(y.astype(np.int64) + m)
            docs.append(np.repeat(np.arange(len(steps)) + n, many))
            keys.append(whole_keys(steps, null, h))
            counts.append(hot.astype(np.int64))
            n, m = n + len(steps), m + len(gaps)
        self.names, index = np.unique(np.concatenate(names), return_inverse=True)
        u, w, hu, hw = (index[np.concatenate(x)] for x in local)
        self.keys, doc = [np.concatenate(x) for x in zip(*keys, strict=True)], np.concatenate(docs)
        held = held_out(*self.keys[:2])
        pair = lambda x, y: x.astype(np.uint64) << U(32) | y.astype(np.uint64)
        pairs, section = np.unique(np.concatenate([pair(u, w), pair(hu, hw)]), return_inverse=True)
        self.section, hot = section[: len(u)], section[len(u) :]
        self.u, self.w = (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)
        self.doc, self.n_docs = doc, n
        self.c = (np.bincount(self.section, ~held[doc], len(pairs)) + np.bincount(hot, np.concatenate(counts), len(pairs))).astype(np.int64)

    def add(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, len(self.names)).astype(np.int64)


FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 12)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    big = np.maximum(n, len(FACTORIALS)).astype(float)
    return np.where(n < len(FACTORIALS), FACTORIALS[np.minimum(n, len(FACTORIALS) - 1)], (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + 1 / (12 * big))


def log_ways(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t), the weight of all ways to seat c customers at t tables with a discount of one half."""
    return log_factorial(2 * c - t - 1) - log_factorial(t - 1) - log_factorial(c - t) - (c - t) * np.log(4)


def seat(rng: np.random.Generator, c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float) -> np.ndarray:
    """Tables of sections with c customers, drawn from their distribution given the other tables of their restaurants and
    the parent's p: S(c, t) p^t prod(strength + DISCOUNT * (others + i), i < t)."""
    few = np.minimum(c, FEW + 1).astype(np.uint8)
    out, order = np.minimum(c, 1), np.argsort(few, kind="stable")
    cut = np.searchsorted(few[order], np.arange(FEW + 2))
    for n in range(2, FEW + 1):
        ways = np.exp(log_ways(np.full(n, n), np.arange(1, n + 1)))
        for k in range(cut[n], cut[n + 1], 1 << 15):
            own = order[k : min(k + (1 << 15), cut[n + 1])]
            new = (strength + DISCOUNT * (others[own] + np.arange(1, n)[:, None])) * (p[own] * (ways[1:] / ways[:-1])[:, None])
            each = np.cumsum(np.concatenate([np.ones((1, len(own))), np.cumprod(new, axis=0)]), axis=0)
            out[own] = 1 + (each < rng.random(len(own)) * each[-1]).sum(axis=0)
    many = order[cut[FEW + 1] :]
    many = many[np.argsort(c[many], kind="stable")]
    for at in np.split(many, np.searchsorted(c[many], [64, 128, 512, 1 << 11, 1 << 13, 1 << 16, 1 << 20])):
        for k in range(0, len(at), 1 << 14):
            own = at[k : k + (1 << 14)]
            out[own] = seat_many(rng, c[own], others[own], p[own], strength)
    return out


def seat_many(rng: np.random.Generator, c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float) -> np.ndarray:
    """seat() for large c: the most likely t is found by halving (the logarithm is concave), then one t is drawn from all
    within twelve deviations of it."""
    low, high = np.ones(len(c), np.int64), c.copy()
    while (low < high).any():
        half = (low + high) // 2
        t = np.minimum(half, c - 1)
        up = (low < high) & (log_ways(c, t + 1) - log_ways(c, t) + np.log((strength + DISCOUNT * (others + t)) * p) > 0)
        low, high = np.where(up, half + 1, low), np.where(up, high, np.minimum(half, high))
    reach = (12 * np.sqrt(low) + 24).astype(np.int64)
    first, last = np.maximum(1, low - reach), np.minimum(c, low + reach)
    t = first[:, None] + np.arange(int((last - first).max()) + 1)
    inside, t = t <= last[:, None], np.minimum(t, last[:, None])
    new = np.log((strength + DISCOUNT * (others[:, None] + t - 1)) * p[:, None])
    new[:, 0] = 0  # common to all t of a section
    logit = np.where(inside, log_ways(c[:, None], t) + np.cumsum(new, axis=1), -np.inf)
    each = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
    return first + (each < (rng.random(len(c)) * each[:, -1])[:, None]).sum(axis=1)


def p_parent(customers: np.ndarray, seated: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The parent's predictive probabilities of words with so many customers at so many of its tables."""
    known, _, every, tables = totals
    base = (PARENT_STRENGTH + DISCOUNT * tables) / (known + 1)
    return (customers - DISCOUNT * seated + base) / (PARENT_STRENGTH + every)


#: What a round writes: `tokens`, `sections` and `state` of a bucket, `words` (a bucket's numbers for a part, the first time
#: with the words' hashes), and of a part its `parent` tables, what it `told` a bucket, its `totals` and, the first time, the
#: `places` of a bucket's words in the part.
ROWS = "kind string, part int, bucket int, names binary, numbers binary"


def rows_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "bucket", "names", "numbers"])


def saved_kinds(df: DataFrame) -> tuple[DataFrame, str]:
    """saved(), with a folder for each kind, so that a kind is read without the others; and the table's path."""
    path = f"{workspace(df.sparkSession)}/relcheck-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns), path


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables of a round that is over; its shuffles go when the JVM finds that nothing refers to them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver's JVM finds that nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
    spark._jvm.System.gc()


def split_words(bucket: int, at: list[np.ndarray], *numbers: np.ndarray, names: np.ndarray | None = None) -> list[tuple]:
    """Rows that carry a bucket's numbers of each word to the parts, which hold the words; at: each part's words."""
    told = lambda own: b"" if names is None else pack(np.diff(names[own], prepend=U(0)))
    return [("words", b, bucket, told(own), pack(*[small(x[own]) for x in numbers])) for b, own in enumerate(at) if len(own)]


def by_part(part: np.ndarray, n_parts: int) -> list[np.ndarray]:
    """For each part the places of its words, ascending."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, n_parts)))


def first_round(n_parts: int, sent):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's tokens and sections, each section with one table."""
        own, bucket = Bucket(pdf["blob"]), int(pdf["bucket"].iloc[0])
        t = np.minimum(own.c, 1)
        many = np.bincount(own.doc, minlength=own.n_docs)
        part = (mixed(own.names) % U(n_parts)).astype(np.min_scalar_type(n_parts))
        pair = pairs_of(own.names[own.u], own.names[own.w])
        hot = np.flatnonzero(is_hot(pair, sent.value))
        head = [
            ("tokens", -1, bucket, pack(hot, pair[hot]), pack(small(own.section), small(many), np.diff(own.keys[0], prepend=0), *[x if x.any() else x[:0] for x in own.keys[1:]])),
            ("sections", -1, bucket, b"", pack(part, small(np.diff(own.u, prepend=0)), small(own.w), small(own.c))),
            ("state", -1, bucket, b"", pack(small(t), np.zeros(len(t), np.float32))),
        ]
        return rows_of(head + split_words(bucket, by_part(part, n_parts), own.add(own.w, own.c), own.add(own.u, t), own.add(own.w, t), names=own.names))

    return count


def seat_parent(step: int, before: np.ndarray | None):
    """Of one part: sums over the buckets, the parent's tables of each word (one, to begin with), and the replies."""

    def seated(pdf: pd.DataFrame) -> pd.DataFrame:
        sent, part = pdf[pdf["kind"] == "words"].sort_values("bucket"), int(pdf["part"].iloc[0])
        if before is None:
            names = [np.cumsum(unpack(b)[0], dtype=np.uint64) for b in sent["names"]]
            every, index = np.unique(np.concatenate(names), return_inverse=True)
            at = np.split(index, np.cumsum([len(x) for x in names])[:-1])
            n, tables, customers = summed(sent, at, len(every))
            t = np.minimum(customers, 1)
        else:
            places = pdf[pdf["kind"] == "places"].sort_values("bucket")
            at = [np.cumsum(unpack(b)[0], dtype=np.int64) for b in places["numbers"]]
            n, t = (x.astype(np.int64) for x in unpack(pdf["numbers"][pdf["kind"] == "parent"].iloc[0]))
            tables, customers = summed(sent, at, len(n))
            p = np.full(len(t), 1 / (before[0] + 1))
            t = seat(np.random.default_rng([1, part, step]), customers, np.maximum(before[3] - t, 0), p, PARENT_STRENGTH)
        totals = np.array([(n > 0).sum(), n.sum(), customers.sum(), t.sum()], float)
        rows = [("parent", part, -1, b"", pack(small(n), small(t))), ("totals", part, -1, b"", pack(totals))]
        if before is None:  # names ascend, so their places do
            rows += [("places", part, b, b"", pack(small(np.diff(own, prepend=0)))) for b, own in zip(sent["bucket"], at, strict=True)]
        rows += [("told", part, b, b"", pack(*[small(x[own]) for x in (n, tables, customers, t)])) for b, own in zip(sent["bucket"], at, strict=True)]
        return rows_of(rows)

    return seated


def summed(sent: pd.DataFrame, at: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The sums of each number of a part's n words over the buckets; at: the places of each bucket's words."""
    numbers, index = [unpack(b) for b in sent["numbers"]], np.concatenate(at)
    return [np.bincount(index, np.concatenate(x), n).astype(np.int64) for x in zip(*numbers, strict=True)]


class Seated:
    """A bucket's sections and seating, and what the parts told it of that seating."""

    def __init__(self, pdf: pd.DataFrame, totals: np.ndarray, n_parts: int, averaged: bool):
        kinds = dict(list(pdf.groupby("kind")))
        self.bucket, own = int(pdf["bucket"].iloc[0]), kinds["sections"].iloc[0]
        part, *numbers = unpack(own["numbers"])
        steps, self.w, self.c = (x.astype(np.int64) for x in numbers)
        self.u = np.cumsum(steps)  # sections are in the order of their contexts
        self.t, self.sum = unpack(kinds["state"]["numbers"].iloc[0])
        self.t = self.t.astype(np.int64)
        self.at, told = by_part(part, n_parts), np.zeros((4, len(part)))
        for b, blob in zip(kinds["told"]["part"], kinds["told"]["numbers"], strict=True):
            for x, y in zip(told, unpack(blob), strict=True):
                x[self.at[b]] = y
        self.n, self.tables = told[:2]
        self.p = p_parent(told[2], told[3], totals)
        if averaged:
            self.sum = self.sum + (self.c - DISCOUNT * self.t + (STRENGTH + DISCOUNT * self.tables[self.u]) * self.p[self.w])
        self.tokens = kinds.get("tokens")

    def add(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, len(self.n)).astype(np.int64)


def next_round(step: int, totals: np.ndarray, n_parts: int):
    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Seated(pdf, totals, n_parts, step > BURN_IN)
        rng = np.random.default_rng([0, own.bucket, step])
        t = seat(rng, own.c, np.maximum(own.tables[own.u] - own.t, 0), own.p[own.w], STRENGTH)
        state = ("state", -1, own.bucket, b"", pack(small(t), own.sum.astype(np.float32)))
        return rows_of([state, *split_words(own.bucket, own.at, own.add(own.u, t), own.add(own.w, t))])

    return sample


#: Sums of a bucket's tokens for the documents of a shard; those of its hot pairs have shard -1.
SHARDS = "shard int, bucket int, blob binary"
SCORES = "_id long, _h long, ends long, tokens long, known long, base double, score double"


def score_tokens(totals: np.ndarray, n_parts: int):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over a bucket's tokens by document, in a row for each shard of documents, and a row of its hot pairs."""
        own = Seated(pdf, totals, n_parts, True)
        n, (known, train) = own.n, totals[:2]
        mean = np.log10(own.sum / (SAMPLES * (STRENGTH + n[own.u])))
        base = np.log10((n + 0.1) / (train + 0.1 * (known + 1)))
        told = own.tokens.iloc[0]
        section, many, *keys = unpack(told["numbers"])
        ids, null, h = whole_keys(*keys)
        doc, token = np.repeat(np.arange(len(many)), many), own.w[section]
        sums = [np.bincount(doc, x, len(many)) for x in (n[token] > 0, base[token], mean[section])]
        columns = ids, null, h, small(sums[0].astype(np.int64)), *sums[1:]
        shard = (mixed(ids.view(np.uint64) ^ h.view(np.uint64)) % U(n_parts)).astype(np.min_scalar_type(n_parts))
        rows = [(k, own.bucket, pack(*[x[at] for x in columns])) for k, at in enumerate(by_part(shard, n_parts)) if len(at)]
        hot, pair = unpack(told["names"])
        if len(hot):
            rows.append((-1, own.bucket, pack(pair, n[own.w[hot]] > 0, base[own.w[hot]], mean[hot])))
        return pd.DataFrame(rows, columns=["shard", "bucket", "blob"])

    return score


def keyed(ids: np.ndarray, null: np.ndarray, h: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"_id": pd.array(ids, "Int64"), "_h": h})
    out.loc[null, "_id"] = pd.NA
    return out


def sum_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a shard: its sums over the buckets."""
    ids, null, h, *sums = (np.concatenate(x) for x in zip(*map(unpack, pdf.sort_values("bucket")["blob"]), strict=True))
    order = np.lexsort((h, null, ids))
    ids, null, h = ids[order], null[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (h[1:] != h[:-1])]))
    known, base, score = (np.add.reduceat(x[order], first, dtype=t) for x, t in zip(sums, (np.int64, float, float), strict=True))
    return keyed(ids[first], null[first], h[first]).assign(ends=0, tokens=0, known=known, base=base, score=score)


def score_hot(pairs):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each row of the documents: its tokens, and sums over those in hot pairs."""
        keys, numbers = pairs.value
        for pdf in batches:
            if len(pdf):
                u, w, doc = tokens_of(pdf)
                pair = pairs_of(u, w)
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hot = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                known, base, mean = (np.bincount(doc[hot], x[at[hot]], len(pdf)) for x in numbers)
                out = pdf[["_id", "_h"]].astype({"_id": "Int64"})
                yield out.assign(ends=1, tokens=np.bincount(doc, minlength=len(pdf)), known=known.astype(np.int64), base=base, score=mean)

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs.

    Texts are learnt unless the crc32 of their id as text leaves 0 modulo 10. Tokens are words, A-Z in lower case, and
    one end for each text; a null text has the end alone. A null id counts as an empty one, so it is held out. Repeated
    rows are learnt and scored once each. score is a log10 probability, perplexity is 10 ** (-score / n_tokens). Other
    columns of docs aren't returned. Empty tables give empty results.
    """
    spark = docs.sparkSession
    base = packed(docs, id_col, text_col).select("_id", "_h", "_text")
    size, rows, ids = base.agg(F.sum(F.octet_length("_text")), F.count(F.lit(1)), F.count_distinct("_id")).first()
    if rows == ids:  # an id is a document: hashes of texts needn't travel with the tokens
        base = base.withColumn("_h", F.lit(0).cast("bigint"))
    size = size or 0
    heavy = base.mapInPandas(heavy_pairs, "pair long, many long").groupBy("pair").agg(F.sum("many").alias("many"))
    hot = heavy.where(F.col("many") >= max(HOT_COUNT, HOT_SHARE * size)).select("pair").collect()
    sent_hot = spark.sparkContext.broadcast(np.sort(np.array([r.pair for r in hot], np.int64).view(np.uint64)))
    n = max(1, size // BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * n)  # few buckets share a task
    first, turns, paths = None, min(n, PASSES), []
    for turn in range(turns):
        sent = base.mapInPandas(send_tokens(n, sent_hot, turn, turns), TOKENS).repartition(tasks, "bucket").groupBy("bucket")
        done, path = saved_kinds(sent.applyInPandas(first_round(n, sent_hot), ROWS))
        paths.append(path)
        first = done if first is None else first.unionByName(done)
        del sent
        free_shuffles(spark)  # the tokens are in the table
    now, parent, totals, old_now, over = first, None, None, None, [f"{x}/kind=words" for x in paths]
    for step in range(BURN_IN + SAMPLES + 1):
        words = now.where("kind = 'words'")
        words = words if parent is None else words.unionByName(parent).unionByName(places)
        told, path = saved_kinds(words.groupBy("part").applyInPandas(seat_parent(step, totals), ROWS))
        drop_tables(spark, over)
        parent, over = told.where("kind = 'parent'"), [path]
        if step == 0:
            places, over = told.where("kind = 'places'"), [f"{path}/kind={x}" for x in ("parent", "told", "totals")]
        totals = np.sum([unpack(r.numbers)[0] for r in told.where("kind = 'totals'").collect()] or [np.zeros(4)], axis=0)
        state = first.where("kind = 'sections'").unionByName(now.where("kind = 'state'")).unionByName(told.where("kind = 'told'"))
        if step < BURN_IN + SAMPLES:
            now, path = saved_kinds(state.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(next_round(step, totals, n), ROWS))
            drop_tables(spark, [old_now] if old_now else [])
            old_now = path
    state, scores = state.unionByName(first.where("kind = 'tokens'")), None
    for turn in range(turns):
        own = state.where(F.col("bucket") % turns == turn).repartition(tasks, "bucket").groupBy("bucket")
        done = saved(own.applyInPandas(score_tokens(totals, n), SHARDS))
        scores = done if scores is None else scores.unionByName(done)
        del own
        free_shuffles(spark)
    found = [unpack(r.blob) for r in scores.where("shard < 0").select("blob").collect()]
    pair, *sums = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.uint64), *np.zeros((3, 0))]
    order = np.argsort(pair)
    sent_pairs = spark.sparkContext.broadcast((pair[order], [x[order].astype(float) for x in sums]))
    sums = scores.where("shard >= 0").repartition(tasks, "shard").groupBy("shard").applyInPandas(sum_shard, SCORES)
    every = sums.unionByName(base.mapInPandas(score_hot(sent_pairs), SCORES))
    total = every.groupBy("_id", "_h").agg(*[F.sum(c).alias(c) for c in ("ends", "tokens", "known", "base", "score")])
    rows = total.select("*", F.explode(F.sequence(F.lit(1), F.col("ends").cast("int"))))
    each = lambda c: (F.col(c) / F.col("ends")).cast("bigint")
    return rows.select(
        F.col("_id").alias(id_col),
        (F.pmod(F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.lit(10)) == 0).alias("held_out"),
        each("tokens").alias("n_tokens"),
        each("known").alias("n_known"),
        F.lit(int(totals[1])).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        (F.col("score") / F.col("ends")).alias("score"),
        F.pow(F.lit(10.0), -F.col("score") / F.col("tokens")).alias("perplexity"),
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
