"""N-gram Jaccard join: chosen paths, then exact counts.

Documents with equal sets of 5-word shingles are one class; a class's set has a signature of 64 sampled minima ("tokens"
of the embedded set). A run sends every class to the bucket of one sampled token. A bucket of few classes is compared by
brute force. A larger one has a centre, the most frequent value of each of the 64 tokens (in a bounded sample of its
classes; the centre decides how a bucket is split, never what is found): classes near the centre are linked, and all but
those that nearly are the centre go on to the buckets of tokens which the path samples anew. They are sampled among the
tokens in which a class differs from the centre: what makes a bucket large, a passage that all its texts share, would bring
the same classes together again. Two classes at the threshold of which the less alike one has a share s of the centre have
at least 0.8 - s of their tokens in common that aren't the centre's, and each is sampled with such a probability that
BRANCH of them are expected; that is more than one, so paths of similar sets don't die out with depth, and runs_for() is
the number of runs that reach the target recall at any depth.

Linked classes are contracted: rows carry the label of what they are linked to, and a bucket whose rows have one label is
dropped before anything is joined to it. The links of the first FIRST runs give labels to all others, so a large group of
near copies is dealt out by these runs alone.

What meets with an estimated similarity of 0.6 or more (four deviations below the threshold) is linked for verification
only. Components of these links are then compared exactly, set against set: inside of a pair of blocks the sizes of all
intersections are one matrix product. A block of sets travels as one row to the other blocks of its component, and what
leaves a pair of blocks is one array of counts for each and the links between parts that aren't linked within a block.
A component of n classes costs n * n / 2 comparisons, which is what exact counts of links take, but (n / BLOCK) ** 2 rows.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, packed, same_row, saved, table
from relcheck.llm.graph import components
from relcheck.llm.shingles import U, mixed, shingle_sets

THRESHOLD = 0.8
TOKENS = 64
RECALL = 0.999
#: Child paths that a pair at the threshold shares on average, and the runs whose links are contracted before the others.
BRANCH = 6.0
FIRST = 2
#: Classes in a bucket that are compared by brute force, and levels of splitting.
FEW = 200
LEVELS = 8
#: Estimates: what small buckets link, and what is near a centre or nearly the centre.
NEAR, CENTRAL, SAME = 0.6, 0.6, 0.9
#: Classes that give a bucket's centre, on average.
SAMPLE = 64
#: Rows of small buckets that a task compares at a time, on average.
SLOT_ROWS = 4_000
#: Classes on each side of an exact comparison.
BLOCK = 512
SALT = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
ODD = mixed(SALT) | U(1)


def signature(items: np.ndarray) -> np.ndarray:
    """TOKENS minima, as 32-bit numbers."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 1 << 14):
        low = np.minimum(low, ((items[None, k : k + (1 << 14)] ^ SALT[:, None]) * ODD[:, None]).min(axis=1))
    return (low >> U(32)).astype(np.uint32)


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, sizes, sigs = [], [], []
        for items in shingle_sets(list(pdf["_text"])):
            a, b = mixed(items), mixed(items ^ SALT[0])
            keys.append((int(np.add.reduce(a).view(np.int64)), int(np.add.reduce(b).view(np.int64))) if len(items) else (0, 0))
            sizes.append(len(items))
            sigs.append(signature(items).tobytes())
        one, two = np.array(keys, np.int64).reshape(-1, 2).T
        yield pd.DataFrame({"_id": pdf["_id"], "_h": pdf["_h"], "k1": one, "k2": two, "n": np.array(sizes, np.int64), "sig": sigs})


def matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, TOKENS)


def chance(alike):
    """With which probability a token is sampled by a class that has that share of the centre's."""
    return BRANCH / (TOKENS * np.maximum(THRESHOLD - alike, THRESHOLD - CENTRAL))


def missed(runs: int, splits: int) -> float:
    """The share of pairs at the threshold that no run brings together, where buckets are split so many times around
    centres that are as alike as they can be without linking (CENTRAL), or whose estimate stays under NEAR."""
    share = lambda n: [math.comb(n, k) * THRESHOLD**k * (1 - THRESHOLD) ** (n - k) for k in range(n + 1)]
    each, more = divmod(runs, TOKENS)
    out = 0.0
    for a, p in enumerate(share(more)):
        for b, q in enumerate(share(TOKENS - more)):
            alive = 1.0
            for _ in range(splits):
                alive = 1 - (1 - alive * chance(CENTRAL)) ** max(0.0, a + b - CENTRAL * TOKENS)
            out += p * q * ((1 - alive) ** ((each + 1) * a + each * b) if a + b >= NEAR * TOKENS else 1)
    return out


@functools.cache
def runs_for(recall: float, splits: int = LEVELS) -> int:
    """The fewest runs (up to 16 times TOKENS) that find the share `recall` of pairs at the threshold after so many splits."""
    low, high = 1, 16 * TOKENS
    if missed(high, splits) > 1 - recall:
        raise ValueError(f"a recall of {recall} is out of reach with {TOKENS} sampled minima")
    while low < high:
        half = (low + high) // 2
        low, high = (low, half) if missed(half, splits) <= 1 - recall else (half + 1, high)
    return low


def first_paths(first: int, runs: int):
    """Paths of the runs from first to before `runs`; the number of the run is part of the path."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigs = matrix(pdf["sig"])
            for r in range(first, runs):
                path = mixed(sigs[:, r % TOKENS].astype(np.uint64) + (U(r + 1) << U(32)))
                yield pd.DataFrame({"path": path.view(np.int64), "k1": pdf["k1"], "k2": pdf["k2"], "lab": pdf["lab"]})

    return paths


LINK = "u1 long, u2 long, v1 long, v2 long"


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of the component of each of 0..n-1 under links x - y."""
    root = np.arange(n)
    while True:
        lower = root.copy()
        np.minimum.at(lower, x, root[y])
        np.minimum.at(lower, y, root[x])
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def brute_force(pdf: pd.DataFrame) -> pd.DataFrame:
    """Compares all pairs with different labels within each of many small buckets; each class is linked to the first of
    its group of estimates over NEAR."""
    pdf = pdf.sort_values(["path", "k1", "k2"], ignore_index=True)
    sigs, path, lab, n = matrix(pdf["sig"]), pdf["path"].to_numpy(), pdf["lab"].to_numpy(), len(pdf)
    first, second = [], []
    for d in range(1, FEW):
        at = np.flatnonzero(path[d:] == path[: n - d])
        if not len(at):
            break
        at = at[lab[at] != lab[at + d]]
        for k in range(0, len(at), 1 << 14):
            x = at[k : k + (1 << 14)]
            close = (sigs[x] == sigs[x + d]).sum(axis=1) >= NEAR * TOKENS
            first.append(x[close])
            second.append(x[close] + d)
    root = roots(n, np.concatenate(first), np.concatenate(second)) if first else np.arange(n)
    rest = np.flatnonzero(root != np.arange(n))
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    return pd.DataFrame({"u1": k1[rest], "u2": k2[rest], "v1": k1[root[rest]], "v2": k2[root[rest]]})


def centre(pdf: pd.DataFrame) -> pd.DataFrame:
    """The most frequent value of each token in a sample of a bucket, and the class that is most alike to it, if near."""
    pdf = pdf.sort_values(["k1", "k2"], ignore_index=True)
    sigs, mode = matrix(pdf["sig"]), np.zeros(TOKENS, np.uint32)
    for i in range(TOKENS):
        values, many = np.unique(sigs[:, i], return_counts=True)
        mode[i] = values[np.argmax(many)]
    alike = (sigs == mode).mean(axis=1)
    x = pdf.iloc[[int(np.argmax(alike))]]
    own = x[["k1", "k2", "lab"]].to_numpy()[0] if alike.max() >= CENTRAL else [None] * 3
    return pd.DataFrame([(x["path"].iloc[0], mode.tobytes(), *own)], columns=["path2", "mode", "p1", "p2", "plab"]).astype({c: "Int64" for c in ("p1", "p2", "plab")})


SPLIT = "path long, k1 long, k2 long, lab long, p1 long, p2 long"


def split_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large buckets with their centres: new links to the central class (path null), and the next paths of the
    classes that aren't nearly the centre. What is linked to the central class takes its label."""
    for pdf in batches:
        sigs, modes, paths = matrix(pdf["sig"]), matrix(pdf["mode"]), pdf["path"].to_numpy().view(np.uint64)
        alike, lab, plab = (sigs == modes).mean(axis=1), pdf["lab"].to_numpy(), pdf["plab"].astype("Int64").fillna(0).to_numpy(np.int64)
        near = (alike >= CENTRAL) & pdf["p1"].notna().to_numpy()
        x = pdf.iloc[np.flatnonzero(near & (lab != plab))]
        yield pd.DataFrame({"path": pd.array([None] * len(x), "Int64"), "k1": x["k1"], "k2": x["k2"], "lab": x["plab"], "p1": x["p1"], "p2": x["p2"]}).astype({c: "Int64" for c in ("lab", "p1", "p2")})
        lab, rest = np.where(near, plab, lab), np.flatnonzero(alike < SAME)
        limit = (np.minimum(chance(alike[rest]), 1 - 1e-9) * 2.0**64).astype(np.uint64)
        for i in range(TOKENS):
            go = rest[(mixed(paths[rest] ^ SALT[i]) < limit) & (sigs[rest, i] != modes[rest, i])]
            path = mixed(paths[go] * ODD[i] + sigs[go, i].astype(np.uint64))
            none = pd.array([None] * len(go), "Int64")
            yield pd.DataFrame({"path": pd.array(path.view(np.int64), "Int64"), "k1": pdf["k1"].to_numpy()[go], "k2": pdf["k2"].to_numpy()[go], "lab": lab[go], "p1": none, "p2": none})


def shared_paths(rows: DataFrame) -> DataFrame:
    """rows (path, k1, k2, lab) of paths on which different labels meet, with the number of rows as `many`."""
    many = rows.groupBy(F.col("path").alias("path2")).agg(F.count(F.lit(1)).alias("many"), F.min("lab").alias("lo"), F.max("lab").alias("hi"))
    return rows.join(many.where("lo <> hi").drop("lo", "hi"), F.col("path") == F.col("path2")).drop("path2")


def run_links(classes: DataFrame, first: int, runs: int) -> DataFrame:
    """Links u, v (structs k1, k2) that the runs from first to before `runs` find between classes of different labels."""
    own = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "sig")
    rows, found = saved(classes.mapInPandas(first_paths(first, runs), "path long, k1 long, k2 long, lab long")), []
    for level in range(LEVELS):
        met = shared_paths(rows)
        met = saved(met.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select("path", "k1", "k2", "lab", "sig", "many"))
        few = met.where(F.col("many") <= FEW)
        n_few, n_met = met.agg(F.count_if(F.col("many") <= FEW), F.count(F.lit(1))).first()
        slots = max(1, n_few // SLOT_ROWS)
        found.append(few.groupBy(F.pmod(F.xxhash64("path"), F.lit(slots)).alias("slot")).applyInPandas(brute_force, LINK))
        large = met.where(F.col("many") > FEW)
        if n_few == n_met:
            break
        if level == LEVELS - 1:  # linked for verification, whatever they are
            least = large.groupBy(F.col("path").alias("path2")).agg(F.min(key("k1", "k2")).alias("v"))
            found.append(large.join(least, F.col("path") == F.col("path2")).select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("v.k1").alias("v1"), F.col("v.k2").alias("v2")))
            break
        unit = F.pmod(F.xxhash64("path", "k1", "k2"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        centres = large.where(unit * F.col("many") < SAMPLE).groupBy("path").applyInPandas(centre, "path2 long, mode binary, p1 long, p2 long, plab long")
        told = large.join(centres, F.col("path") == F.col("path2"), "left").withColumn("mode", F.coalesce("mode", F.lit(bytearray(4 * TOKENS))))
        done = saved(told.select("path", "k1", "k2", "lab", "sig", "mode", "p1", "p2", "plab").mapInPandas(split_once, SPLIT))
        found.append(done.where("path is null").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("p1").alias("v1"), F.col("p2").alias("v2")))
        rows = done.where("path is not null").select("path", "k1", "k2", "lab")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return saved(out.select(key("u1", "u2").alias("u"), key("v1", "v2").alias("v")))


def key(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))


def candidate_groups(classes: DataFrame, recall: float) -> DataFrame:
    """node, label (structs k1, k2): the components of classes that met with an estimate of NEAR or more."""
    runs = runs_for(recall)
    first = run_links(classes.withColumn("lab", F.col("k1")), 0, min(FIRST, runs))
    labels = saved(first.groupBy(F.col("u.k1").alias("c1"), F.col("u.k2").alias("c2")).agg(F.min("v.k1").alias("l1")))
    told = classes.join(labels, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    more = run_links(saved(told.select("k1", "k2", "sig", F.coalesce("l1", "k1").alias("lab"))), min(FIRST, runs), runs)
    return components(first.unionByName(more))


def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="_text").assign(items=[x.tobytes() for x in shingle_sets(list(pdf["_text"]))])


COUNTS = "k1 long, k2 long, links long, classes long, r1 long, r2 long"


def common_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of left's sets with right's, as a sum of matrix products."""
    values, where, many = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    shared = many[where] > 1
    number = np.cumsum(many > 1) - 1
    where, row, n_values = number[where[shared]], row[shared], int((many > 1).sum())
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 1 << 12
    for k in range(0, n_values, width):
        a, b = np.searchsorted(where, (k, k + width))
        dense = np.zeros((len(left) + len(right), min(width, n_values - k)), np.float32)
        dense[row[a:b], where[a:b] - k] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in left, place in right) of sets with that Jaccard similarity or more."""
    common = common_sizes(left, right)
    either = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    return np.nonzero(common >= threshold * either - 1e-6)


def within_sets(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """linked_pairs() of sets with each other, each pair once."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        at = np.arange(int(n >= threshold * (len(sets[0]) + len(sets[1]) - n) - 1e-6))
        return at, at + 1
    x, y = linked_pairs(sets, sets, threshold)
    return x[x < y], y[x < y]


def tallied(n: int, x: np.ndarray, y: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of 0..n-1 the documents and the classes it is linked to."""
    links = np.bincount(x, many[y], n) + np.bincount(y, many[x], n)
    return links.astype(np.int64), np.bincount(x, minlength=n) + np.bincount(y, minlength=n)


def sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in pdf["items"]]


def compare_small(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many components of at most BLOCK classes."""
        pdf = pdf.drop_duplicates(["k1", "k2"]).sort_values(["l1", "l2", "k1", "k2"], ignore_index=True)
        sets, l1, l2 = sets_of(pdf), pdf["l1"].to_numpy(), pdf["l2"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (l1[1:] != l1[:-1]) | (l2[1:] != l2[:-1]), [True]]))
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x, y = within_sets(sets[a:b], threshold)
            first.append(x + a)
            second.append(y + a)
        x, y = np.concatenate(first), np.concatenate(second)
        root = roots(len(pdf), x, y)
        links, classes = tallied(len(pdf), x, y, pdf["many"].to_numpy())
        k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
        return pd.DataFrame({"k1": k1, "k2": k2, "links": links, "classes": classes, "r1": k1[root], "r2": k2[root]})

    return compare


BLOCKS = "l1 long, l2 long, blocks int, block int, blob binary, counts binary"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def as_block(threshold: float):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """The classes of one block of a large component as one row: blob with their sets, keys, sizes and roots within
        the block, counts with the links within it."""
        pdf = pdf.drop_duplicates(["k1", "k2"]).sort_values(["k1", "k2"], ignore_index=True)
        sets, many = sets_of(pdf), pdf["many"].to_numpy()
        x, y = within_sets(sets, threshold)
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        head = pdf.iloc[[0]][["l1", "l2", "blocks", "block"]].reset_index(drop=True)
        blob = pack(values, where.astype(np.uint32), np.array([len(s) for s in sets]), pdf["k1"].to_numpy(), pdf["k2"].to_numpy(), many, roots(len(pdf), x, y))
        return head.assign(blob=[blob], counts=[pack(*tallied(len(pdf), x, y, many))])

    return build


CROSS = "l1 long, l2 long, block int, counts binary, u1 long, u2 long, v1 long, v2 long"


def compare_blocks(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Two blocks of a large component: counts for each, and one link for each two parts (classes with one root within
        their block) that are linked."""
        if len(pdf) < 2:  # the other block has no classes
            return pd.DataFrame({c.split()[0]: [] for c in CROSS.split(", ")})
        pdf = pdf.sort_values("block", ignore_index=True)
        (va, wa, na, *left), (vb, wb, nb, *right) = (unpack(b) for b in pdf["blob"])
        x, y = linked_pairs(np.split(va[wa], np.cumsum(na)[:-1]), np.split(vb[wb], np.cumsum(nb)[:-1]), threshold)
        n, many = len(na), np.concatenate([left[2], right[2]])
        links, classes = tallied(n + len(nb), x, y + n, many)
        roots_ = np.unique(np.stack([left[3][x], right[3][y]], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        counts = [pack(links[s], classes[s]) for s in (slice(n), slice(n, None))]
        out = pdf[["l1", "l2", "block"]].assign(counts=counts)
        parts = pd.DataFrame({"l1": pdf["l1"].iloc[0], "l2": pdf["l2"].iloc[0], "block": -1, "counts": None, "u1": left[0][roots_[:, 0]], "u2": left[1][roots_[:, 0]], "v1": right[0][roots_[:, 1]], "v2": right[1][roots_[:, 1]]})
        whole = {c: "Int64" for c in ("u1", "u2", "v1", "v2")}
        return pd.concat([out.assign(u1=pd.NA, u2=pd.NA, v1=pd.NA, v2=pd.NA).astype(whole), parts.astype(whole)])

    return compare


def add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's counts over all pairs it was in; each class with its root within the block."""
    _, _, _, k1, k2, _, root = unpack(pdf["blob"].dropna().iloc[0])
    links, classes = (sum(x) for x in zip(*(unpack(b) for b in pdf["counts"]), strict=True))
    return pd.DataFrame({"k1": k1, "k2": k2, "links": links, "classes": classes, "r1": k1[root], "r2": k2[root]})


def exact_counts(base: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """COUNTS of members (k1, k2, l1, l2, size, many, _id2, _h2): r1, r2 is the least class each is joined to."""

    def sets(some: DataFrame) -> DataFrame:
        met = join_small(base, some, same_row(base, some), "inner").drop("_id", "_h", "_id2", "_h2")
        return met.mapInPandas(as_sets, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name != "_text") + ", items binary")

    small, large = F.col("size") <= BLOCK, saved(members.where(F.col("size") > BLOCK))
    packs = max(1, members.where(small).count() // 500)
    tasks = max(packs, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = sets(members.where(small)).withColumn("pack", F.pmod(F.xxhash64("l1", "l2"), F.lit(packs)))
    out = saved(narrow.repartition(tasks, "pack").groupBy("pack").applyInPandas(compare_small(threshold), COUNTS))
    if not large.limit(1).count():
        return out
    wide = sets(large).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    wide = wide.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    wide = saved(wide.groupBy("l1", "l2", "block").applyInPandas(as_block(threshold), BLOCKS))
    met = wide.drop("counts").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    met = met.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    cross = saved(met.drop("other", "blocks").groupBy("l1", "l2", "bi", "bj").applyInPandas(compare_blocks(threshold), CROSS))
    each = wide.select("l1", "l2", "block", "blob", "counts").unionByName(cross.where("block >= 0").select("l1", "l2", "block", F.lit(None).cast("binary").alias("blob"), "counts"))
    each = saved(each.groupBy("l1", "l2", "block").applyInPandas(add_counts, COUNTS))
    links = each.select(key("k1", "k2").alias("u"), key("r1", "r2").alias("v"))
    groups = components(links.unionByName(cross.where("block < 0").select(key("u1", "u2").alias("u"), key("v1", "v2").alias("v"))))
    groups = groups.select(F.col("node.k1").alias("n1"), F.col("node.k2").alias("n2"), "label")
    each = each.join(groups, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    return out.unionByName(each.select("k1", "k2", "links", "classes", F.coalesce("label.k1", "r1").alias("r1"), F.coalesce("label.k2", "r2").alias("r2")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """_id, _h (the document), class_id (the least id among those joined by links), n_links (other documents at the
    threshold or over, copies included), n_link_classes (different shingle sets among them), n_copies, first (whether it
    is the one document of its class that would stay: the least by (id, hash of the text)).

    Words are runs of bytes other than white space; a text of under five words is one shingle; texts without words (null,
    empty) have no links, but are one class of equal sets. Repeated rows are one document. A null id comes before others; a class
    holding one has class_id null. Empty tables give empty results.
    """
    base = packed(docs, id_col, text_col).select("_id", "_h", "_text")
    sigs = saved(base.mapInPandas(signed, "_id long, _h long, k1 long, k2 long, n long, sig binary").distinct())
    every = sigs.groupBy("k1", "k2", "n").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("_id", "_h", "sig")).alias("rep"))
    every = saved(every.select("k1", "k2", "n", "many", F.col("rep._id").alias("_id2"), F.col("rep._h").alias("_h2"), "rep.sig"))
    classes = every.where("n > 0").drop("n")
    groups = candidate_groups(classes.select("k1", "k2", "sig"), recall)
    sized = groups.groupBy(F.col("label").alias("label2")).agg(F.count(F.lit(1)).alias("size"))
    groups = groups.join(sized, F.col("label") == F.col("label2")).select("node.k1", "node.k2", F.col("label.k1").alias("l1"), F.col("label.k2").alias("l2"), "size")
    members = saved(groups.join(classes.drop("sig"), ["k1", "k2"]))
    total = exact_counts(base, members, threshold).select("k1", "k2", "links", "classes", key("r1", "r2").alias("root"))
    told = every.drop("sig", "n").join(total, ["k1", "k2"], "left").withColumn("root", F.coalesce("root", key("k1", "k2")))
    told = saved(told.withColumn("rep", F.struct("_id2", "_h2")).drop("_id2", "_h2"))
    heads = told.groupBy(F.col("root").alias("root2")).agg(F.min("rep").alias("head"))
    told = told.join(heads, F.col("root") == F.col("root2")).select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), "many", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("classes", F.lit(0)).alias("classes"), "head"
    )
    told = saved(told)
    out = join_small(sigs.drop("sig"), told, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    none = F.col("n") == 0
    first = F.col("_id").eqNullSafe(F.col("head._id2")) & (F.col("_h") == F.col("head._h2"))
    return out.select(
        "_id",
        "_h",
        F.col("head._id2").alias("class_id"),
        F.when(none, 0).otherwise(F.col("links") + F.col("many") - 1).cast("bigint").alias("n_links"),
        F.when(none, 0).otherwise(F.col("classes")).cast("bigint").alias("n_link_classes"),
        F.when(none, 0).otherwise(F.col("many") - 1).cast("bigint").alias("n_copies"),
        first.alias("first"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which each class keeps one document: the least by (id, hash of the text).

    All columns stay as they are; repeated rows of a kept document all stay. The rest is as in near_duplicates().
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = saved(found.where(~F.col("first")).select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")))
    base = packed(docs, id_col, text_col)
    return join_small(base, gone, same_row(base, gone), "left_anti").select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_link_classes", "n_copies")
