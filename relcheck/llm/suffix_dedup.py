"""Suffix-array dedup by prefix-free parsing: bytes under a 50-byte string that a document with a smaller id holds too.

Rolling-hash triggers cut the texts into phrases: the trigger of a 50-byte string is the 16 bytes in it whose rolling hash
is least, and the run of strings with one trigger, with the 49 bytes that the last of them reaches beyond, is a phrase.
Phrases overlap by 49 bytes, so each string lies whole in exactly one phrase of the parse; as the corpus order matters to
a depth of 50 bytes only, the order of the dictionary's suffixes decides it, and every place in the parse has its
phrase's ranks. Steps:

1. Triggers are counted: each block of documents sends 32-bit remainders of its triggers' hashes to buckets (no ids, no
   text), each with 16 bits of the hashes of the trigger with the 17 bytes before it and with the 17 bytes after it. Two
   documents that share a 50-byte string share its trigger and one of these 33-byte grams, so only phrases of which a gram
   stands in another document too go on. A false match costs work, never a wrong result.
2. Of such phrases each block sends the hashes of trigger and content and the least id to the trigger's bucket, and learns
   the least id that holds each phrase, and whether its trigger has other phrases too.
3. Dictionary: the texts of phrases with such triggers are sent by the block that has the least id, so once each. Phrases
   of one trigger have their suffixes of 50 bytes sorted; equal neighbours share the least id, and each block learns which
   of its phrases' strings stand in documents with smaller ids. A trigger of very many blocks would make a large bucket:
   its strings travel alone, by their own hashes.
4. Each block marks the bytes and cuts them.

Blocks have about 2 MB of text, buckets a bounded number of triggers on average; both grow in number with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import packed, table
from relcheck.llm.shingles import BYTE, POWERS, STEP, U, mixed

LENGTH = 50
GRAM = 16
#: Bytes on one side of a trigger, of which every 50-byte string around it has as many on the left or on the right.
SIDE = (LENGTH - GRAM) // 2
REACH = LENGTH - GRAM + 1
BLOCK_BYTES = 2 << 20
#: Bytes hashed at a time: few enough for the arrays to stay in a core's cache.
PART_BYTES = 1 << 17
BUCKET_BYTES = 3 << 20
#: Bytes of phrases whose suffixes are sorted at a time.
SORT_BYTES = 1 << 20
#: A trigger that more blocks hold has its strings sent by their own hashes.
HOT_BLOCKS = 256
PLACE = U((1 << 22) - 1)
LAST = np.iinfo(np.int64).max


class Phrases:
    """The phrases of a block's documents: document number, first and last string, trigger hash a, content hash c, and 16
    bits of the hashes of the grams on the trigger's left and right (0: the phrase doesn't reach that far)."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        self.texts, self.ids = texts, ids
        found = [self.segment(docs) for docs in segments(texts)]
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.uint16)] * 2
        self.doc, self.low, self.high, self.a, self.c, self.left, self.right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def segment(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """Phrases of pieces (document, offset, bytes) that are hashed together."""
        raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        size = np.array([len(p[2]) for p in pieces])
        begin = np.cumsum(size) - size
        values, up = BYTE[raw], np.full(1, STEP)
        h = values
        for step in (1, 2, 4, 8):
            h = h[:-step] * up + h[step:]
            up = np.multiply(up, up, dtype=np.uint64) if step < 8 else up
        grams = mixed(h)
        key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: len(key) - (REACH - 32)], key[REACH - 32 :])
        at = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begin, size, strict=True)])
        own = (key[at] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        low, high = at[new], at[np.append(new[1:], len(at)) - 1]
        with np.errstate(over="ignore"):
            pu, pd_ = POWERS.get(len(raw) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * pu[:-1])])
            c = mixed((sums[high + LENGTH] - sums[low]) * pd_[low] + (high - low).astype(np.uint64))
            trigger = own[new]
            gram = lambda at: np.maximum(mixed((sums[at + GRAM + SIDE] - sums[at]) * pd_[at]) >> U(48), U(1)).astype(np.uint16)
            before, after = trigger - SIDE >= low, trigger + GRAM + SIDE <= high + LENGTH
            left = np.where(before, gram(np.where(before, trigger - SIDE, low)), np.uint16(0))
            right = np.where(after, gram(np.where(after, trigger, low)), np.uint16(0))
        piece = np.searchsorted(begin, low, side="right") - 1
        shift = np.array([p[1] for p in pieces])[piece] - begin[piece]
        return np.array([p[0] for p in pieces])[piece], low + shift, high + shift, grams[trigger], c, left, right

    def only(self, keep: np.ndarray) -> None:
        self.doc, self.low, self.high, self.a, self.c = (x[keep] for x in (self.doc, self.low, self.high, self.a, self.c))

    def apart(self, hot: np.ndarray) -> None:
        """Replaces the phrases where hot is true by phrases of one string each, whose trigger is the string."""
        if not hot.any():
            return
        doc, low, high = self.doc[hot], self.low[hot], self.high[hot]
        many = high - low + 1
        first = np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(low, many) + np.arange(many.sum()) - first
        docs = np.repeat(doc, many)
        strings = np.frombuffer(b"".join([self.texts[d][s : s + LENGTH] for d, s in zip(docs, starts, strict=True)]), np.uint8).reshape(-1, LENGTH)
        a, c = np.zeros(len(docs), np.uint64), np.zeros(len(docs), np.uint64)
        for k in range(LENGTH):
            a, c = a * STEP + BYTE[strings[:, k]], c * U(0x9FB21C651E98DF25) + BYTE[strings[:, k]]
        cold = ~hot
        self.doc, self.low, self.high = (np.concatenate([x[cold], y]) for x, y in ((self.doc, docs), (self.low, starts), (self.high, starts)))
        self.a, self.c = np.concatenate([self.a[cold], mixed(a)]), np.concatenate([self.c[cold], mixed(c)])

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrases in order of (a, left, right) and which of them begin new ones."""
        order = np.lexsort((self.right, self.left, self.a))
        changed = lambda x: x[order][1:] != x[order][:-1]
        return order, np.concatenate([[True], changed(self.a) | changed(self.left) | changed(self.right)])[: len(order)]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrases in order of (a, c, id) and which of them begin a new (a, c)."""
        order = np.lexsort((self.ids[self.doc], self.c, self.a))
        a, c = self.a[order], self.c[order]
        return order, np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])[: len(order)]


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about PART_BYTES; longer texts in parts that overlap by 49 bytes."""
    now: list[tuple[int, int, bytes]] = []
    total = 0
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PART_BYTES):
            part = t[at : at + PART_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if total and total + len(part) > PART_BYTES:
                yield now
                now, total = [], 0
            now.append((n, at, part))
            total += len(part)
    if now:
        yield now


def block_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Phrases]:
    pdf = pdf.sort_values(["_id", "_h"], kind="stable", na_position="last").reset_index(drop=True)
    ids = pdf["_id"].astype("Int64").fillna(LAST).to_numpy(np.int64)
    return pdf, Phrases([t.encode("utf-8", "surrogatepass") for t in pdf["_text"]], ids)


def by_bucket(a: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of the sorted a with equal first bits."""
    bucket = (a >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(a) else []
    for x, y in zip(cut[:-1], cut[1:], strict=False):
        yield int(bucket[x]), slice(x, y)


def remainder(a: np.ndarray, bits: int) -> np.ndarray:
    return ((a << U(bits)) >> U(32)).astype(np.uint32)


FIRST = "bucket long, block long, a binary, left binary, right binary, some_left binary, some_right binary"


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by keys (the first matters most, the last isn't part of the group) and where groups begin in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for k in keys[:-1]:
        new |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(np.concatenate([[True], new])[: len(order)])


def several(values: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row whether its group by keys has different values."""
    order, start = groups_of(*keys, values)
    end = np.append(start[1:], len(order)) - 1 if len(order) else start
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(values[order][end] != values[order][start], end - start + 1)
    return out


def send_triggers(bits: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        block, (_, phrases) = int(pdf["block"].iloc[0]), block_of(pdf)
        ids, (order, new) = phrases.ids[phrases.doc], phrases.marks()
        head = order[new]
        a, left, right = phrases.a[head], phrases.left[head], phrases.right[head]
        some = [several(ids, phrases.a, x)[head] for x in (phrases.left, phrases.right)]
        rest = remainder(a, bits)
        rows = [(b, block, rest[s].tobytes(), left[s].tobytes(), right[s].tobytes(), *[np.packbits(x[s]).tobytes() for x in some]) for b, s in by_bucket(a, bits)]
        return pd.DataFrame(rows, columns=["bucket", "block", "a", "left", "right", "some_left", "some_right"])

    return send


REPLY = "block long, bucket long, step int, x binary, y binary"


def bits_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def shared_triggers(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block, a bit for each of its marks: x for those of which a gram stands in another document too, y for those
    whose trigger many blocks hold."""
    size = np.array([len(x) // 4 for x in pdf["a"]])
    read = lambda col, kind: np.concatenate([np.frombuffer(b, kind) for b in pdf[col]])
    a, row = read("a", np.uint32), np.repeat(np.arange(len(pdf)), size)
    keep = np.zeros(len(a), bool)
    for side in ("left", "right"):
        gram = read(side, np.uint16)
        some = np.concatenate([bits_of(b, n) for b, n in zip(pdf[f"some_{side}"], size, strict=True)])
        order, start = groups_of(a, gram, row)
        within = np.repeat(np.bitwise_or.reduceat(some[order], start), np.diff(np.append(start, len(order))))
        some[order] = within
        keep |= (some | several(row, a, gram)) & (gram > 0)
    order, start = groups_of(a, row)
    first = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (a[order][1:] != a[order][:-1])])
    hot = np.zeros(len(a), bool)
    hot[order] = np.repeat(np.add.reduceat(first.astype(np.int64), start) > HOT_BLOCKS, np.diff(np.append(start, len(order))))
    cut = np.cumsum(size)[:-1]
    rows = [(block, bucket, 1, np.packbits(x).tobytes(), np.packbits(y).tobytes()) for block, bucket, x, y in zip(pdf["block"], pdf["bucket"], np.split(keep, cut), np.split(hot, cut), strict=True) if x.any()]
    return pd.DataFrame(rows, columns=["block", "bucket", "step", "x", "y"])


def shared_phrases(phrases: Phrases, replies: pd.DataFrame, bits: int) -> None:
    """Leaves the phrases that may be shared, those of hot triggers string by string."""
    order, new = phrases.marks()
    a, mark = phrases.a[order[new]], np.cumsum(new) - 1
    keep, hot = np.zeros(len(a), bool), np.zeros(len(a), bool)
    told = {b: (x, y) for b, x, y in zip(replies["bucket"], replies["x"], replies["y"], strict=True)}
    for b, s in by_bucket(a, bits):
        if b in told:
            keep[s], hot[s] = (bits_of(x, s.stop - s.start) for x in told[b])
    kept, apart = np.zeros(len(order), bool), np.zeros(len(order), bool)
    kept[order], apart[order] = keep[mark], hot[mark]
    phrases.only(kept)
    phrases.apart(apart[kept])


SECOND = "bucket long, block long, a binary, c binary, id binary"


def send_entries(bits: int):
    def send(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "block", "a", "c", "id"]
        if docs.empty or replies.empty:
            return pd.DataFrame({n: [] for n in names})
        block, (_, phrases) = int(docs["block"].iloc[0]), block_of(docs)
        shared_phrases(phrases, replies, bits)
        order, new = phrases.entries()
        first = order[new]
        a, c, ids = phrases.a[first], phrases.c[first], phrases.ids[phrases.doc[first]]
        return pd.DataFrame([(b, block, a[s].tobytes(), c[s].tobytes(), ids[s].tobytes()) for b, s in by_bucket(a, bits)], columns=names)

    return send


def numbers(pdf: pd.DataFrame, col: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in pdf[col]] or [np.zeros(0, kind)])


def slices(pdf: pd.DataFrame) -> Iterator[tuple[int, int, slice]]:
    """block, bucket and the places of each row's entries among all entries."""
    cut = np.cumsum([0] + [len(x) // 8 for x in pdf["a"]])
    for block, bucket, x, y in zip(pdf["block"], pdf["bucket"], cut[:-1], cut[1:], strict=True):
        yield block, bucket, slice(x, y)


def least_ids(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block, in the order of its entries: x the least id with the phrase, y a bit for each phrase whose trigger has
    other phrases too."""
    a, c, ids = numbers(pdf, "a", np.uint64), numbers(pdf, "c", np.uint64), numbers(pdf, "id", np.int64)
    order, start = groups_of(a, c, ids)
    least = np.empty(len(a), np.int64)
    least[order] = np.repeat(ids[order][start], np.diff(np.append(start, len(order))))
    other = several(c, a)
    rows = [(block, bucket, 2, least[s].tobytes(), np.packbits(other[s]).tobytes()) for block, bucket, s in slices(pdf)]
    return pd.DataFrame(rows, columns=["block", "bucket", "step", "x", "y"])


def told_entries(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What least_ids() told a block of its entries."""
    told = replies[replies["step"] == 2].sort_values("bucket")
    other = [bits_of(y, len(x) // 8) for x, y in zip(told["x"], told["y"], strict=True)]
    return numbers(told, "x", np.int64), np.concatenate(other or [np.zeros(0, bool)])


THIRD = "bucket long, a binary, c binary, least binary, size binary, text binary"


def send_texts(bits: int):
    def send(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "a", "c", "least", "size", "text"]
        if docs.empty or replies.empty:
            return pd.DataFrame({n: [] for n in names})
        _, phrases = block_of(docs)
        shared_phrases(phrases, replies[replies["step"] == 1], bits)
        order, new = phrases.entries()
        least, other = told_entries(replies)
        first = order[new]
        own = other & (phrases.ids[phrases.doc[first]] == least)
        first, least = first[own], least[own]
        texts = [phrases.texts[d][x : y + LENGTH] for d, x, y in zip(phrases.doc[first], phrases.low[first], phrases.high[first], strict=True)]
        a, c = phrases.a[first], phrases.c[first]
        size = (phrases.high[first] - phrases.low[first] + LENGTH).astype(np.uint8)
        rows = [(b, a[s].tobytes(), c[s].tobytes(), least[s].tobytes(), size[s].tobytes(), b"".join(texts[s])) for b, s in by_bucket(a, bits)]
        return pd.DataFrame(rows, columns=names)

    return send


def whole_triggers(mixed_: np.ndarray, trigger: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """mixed_ in parts of about SORT_BYTES of text; phrases of one trigger stay together."""
    slot = np.cumsum(size[mixed_]) // SORT_BYTES
    new = np.concatenate([[True], trigger[mixed_][1:] != trigger[mixed_][:-1]])[: len(mixed_)]
    slot = slot[np.maximum.accumulate(np.where(new, np.arange(len(mixed_)), 0))]  # each in its trigger's first slot
    yield from np.split(mixed_, np.flatnonzero(slot[1:] != slot[:-1]) + 1) if len(mixed_) else []


def smaller_strings(text: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each phrase a bit for each of its strings that a phrase with a smaller least id holds too."""
    bits, strings = np.zeros(len(size), np.uint64), size - LENGTH + 1
    of = np.repeat(np.arange(len(size)), strings)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begin[of] + offset
    up, down = POWERS.get(len(text) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[text] * up[:-1])])
    _, index, many = np.unique((sums[at + LENGTH] - sums[at]) * down[at], return_inverse=True, return_counts=True)
    twice = many[index] > 1  # a string whose hash is alone has no equal
    of, offset, at = of[twice], offset[twice], at[twice]
    if len(at):
        suffix = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]
        suffix = np.ascontiguousarray(suffix).view(f"S{LENGTH}").ravel()
        sort = np.argsort(suffix, kind="stable")  # the suffix array, to the depth that matters
        ranked = suffix[sort]
        group = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])) - 1
        low = np.full(group[-1] + 1, LAST, np.int64)
        np.minimum.at(low, group, least[of[sort]])
        smaller = low[group] < least[of[sort]]
        np.bitwise_or.at(bits, of[sort][smaller], U(1) << offset[sort][smaller].astype(np.uint64))
    return bits


def dictionary(entries: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    """To each block, for those of its entries whose trigger has other phrases: x a bit for each string that stands in a
    document with an id smaller than the phrase's least."""
    names = ["block", "bucket", "step", "x", "y"]
    if entries.empty or sent.empty:
        return pd.DataFrame({n: [] for n in names})
    a, c, least = numbers(sent, "a", np.uint64), numbers(sent, "c", np.uint64), numbers(sent, "least", np.int64)
    size = numbers(sent, "size", np.uint8).astype(np.int64)
    text = np.frombuffer(b"".join(sent["text"]), np.uint8)
    begin = np.cumsum(size) - size
    order, start = groups_of(a, c, np.arange(len(a)))
    head = order[start]  # a phrase comes twice where two documents have its least id
    trigger, bits = a[head], np.zeros(len(head), np.uint64)
    for part in whole_triggers(np.arange(len(head)), trigger, size[head]):
        own = size[head[part]]
        inner = np.cumsum(own) - own
        bits[part] = smaller_strings(text[np.repeat(begin[head[part]] - inner, own) + np.arange(own.sum())], inner, own, least[head[part]])
    ea, ec = numbers(entries, "a", np.uint64), numbers(entries, "c", np.uint64)
    # each entry takes the bits of the phrase that sorts before it in its group of equal (a, c)
    both, groups = groups_of(np.concatenate([trigger, ea]), np.concatenate([c[head], ec]), np.arange(len(head) + len(ea)))
    lead = np.repeat(both[groups], np.diff(np.append(groups, len(both))))
    found = np.zeros(len(both), np.int64)
    found[both] = lead
    mine, other = found[len(head) :], several(ec, ea)
    told = np.where(mine < len(head), bits[np.minimum(mine, len(head) - 1)], U(0))
    rows = [(block, bucket, 3, told[s][other[s]].tobytes(), b"") for block, bucket, s in slices(entries) if other[s].any()]
    return pd.DataFrame(rows, columns=names)


RESULT = "_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_block(bits: int, hashed: bool):
    def cut(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame({n: [] for n in ("_id", "n_bytes", "n_removed", "n_spans", "kept")})
        pdf, phrases = block_of(docs)
        size = np.cumsum([0] + [len(t) for t in phrases.texts])
        gone = np.zeros(size[-1] + 1, bool)
        if not replies.empty:
            shared_phrases(phrases, replies[replies["step"] == 1], bits)
            order, new = phrases.entries()
            least, other = told_entries(replies)
            some = np.zeros(len(least), np.uint64)
            some[other] = numbers(replies[replies["step"] == 3].sort_values("bucket"), "x", np.uint64)
            if len(least) != new.sum():
                raise AssertionError("a block's phrases differ between two passes")
            entry = np.cumsum(new) - 1
            doc, low, high = phrases.doc[order], phrases.low[order], phrases.high[order]
            every = phrases.ids[doc] > least[entry]
            mask = np.where(every, ~U(0), some[entry])
            some = mask > 0
            base, mask, many = size[doc[some]] + low[some], mask[some], (high - low)[some] + 1
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = (np.repeat(base, many) + offset)[(np.repeat(mask, many) >> offset.astype(np.uint64)) & U(1) > 0]
            step = np.bincount(at, minlength=size[-1] + 1) - np.bincount(at + LENGTH, minlength=size[-1] + 1)
            gone = np.cumsum(step) > 0  # strings don't reach beyond their documents
        rows = []
        for n, text in enumerate(phrases.texts):
            own, kept, removed, spans = gone[size[n] : size[n + 1]], text, 0, 0
            if own.any():
                removed, spans = int(own.sum()), int(own[0]) + int((~own[:-1] & own[1:]).sum())
                kept = np.frombuffer(text, np.uint8)[~own].tobytes()
            rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest().encode() if hashed else kept))
        return pd.concat([pdf[["_id"]].astype("Int64"), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])], axis=1)

    return cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (bigint) and kept (binary; the remaining bytes) of every row of docs.

    hashed: kept is the lowercase hex of the remaining bytes' SHA-256 instead. Null text: no bytes. A null id is larger
    than all others; documents with equal ids (repeated rows, null ids) don't remove each other's bytes. Texts under 50
    bytes stay. Other columns of docs aren't returned. Empty tables give empty results.
    """
    base = packed(docs, id_col, text_col).select("_id", "_h", "_text")
    total = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, total // BLOCK_BYTES)
    bits = min(28, max(0, (max(1, total) // BUCKET_BYTES).bit_length()))
    base = base.withColumn("block", F.pmod(F.xxhash64("_id", "_h"), F.lit(blocks)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16)
    own = base.groupBy("block")
    first = own.applyInPandas(send_triggers(bits), FIRST).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(shared_triggers, REPLY)
    entries = own.cogroup(first.groupBy("block")).applyInPandas(send_entries(bits), SECOND).repartition(tasks, "bucket")
    told = first.unionByName(entries.groupBy("bucket").applyInPandas(least_ids, REPLY))
    texts = own.cogroup(told.groupBy("block")).applyInPandas(send_texts(bits), THIRD).repartition(tasks, "bucket")
    third = entries.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(dictionary, REPLY)
    out = own.cogroup(told.unionByName(third).groupBy("block")).applyInPandas(cut_block(bits, hashed), RESULT)
    return out.withColumnRenamed("_id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), hashed=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
