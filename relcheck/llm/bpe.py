"""BPE encoding and decoding with reuse of content-defined chunks.

Each text is cut where a rolling hash over its last 16 bytes has ten bits set, so that a passage is cut alike wherever it
stands. Chunks are counted by their digests; a chunk that stands in several places is encoded once, by the document where
it stands first, and its ids are joined to all its places. What lies between shared chunks is encoded where it is. The
joins are then repaired: text around a join is encoded again, wider and wider, until what is encoded on either side of
the join ends and begins exactly as the pieces' own ids do.

Equal texts are one document here: one of them is encoded, and all get its result.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, packed, saved, table
from relcheck.llm.shingles import BYTE, PART_BYTES, U, mixed

WINDOW = 16
#: A chunk has 1024 bytes on average.
CUT_BITS = U(0x3FF)
#: Bytes, about, that a Python worker spends on remembering the ids of pieces over all its tasks, and the longest piece it
#: remembers; others are remembered for a batch.
MEMO_BYTES = 96 << 20
MEMO_LONGEST = 64
#: What an entry takes beside its texts.
ENTRY_BYTES = 320
#: Pieces encoded in one text.
TOGETHER = 2000
#: Characters on each side that a join's repair starts with, and the most it tries; then the text is encoded outright.
MARGIN = 48
WIDEST = 4096
#: Characters of texts that are encoded at once.
BATCH_CHARS = 1 << 20


def cuts(raw: bytes) -> list[int]:
    """Where the chunks of a UTF-8 text end, its end included: after windows whose hash has its low bits set."""
    if len(raw) <= WINDOW:
        return [len(raw)]
    found: list[int] = []
    for at in range(0, len(raw), PART_BYTES):
        part = np.frombuffer(raw, np.uint8)[at : at + PART_BYTES + WINDOW]
        h = BYTE[part]
        for step in (1, 2, 4, 8):
            if len(h) > step:
                h = mixed(h[:-step] * U(3) + h[step:] * U(5)) if step == 8 else h[:-step] * U(0xD1342543DE82EF95) + h[step:]
        ends = np.flatnonzero((h & CUT_BITS) == CUT_BITS) + WINDOW
        ends = ends[ends < len(part)]
        ends = ends[(part[ends] & 0xC0) != 0x80]  # not inside of a character
        found += (ends + at).tolist()
    return sorted({*found, len(raw)})


def chunks(text: str) -> list[str]:
    raw, out, a = text.encode(), [], 0
    for b in cuts(raw):
        out.append(raw[a:b].decode())
        a = b
    return out


def digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def splits_at_space(config: dict) -> bool:
    """Whether ids of a text are those of its parts between spaces and newlines: such a tokenizer drops white space and
    looks at nothing across it."""
    before = config.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    pattern = steps[0].get("pattern", {}).get("Regex", "") if drops else ""
    normal = config.get("normalizer") or {}
    kinds = {x.get("type") for x in normal.get("normalizers", [normal])}
    plain = all(not (x["lstrip"] or x["rstrip"] or x["normalized"] or " " in x["content"]) for x in config.get("added_tokens", []))
    return drops and " " not in pattern and r"[^\s" in pattern and kinds <= {None, "NFC", "Replace", "Lowercase"} and plain and config.get("post_processor") is None


class Codec:
    """A tokenizer of a file, with the ids of recent pieces at hand."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.pieces, self.spaced = splits_at_space(config), config.get("decoder") is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)] if self.spaced else []
        self.numbers = [str(i) for i in range(size)]
        self.memo: dict[str, tuple[int, str, str]] = {"": (0, "", "")}
        self.recent: dict[str, tuple[int, str, str]] = {}
        self.room = MEMO_BYTES

    def learn(self, texts: list[str]) -> None:
        """Encodes the pieces of texts that aren't known, many in one text. Per piece: number of ids, ids, names."""
        self.recent = {}
        new = [p for p in {p for t in texts for p in t.replace("\n", " ").split(" ")} if p not in self.memo]
        if not new:
            return
        texts = [" ".join(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)]
        for k, e in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            own = new[k * TOGETHER : (k + 1) * TOGETHER]
            starts = np.cumsum([0, *[len(p) + 1 for p in own]])
            at = np.searchsorted([x for x, _ in e.offsets], starts).tolist()  # where each piece's tokens begin
            ids = e.ids
            told = list(map(self.numbers.__getitem__, ids))
            names = list(map(self.names.__getitem__, ids)) if self.spaced else []
            for p, x, y in zip(own, at, at[1:], strict=False):
                entry = (y - x, " ".join(told[x:y]), " ".join(names[x:y]))
                if self.room > 0 and len(p) <= MEMO_LONGEST:
                    self.memo[p] = entry
                    self.room -= ENTRY_BYTES + 2 * len(p) + len(entry[1]) + 2 * len(entry[2])
                else:
                    self.recent[p] = entry

    def ids(self, text: str) -> list[int]:
        if not self.pieces:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        self.learn([text])
        return [int(i) for x in self.told(text) for i in x[1].split()]

    def told(self, text: str) -> list[tuple[int, str, str]]:
        """What is known of the pieces of a text that was learnt."""
        known, recent = self.memo.get, self.recent
        return [known(p) or recent[p] for p in text.replace("\n", " ").split(" ")]

    def decoded(self, ids: Sequence[int]) -> str:
        return " ".join([self.names[i] for i in ids]) if self.spaced else self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number, decimal ids and decoded text, of whole texts."""
        if not (self.pieces and self.spaced):
            every = [self.ids(t) for t in texts]
            return [(len(x), " ".join(map(str, x)), self.decoded(x)) for x in every]
        self.learn(texts)
        out = []
        for t in texts:
            found = [x for x in self.told(t) if x[0]]
            out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def join_onto(self, text: str, p: int, q: int, ids: array, more: array) -> bool:
        """Extends ids, those of text[:p], by more, those of text[p:q]. Only what lies around the join is encoded again, and
        only the end of ids changes. False: no agreement within WIDEST characters; ids is as it was."""
        if p == 0 or p == q:
            ids.extend(more)
            return True
        margin = MARGIN
        while margin <= WIDEST:
            a, b = before_space(text, p - margin, p - 2 * WIDEST), after_word(text, p + margin, q, p + 2 * WIDEST)
            if a is None or b is None:
                return False
            tail, head, both = (array("I", self.ids(t)) for t in (text[a:p], text[p:b], text[a:b]))
            kept = len(ids) - len(tail)
            outer = (a == 0 or both[:1] == tail[:1]) and (b == q or both[-1:] == head[-1:])
            if outer and kept >= 0 and ids[kept:] == tail and more[: len(head)] == head and (a > 0 or kept == 0) and (b < q or len(head) == len(more)):
                del ids[kept:]
                ids.extend(both)
                ids.extend(more[len(head) :])
                return True
            if a == 0 and b == q:
                del ids[:]
                ids.extend(both)
                return True
            margin *= 2
        return False


def worker_codec(path: str) -> Codec:
    """The codec of this Python worker: Spark runs many tasks in one worker, and what it has encoded stays known."""
    kept = sys.modules.setdefault("relcheck_codecs", types.ModuleType("relcheck_codecs"))
    if path not in vars(kept):
        setattr(kept, path, Codec(path))
    return getattr(kept, path)


def before_space(text: str, at: int, least: int) -> int | None:
    """The last place up to at where a space or newline follows another character; 0 if there is none, None if that isn't
    known before `least`."""
    while at > 0 and not (text[at] in " \n" and text[at - 1] not in " \n"):
        at -= 1
        if at < least:
            return None
    return max(at, 0)


def after_word(text: str, at: int, end: int, most: int) -> int | None:
    """The first such place from at on; end if there is none, None if that isn't known up to `most`."""
    while at < end and not (text[at] in " \n" and text[at - 1] not in " \n"):
        at += 1
        if at > most:
            return None
    return min(at, end)


def chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(h, g, n, digest(c)) for h, g, t in zip(pdf["_h"], pdf["_g"], pdf["_text"], strict=True) for n, c in enumerate(chunks(t))]
        yield pd.DataFrame(rows, columns=["_h", "_g", "seq", "d"])


def publisher(path: str, wide: bool):
    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(path)
        for pdf in batches:
            rows = []
            for text, uses in zip(pdf["_text"], pdf["uses"], strict=True):
                own = chunks(text)
                rows += [(u["d"], np.array(codec.ids(own[u["seq"]]), np.uint32 if wide else np.uint16).tobytes()) for u in uses if u["own"]]
            yield pd.DataFrame(rows, columns=["d", "ids"])

    return publish


RESULT = "_h long, _g long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def result(keys: pd.DataFrame, told: list[tuple[int, str, str]], full: bool) -> pd.DataFrame:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = keys.assign(n_tokens=[n for n, _, _ in told], ids_sha256=[sha(s) for _, s, _ in told], decoded_sha256=[sha(s) for _, _, s in told])
    return out.assign(ids=[[int(x) for x in s.split()] for _, s, _ in told], decoded=[s for _, _, s in told]) if full else out


def encoder(path: str, wide: bool, full: bool):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(path)
        for pdf in batches:
            sizes = pdf["_text"].str.len().to_numpy()
            for own in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_CHARS)) + 1):
                part = pdf.iloc[own]
                if len(part):
                    told = codec.digests(list(part["_text"])) if "given" not in part else [whole(codec, t, g, wide) for t, g in zip(part["_text"], part["given"], strict=True)]
                    yield result(part[["_h", "_g"]], told, full)

    return encode


def whole(codec: Codec, text: str, given, wide: bool) -> tuple[int, str, str]:
    """A text of which some chunks' ids are given; the chunks in between are encoded in runs. The time grows with the text:
    a join changes the end of the ids only, and a text whose joins don't agree is encoded outright."""
    known = {g["seq"]: array("I", np.frombuffer(g["ids"], np.uint32 if wide else np.uint16).astype(np.uint32).tobytes()) for g in given}
    runs: list[tuple[int, int, int | None]] = []  # start, end, number of the known chunk
    at = 0
    for n, c in enumerate(chunks(text)):
        if n in known:
            runs.append((at, at + len(c), n))
        elif runs and runs[-1][2] is None:
            runs[-1] = (runs[-1][0], at + len(c), None)
        else:
            runs.append((at, at + len(c), None))
        at += len(c)
    ids = array("I")
    for p, q, n in runs:
        if not codec.join_onto(text, p, q, ids, array("I", codec.ids(text[p:q])) if n is None else known[n]):
            return codec.digests([text])[0]
    return len(ids), " ".join(map(str, ids)), codec.decoded(ids)


def encode_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; with full also ids (array) and decoded.

    path: a file of the tokenizers library that every executor has. Special tokens are found in texts but not added, as
    encode(add_special_tokens=False) does; truncation and padding are off. Null text: as an empty one, no tokens. Null
    ids, repeated rows and copies of a text get a row each. Other columns of docs aren't returned. Empty tables give
    empty results.
    """
    codec = Codec(path)
    wide = codec.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
    schema = RESULT + (", ids array<int>, decoded string" if full else "")
    base = packed(docs, id_col, text_col).select("_id", "_h", F.xxhash64(F.lit(7), "_text").alias("_g"), "_text")
    # Of the documents with one text only that with the least id goes on; dropDuplicates ends what repeated rows double.
    first = base.groupBy("_h", "_g").agg(F.min("_id").alias("_id2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = saved(first.select(F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_id2"))
    same = (base["_h"] == copies["_h2"]) & (base["_g"] == copies["_g2"])
    texts = join_small(base, copies, same & ~base["_id"].eqNullSafe(copies["_id2"]), "left_anti").drop("_id")

    cut = saved(texts.mapInPandas(chunk_rows, "_h long, _g long, seq int, d binary"))
    shared = cut.groupBy(F.col("d").alias("d2")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_h", "_g", "seq")).alias("owner")).where("n > 1")
    used = cut.join(shared, F.col("d") == F.col("d2"))
    used = saved(used.select("_h", "_g", "seq", "d", (F.struct("_h", "_g", "seq") == F.col("owner")).alias("own")))
    uses = used.groupBy(F.col("_h").alias("_h2"), F.col("_g").alias("_g2")).agg(F.collect_list(F.struct("seq", "d", "own")).alias("uses"))
    uses = saved(uses)
    same = lambda x: (texts["_h"] == x["_h2"]) & (texts["_g"] == x["_g2"])
    owners = saved(uses.where(F.exists("uses", lambda u: u.own)))
    published = join_small(texts, owners, same(owners), "inner").mapInPandas(publisher(path, wide), "d binary, ids binary")
    published = saved(published.dropDuplicates(["d"]).withColumnRenamed("d", "d2"))
    given = used.join(published, F.col("d") == F.col("d2")).groupBy(F.col("_h").alias("_h2"), F.col("_g").alias("_g2"))
    given = given.agg(F.collect_list(F.struct("seq", "ids")).alias("given"))
    keys = uses.select("_h2", "_g2")
    alone = join_small(texts, keys, same(keys), "left_anti").mapInPandas(encoder(path, wide, full), schema)
    some = join_small(texts, keys, same(keys), "left_semi").alias("t")
    some = some.join(given.alias("g"), (F.col("t._h") == F.col("g._h2")) & (F.col("t._g") == F.col("g._g2"))).select("_h", "_g", "_text", "given")
    done = saved(alone.unionByName(some.mapInPandas(encoder(path, wide, full), schema)).dropDuplicates(["_h", "_g"]))
    done = done.withColumnsRenamed({"_h": "_h2", "_g": "_g2"})
    told = join_small(base.drop("_text"), done, (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2")), "left")
    return told.select(F.col("_id").alias(id_col), *[c for c in done.columns if c not in ("_h2", "_g2")])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
