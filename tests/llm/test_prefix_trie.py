"""The trie against plain Python, on odd tables and by its SQL."""

import collections
import hashlib
import random
import re
import zlib

from relcheck.llm import prefix_trie
from relcheck.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_op13_equals_sql(same_as_sql):
    same_as_sql(QUERIES["op13_prefix_trie"], ORACLE_SQL["op13_prefix_trie"])


def by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children = collections.Counter(n[:-1] for n in members if n)
    value = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    leaves, tokens = collections.Counter(), collections.Counter()
    for n in members:
        for d in range(len(n) + 1):
            tokens[n[:d]] += value[n]
            leaves[n[:d]] += children[n] == 0
    least = {n: min(c for c, _ in m) for n, m in members.items()}
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return collections.Counter((least[n], len(n), least[n[:-1]] if n else None, len(m), children[n], leaves[n], tokens[n], sha(m)) for n, m in members.items())


def trie_of(spark, rows):
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == COLUMNS
    return collections.Counter(tuple(r) for r in out.collect())


def test_odd_conversations(spark):
    dice = random.Random(9)
    turn = lambda: (dice.choice(["user", "assistant", None]), dice.choice(["hi", "what is  this", "", None, "a b\nc"]))
    rows = [(c, t, *turn(), 1, "x") for c in range(-25, 90) for t in range(dice.randrange(6)) if c % 7 != 3]
    rows += [(c, None, "user", "null turn", 1, "x") for c in (3, 4, 20, 45)] + [(None, 0, "user", "hi", 1, "x")]
    rows += [(200, t, "user", f"w{t}", 1, "x") for t in range(300)] + [(c, t, "user", f"w{t}", 1, "x") for c in (201, 241, 242) for t in range(0, 250)]
    assert trie_of(spark, rows) == by_hand(rows)


def test_many_copies_and_many_ends(spark, monkeypatch):
    rows = [(20 * c, t, "user", "same old words", 1, "x") for c in range(1300) for t in range(2)]
    rows += [(20 * c, 0, "user", "same old words", 1, "x") for c in range(1300, 1500)] + [(20 * c, 0, "user", f"own {c}", 1, "x") for c in range(1500, 1600)]
    monkeypatch.setattr(prefix_trie, "TOGETHER", 64)
    assert trie_of(spark, rows) == by_hand(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA)).count() == 0
    # A conversation that borrows more turns than it has, of a base that isn't there, has no turns: a member of the root.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie_of(spark, [(c, 0, "user", "x", 1, "x")]) == by_hand([(c, 0, "user", "x")])
