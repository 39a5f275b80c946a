"""What op5's rounds and its scoring send: blobs for a part or a shard, never a row for each document and bucket."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from relcheck.llm import pitman_yor as lm


def test_scoring_sends_shards_and_rounds_send_no_names():
    n, texts = 4, [f"the word w{i % 50} and w{i} of the text" for i in range(300)]
    docs = pd.DataFrame({"_id": pd.array([*range(299), None], "Int64"), "_h": 0, "_text": texts})
    none = SimpleNamespace(value=lm.pairs_of(*lm.tokens_of(docs)[:2])[:1])
    sent = pd.concat(s for turn in range(2) for s in lm.send_tokens(n, none, turn, 2)(iter([docs])))
    assert sorted(sent["bucket"]) == [*range(n)]
    first = pd.concat(lm.first_round(n, none)(x) for _, x in sent.groupby("bucket"))
    parts = lambda rows, step, before: pd.concat(lm.seat_parent(step, before)(x) for _, x in rows.groupby("part"))
    total = lambda told: np.sum([lm.unpack(x)[0] for x in told.loc[told["kind"] == "totals", "numbers"]], axis=0)
    told = parts(first[first["kind"] == "words"], 0, None)
    state = pd.concat([first[first["kind"].isin(["sections", "state"])], told[told["kind"] == "told"]])
    now = pd.concat(lm.next_round(lm.BURN_IN + 1, total(told), n)(x) for _, x in state.groupby("bucket"))
    assert not any(map(len, now["names"])) and not any(map(len, first.loc[first["kind"] == "sections", "names"]))
    again = parts(pd.concat([now[now["kind"] == "words"], told[told["kind"].isin(["parent", "places"])]]), 1, total(told))
    state = pd.concat([first[first["kind"].isin(["sections", "tokens"])], now[now["kind"] == "state"], again[again["kind"] == "told"]])
    rows = pd.concat(lm.score_tokens(total(again), n)(x) for _, x in state.groupby("bucket"))
    assert len(rows) <= n * (n + 1) and (rows["shard"] < 0).sum() == 1
    sums = pd.concat(lm.sum_shard(x) for _, x in rows[rows["shard"] >= 0].groupby("shard"))
    assert len(sums) == 300 and sums["_id"].isna().sum() == 1 and sums["known"].sum() > 2000
    assert np.isfinite(sums["score"]).all() and (sums["score"] < 0).all()
