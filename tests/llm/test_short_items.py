from relcheck.llm.decontaminate import Matcher


def test_short_items_are_searched():
    items = [(1, "who is ada?"), (2, "art"), (3, "who wrote the old stone bridge")]
    found = lambda t: sorted(m[:2] for m in Matcher(items, 0.05).matches(t))
    assert found("so who is ada? she") == [(1, 0)]
    assert found("party part") == [] and found("party. art!") == [(2, 0)]
    assert found("x who wrote the old stome bridge y") == [(3, 1)]
