"""Every candidate block is compressed with every notice, whatever its words are."""
from granary.llm import license_scan as S


class Counted:
    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def compress(self, data):
        self.calls.append(self)
        return self.inner.compress(data)


def test_each_block_meets_each_dictionary(monkeypatch):
    plain, each = S.compressors()
    calls = []
    counted = (plain, [(*x[:3], Counted(x[3], calls)) for x in each])
    monkeypatch.setattr(S, "compressors", lambda: counted)
    assert S.held("the copyright of this text is unclear, says 7f3a") == () and len(calls) == len(each)
    for name, notice, *_ in each:
        block = f"copyright 2020 by someone {notice} and so on"
        saved = S.savings(block)
        assert len(saved) == len(each) and any(x[:2] == (name, notice) and x[2] == saved[i] for i, e in enumerate(each) if e[1] == notice for x in S.held(block))
