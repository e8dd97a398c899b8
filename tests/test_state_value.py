"""How often state is touched."""

from types import SimpleNamespace

import pandas as pd

from tidepool.streaming import versions


def test_state_is_one_value():
    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, new):
            calls.append("update")
            self.held = new

    p, value = versions.LastVersion(), Value()
    p.init(SimpleNamespace(getValueState=lambda name, schema: value))
    block = lambda i, h: {"id": f"id{i}", "hash": h, "page": 1, "block_type": "text", "block_index": i, "text": f"t{i}{h}"}
    turn = lambda version, blocks: [(r.id, r.deleted) for b in p.handleInputRows(("s",), iter([pd.DataFrame({"version": [version], "hash": ["h"], "blocks": [blocks]})]), None) for r in b.itertuples()]
    assert turn(1, [block(i, "a") for i in range(50)]) == [(f"id{i}", False) for i in range(50)]
    assert turn(1, [block(0, "z")]) == []
    assert sorted(turn(2, [block(0, "a"), block(1, "b")])) == sorted([("id1", False), *((f"id{i}", True) for i in range(2, 50))])
    assert turn(3, []) and turn(4, [block(0, "a")]) == [("id0", False)] and len(calls) <= 10
