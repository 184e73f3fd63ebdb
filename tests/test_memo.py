"""Shapes that repeat are worked out once a worker, whatever their step ids; the keeping is bounded."""

import numpy as np

from ashlar.functions.memo import Memo, alike
from ashlar.functions.solids import Items
from ashlar.operators import meshes


def body(b, size="2."):
    return [(b, "IFCBLOCK", f"#{b + 1},{size},2.,3."), (b + 1, "IFCAXIS2PLACEMENT3D", f"#{b + 2},$,$"), (b + 2, "IFCCARTESIANPOINT", "(0.,0.,0.)")]


def test_keys_differ_by_all_but_ids():
    assert alike(100, body(100)) == alike(700, body(700)[::-1])
    assert alike(100, body(100)) != alike(100, body(100, "2.5"))
    assert alike(100, body(100)) != alike(101, body(100))
    swapped = [(1, "A", "#2,#3"), (2, "B", ""), (3, "B", "")], [(1, "A", "#3,#2"), (2, "B", ""), (3, "B", "")]
    assert alike(1, swapped[0]) != alike(1, swapped[1])


def test_memo_is_bounded_and_made_once():
    memo, made = Memo(2000), []
    for k in (1, 1, 2, 1, 3, 1, 2):
        assert memo.get(k, lambda k=k: made.append(k) or k, lambda _: 600) == k
    assert made == [1, 2, 3, 2] and memo.held <= 2000
    assert memo.get("huge", lambda: 5, lambda _: 5000) == 5 and memo.held <= 2000


def test_equal_bodies_are_meshed_once(spark, monkeypatch):
    rows = [(root, *r) for root in (100, 200, 300) for r in body(root, "4." if root == 300 else "2.")]
    calls = []
    plain = Items.mesh
    monkeypatch.setattr(Items, "mesh", lambda self, root: calls.append(root) or plain(self, root))
    made = lambda root, records: [meshes._MESHES.get(alike(root, records), lambda: meshes._decoded(records).mesh(root), lambda m: 1)]
    got = {root: made(root, [r[1:] for r in rows if r[0] == root])[0] for root in (100, 200, 300)}
    assert calls == [100, 300]
    assert np.array_equal(got[100][0][1], got[200][0][1]) and not np.array_equal(got[100][0][1], got[300][0][1])
