"""Results kept by what they are worked out from, so that shapes that repeat in a model are made once a worker."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable

_REF = re.compile(r"#(\d+)")


class Memo:
    """The most recently used results, of at most limit bytes as their makers state them."""

    def __init__(self, limit: int = 32 << 20):
        self.limit, self.held = limit, 0
        self._kept: OrderedDict[Hashable, tuple[object, int]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], object], size: Callable[[object], int]) -> object:
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key][0]
        value = make()
        n = size(value) + 256
        self._kept[key] = value, n
        self.held += n
        while self.held > self.limit and self._kept:
            self.held -= self._kept.popitem(last=False)[1][1]
        return value


def alike(root: int, records: Iterable[tuple[int, str, str]]) -> tuple:
    """A key that records(step_id, type, args) share with all that differ from them in nothing but their step ids.

    Ids are numbered by their order, and the root's number is part of the key; references that lead out of the records stay.
    """
    rows = sorted(records)
    number = {str(i): f"\0{n}" for n, (i, _, _) in enumerate(rows)}
    return number.get(str(root)), tuple((t, _REF.sub(lambda m: number.get(m[1], m[0]), a)) for _, t, a in rows)
