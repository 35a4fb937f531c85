"""Values that never decrease: many different numbers of one key."""

import bisect
import random

from tabloom.operators import dependency


def test_steps_as_one_list():
    """As with one sorted list, but no list grows with the numbers."""
    r, steps, known, given = random.Random(4), dependency.Steps(), [], {}
    for _ in range(30_000):
        x, v, u = r.choice([r.random(), r.randrange(500)]), r.random(), r.random()
        make = lambda low, high: v if low <= v <= high else low + u * (high - low)  # noqa: B023, E731
        if x not in given:
            at = bisect.bisect_left(known, x)
            given[x] = make(given[known[at - 1]] if at else 0.0, given[known[at]] if at < len(known) else 1.0)
            known.insert(at, x)
        assert steps.taken(x, 0.0, 1.0, make) == given[x]
    assert [x for part in steps.at for x in part] == known and max(map(len, steps.at)) <= dependency.LIST
