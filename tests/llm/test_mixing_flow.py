"""The flow of operator 7: least cost by brute force on small networks, many patterns in seconds."""

import random
import time
from itertools import product

from ledgerline.llm.mixing import min_cost_flow


def best(offers, members, demands):
    """Greatest flow, then least repetition cost, by trying all whole amounts of each pattern to each source."""
    choices = [[c for c in product(range(3 * o + 1), repeat=len(m)) if sum(c) <= 3 * o] for o, m in zip(offers, members)]
    cost = lambda o, g: sum(max(0, g - r * o) for r in (1, 2)) if o else 0
    found = (0, 0)
    for picked in product(*choices):
        got = [0] * len(demands)
        for c, m in zip(picked, members):
            for x, s in zip(c, m):
                got[s] += x
        if all(g <= d for g, d in zip(got, demands)):
            found = min(found, (-sum(got), sum(cost(o, sum(c)) for o, c in zip(offers, picked))))
    return -found[0], found[1]


def test_flow_is_greatest_and_cheapest():
    rng = random.Random(4)
    for _ in range(120):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        members = sorted({tuple(sorted(rng.sample(range(m), rng.randint(1, m)))) for _ in range(n)})
        offers, demands = [rng.randint(0, 2) for _ in members], [rng.randint(0, 6) for _ in range(m)]
        given = min_cost_flow(offers, [list(x) for x in members], demands)
        cost = sum(max(0, g - r * o) for o, g in zip(offers, given) for r in (1, 2))
        assert all(0 <= g <= 3 * o for g, o in zip(given, offers))
        assert (sum(given), cost) == best(offers, members, demands), (offers, members, demands)


def test_a_hundred_thousand_patterns_take_seconds():
    rng = random.Random(5)
    members = [[i] for i in range(80_000)] + [[i, i + 1] for i in range(80_000, 100_000)]
    offers, demands = [rng.randint(0, 1000) for _ in members], [rng.randint(0, 3000) for _ in range(100_001)]
    began = time.perf_counter()
    given = min_cost_flow(offers, members, demands)
    assert time.perf_counter() - began < 60 and all(given[i] == min(demands[i], 3 * offers[i]) for i in range(80_000))
