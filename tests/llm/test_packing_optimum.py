"""Packing against the optimum of tiny inputs, and what the search takes away from its start."""

import random

from meridia.llm import bestfit


def optimum(lengths, capacity):
    """Fewest bins, by trying every item in every bin."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms)}.values()):
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_tiny_inputs_come_to_the_optimum_or_one_more():
    rng = random.Random(3)
    over = 0
    for _ in range(300):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        bins = bestfit.pack(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 20 for b in bins)
        extra = len(bins) - optimum(lengths, 20)
        assert 0 <= extra <= 1
        over += extra
    assert over <= 6


def test_search_empties_bins_of_its_start():
    rng = random.Random(1)
    lengths = [rng.choice((rng.randrange(200, 700), rng.randrange(400, 1300))) for _ in range(3000)]
    start = bestfit.best_fit(lengths, 2048, 1025)
    bins = bestfit.improve(lengths, start, 2048)
    bound = -(-sum(lengths) // 2048)
    assert len(start) - bound >= 5 and len(bins) - bound <= (len(start) - bound) // 2
    squares = lambda found: sum(sum(lengths[i] for i in b) ** 2 for b in found)
    assert squares(bins) > squares(start)
    assert len(bestfit.pack(lengths, 2048)) <= min(len(bins), len(bestfit.best_fit(lengths, 2048)))


def test_empty():
    assert bestfit.pack([], 2048) == []
