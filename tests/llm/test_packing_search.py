import numpy as np

from meridia.llm import bestfit


def improving(lengths, bins, capacity):
    """Whether a move or an exchange of one for one, one for two or two for one raises the sum of squared fills."""
    fill = np.array([sum(lengths[i] for i in b) for b in bins])
    give = lambda b: [(1, lengths[i]) for i in b] + [(2, lengths[i] + lengths[j]) for k, i in enumerate(b) for j in b[k + 1 :]]
    back = [(0, c, 0) for c in range(len(bins))] + [(k, c, v) for c, b in enumerate(bins) for k, v in give(b)]
    kind, at, value = (np.array(x) for x in zip(*back, strict=True))
    for a, b in enumerate(bins):
        for k, out in give(b):
            d = out - value
            if ((at != a) & (kind + k <= 3) & (d > 0) & (fill[at] + d <= capacity) & (fill[at] + d > fill[a])).any():
                return True
    return False


def test_search_ends_where_no_exchange_improves():
    rng = np.random.default_rng(4)
    for low, high in ((500, 900), (400, 700)):
        lengths = rng.integers(low, high, 1500).tolist()
        bins = bestfit.pack(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(1500)) and max(sum(lengths[i] for i in b) for b in bins) <= 2048
        assert len(bins) == -(-sum(lengths) // 2048) or not improving(lengths, bins, 2048)
