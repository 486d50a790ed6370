"""Exact hypergeometric splits, drawn the same way by every task from a seed."""

from __future__ import annotations

import numpy as np

#: Populations up to this go to numpy's sampler, which takes none of a thousand million; larger ones are
#: drawn by inversion of the same law.
NUMPY_MOST = 900_000_000
#: Standard deviations on either side of the mode that inversion sums (beyond is less than a double's last
#: bit), and how many weights it holds at a time.
REACH, CHUNK = 9, 1 << 20


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([int(k) & (2**63 - 1) for k in key])))


def invert(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw of any size by inversion around the mode.

    Neighbouring probabilities have ratios of whole numbers, so weights are running sums of logarithms of
    them; as many are summed as the deviation asks for, some at a time.
    """
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    p = good / total
    spread = int(REACH * (n * p * (1 - p) * (total - n) / max(1, total - 1)) ** 0.5) + 4 * REACH
    first, last = max(low, mode - spread), min(high, mode + spread)

    def weights(at: int, log: float) -> tuple[np.ndarray, float]:
        """Running sums of the weights of a chunk, and the logarithm of the weight after it."""
        k = np.arange(at, min(at + CHUNK, last + 1), dtype=np.float64)
        with np.errstate(divide="ignore"):
            up = np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1.0) * (float(bad - n) + k + 1.0)))
        return np.cumsum(np.exp(np.concatenate([[log], log + up[:-1]]))), log + float(up[-1])

    chunks, log = [], 0.0
    for at in range(first, last + 1, CHUNK):
        sums, after = weights(at, log)
        chunks.append((at, log, float(sums[-1])))
        log = after
    left = rng.random() * sum(c[2] for c in chunks)
    for at, log, share in chunks:
        if left < share or at == chunks[-1][0]:
            sums = weights(at, log)[0]
            return at + min(int(np.searchsorted(sums, left, "right")), len(sums) - 1)
        left -= share
    raise AssertionError("the last chunk takes what is left")


def one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return are good."""
    total = good + bad
    if n <= 0 or good <= 0:
        return 0
    if n >= total or bad <= 0:
        return min(good, n)
    if total <= NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    return invert(rng, good, bad, n)


def many(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without return come from each of some cells: multivariate hypergeometric.

    Cells are halved level by level, all nodes of a level in one draw; nodes that get nothing or all
    end there, so the work follows the cells that get something.
    """
    out = np.zeros(len(sizes), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high, draws = np.array([0]), np.array([len(sizes)]), np.array([int(n)])
    while len(low):
        whole = draws == ends[high] - ends[low]
        for a, b in zip(low[whole & (draws > 0)], high[whole & (draws > 0)], strict=True):
            out[a:b] = sizes[a:b]
        open_ = (draws > 0) & ~whole
        low, high, draws = low[open_], high[open_], draws[open_]
        single = high - low == 1
        out[low[single]] = draws[single]
        low, high, draws = low[~single], high[~single], draws[~single]
        mid = (low + high) // 2
        good, bad = ends[mid] - ends[low], ends[high] - ends[mid]
        if len(low) and int((good + bad).max()) <= NUMPY_MOST:
            left = rng.hypergeometric(good, bad, draws)
        else:
            left = np.array([one(rng, int(g), int(b), int(d)) for g, b, d in zip(good, bad, draws, strict=True)], np.int64)
        low, high, draws = np.concatenate([low, mid]), np.concatenate([mid, high]), np.concatenate([left, draws - left])
    return out


def row_of_matrix(seed: int, counts: np.ndarray, cells: np.ndarray, part: int) -> np.ndarray:
    """Row `part` of the communication matrix of parts (row sums) and cells (column sums).

    The matrix is split in halves of the parts; at each node, what the left half gets of every cell is
    drawn under the node's own seed. A task walks one path, so none holds the matrix; cells that are
    empty in a node are left out below it.
    """
    low, high = 0, len(counts)
    which, here = np.arange(len(cells)), np.asarray(cells, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    while high - low > 1:
        mid = (low + high) // 2
        left = many(generator(seed, low, high), here, int(ends[mid] - ends[low]))
        low, high, here = (low, mid, left) if part < mid else (mid, high, here - left)
        which, here = which[here > 0], here[here > 0]
    out = np.zeros(len(cells), np.int64)
    out[which] = here
    return out


def splitting_tree(seed: int, sizes: np.ndarray, whole: int, rest: int, quotas: np.ndarray) -> np.ndarray:
    """What each block gives to each of some shards (blocks x shards).

    A block gives `whole` times its size, and of `rest` units drawn from all blocks without return its
    hypergeometric share. Blocks are halved: a node's draws are split between its halves, and then its
    quotas for the shards, so columns sum to the quotas (which sum to whole * size + rest) and rows to
    what the blocks give.
    """
    out = np.zeros((len(sizes), len(quotas)), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    open_ = [(0, len(sizes), int(rest), np.asarray(quotas, np.int64))]
    while open_:
        low, high, draws, own = open_.pop()
        if high - low == 1:
            out[low] = own
        elif high > low and own.any():
            mid = (low + high) // 2
            rng = generator(seed, low, high)
            left = one(rng, int(ends[mid] - ends[low]), int(ends[high] - ends[mid]), draws)
            first = many(rng, own, whole * int(ends[mid] - ends[low]) + left)
            open_ += [(low, mid, left, first), (mid, high, draws - left, own - first)]
    return out
