"""Hashed n-grams of many texts at once, by array operations on their bytes."""

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
#: Kinds of bytes: 0 white space and control, 1 letters (all of a character beyond ASCII too), 2 digits, 3 marks.
KIND = np.full(256, 3, np.uint8)
KIND[:33] = 0
KIND[127] = 0
KIND[ord("0") : ord("9") + 1] = 2
KIND[ord("A") : ord("Z") + 1] = KIND[ord("a") : ord("z") + 1] = 1
KIND[128:] = 1
LENGTH_CLASS = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4] + [5] * 8 + [6])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.size = 0

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > self.size:
            self.size = 2 * size
            bases = [np.full(self.size, b, np.uint64) for b in (BASE, INVERSE)]
            for b in bases:
                b[0] = 1
            self.up, self.down = (np.multiply.accumulate(b) for b in bases)
        return self.up[:size], self.down[:size]


powers = Powers()


def hashed_ngrams(data: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per n-gram its bucket and the number of its text. ``data``: the texts' bytes, a byte of white space after each;
    ``ends``: where each text ends with that byte.

    Tokens are runs of bytes of one kind other than white space. Counted are each token, each pair
    of neighbours, and each pair's shapes: kind, class of length, capitals, and whether the tokens are the same. A
    token that repeats the one before is written as such a repeat, whatever the token.
    """
    kind = KIND[data]
    borders = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, stops = borders[:-1], borders[1:]
    word = kind[starts] != 0
    starts, stops = starts[word], stops[word]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    token = _mixed((sums[stops] - sums[starts]) * down[starts])
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=capitals[1:])
    lengths = stops - starts
    upper = capitals[stops] - capitals[starts]
    case = np.where(upper == 0, 0, np.where(upper == lengths, 2, 1))
    shape = (kind[starts] * 8 + LENGTH_CLASS[np.minimum(lengths, 17)]) * 4 + case
    text = np.searchsorted(ends, starts, "right")
    first = np.diff(text, prepend=-1) != 0
    before, before_shape = np.roll(token, 1), np.roll(shape, 1)
    before[first], before_shape[first] = 1, 127
    same = (token == before) & ~first
    one = np.where(same, np.uint64(3), token)
    two = np.where(same, np.uint64(5), _mixed(before * np.uint64(0x2545F4914F6CDD1D) + token))
    three = _mixed((before_shape * 256 + shape).astype(np.uint64) * np.uint64(4) + same.astype(np.uint64) + np.uint64(1 << 40))
    grams = np.concatenate([one, two, three]) >> np.uint64(17)
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text, text])
