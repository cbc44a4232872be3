"""Hashed words and word shingles of texts, with numpy.

Texts come as UTF-8 bytes: words lie between the six ASCII white-space characters, and ``bytes.lower``
changes A-Z alone. A word's hash is a polynomial of its bytes modulo 2 ** 64, mixed with its length, so that
prefix sums over the bytes give those of all words at once.
"""

import numpy as np

#: Odd multipliers of the mixing steps.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ZERO = np.zeros(1, np.uint64)


class Powers:
    """Powers of the odd multiplier and of its inverse modulo 2 ** 64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(MULTIPLY), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, m, np.uint64)])) for m in (MULTIPLY, inverse))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * FINISH
    return x ^ (x >> np.uint64(27))


def _polynomials(text: bytes) -> tuple:
    """(polynomial, length) of each word of a text of PIECE bytes at most."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return _ZERO[:0], _ZERO[:0]
    space = _SPACE[raw]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = not space[0], not space[n - 1]
    np.not_equal(space[1:], space[:-1], out=edge[1:n])
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    up, down = Powers.of(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * up[ends - 1], (ends - starts).astype(np.uint64)


def _long(text: bytes) -> tuple:
    """As above for any text: word by word of those that go over a piece."""
    polynomials, lengths, held, size = [], [], [], 0

    def flush():
        if held:
            p, n = _polynomials(b" ".join(held))
            polynomials.append(p)
            lengths.append(n)
            held.clear()

    for word in text.split():
        if len(word) < PIECE:
            if size + len(word) + 1 > PIECE:
                flush()
                size = 0
            held.append(word)
            size += len(word) + 1
            continue
        flush()
        size, total = 0, _ZERO
        for k in range(0, len(word), PIECE):
            part = word[k : k + PIECE]
            total = total * (Powers.of(PIECE + 1)[0][len(part)]) + _polynomials(part)[0]
        polynomials.append(total)
        lengths.append(np.array([len(word)], np.uint64))
    flush()
    return np.concatenate([_ZERO[:0], *polynomials]), np.concatenate([_ZERO[:0], *lengths])


def hashed_words(text: bytes) -> np.ndarray:
    found, lengths = _polynomials(text) if len(text) <= PIECE else _long(text)
    return mixed(mixed(found ^ (lengths * FINISH)))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words, from prefix sums."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = Powers.of(n)
    sums = np.concatenate([_ZERO, np.cumsum(hashes * down[:n])])
    return mixed(mixed((sums[size:] - sums[:-size]) * up[size - 1 : n]))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words none."""
    h = hashed_words(text.lower())
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(words, n)
    out = windows(h, k) + np.uint64(k)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
