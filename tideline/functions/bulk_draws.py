"""The keyed draws of ``draws`` for many rows and replicates at once, in numpy.

For steps inside a task that hash every row once per replicate. Numbers are those of ``draws.uniform`` and
``draws.order_key`` with the keys (name, replicate, more keys), bit by bit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts hashed at a time: the state and words of so many stay in a core's cache.
AT_ONCE = 16_384
#: A digest's block of 64 bytes also holds the text's end mark and length.
LONGEST = 55

_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_head(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of the MD5 of ``n`` texts of one block, as two big-endian numbers.

    ``words`` are the block's 16 little-endian numbers, each an array of ``n`` or one for all.
    """
    a, b, c, d = _START
    same = 0
    # As long as the words are one for all, so is the state; a block's first 16 steps take the words in order.
    while same < 16 and not isinstance(words[same], np.ndarray):
        f = (a + ((b & c) | (~b & d)) + _SINES[same] + int(words[same])) & 0xFFFFFFFF
        turn = _TURNS[0][same % 4]
        a, d, c, b = d, c, b, (b + ((f << turn) | (f >> (32 - turn)))) & 0xFFFFFFFF
        same += 1
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(same, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_PLACES[i]]
        if isinstance(word, np.ndarray):
            np.add(f, np.uint32(_SINES[i]), out=f)
            np.add(f, word, out=f)
        else:
            np.add(f, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=f)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()


class Draws:
    """Draws of (seed, name, replicate, key, key, ...), the further keys as columns of one length.

    ``empty`` makes the arrays that are kept from replicate to replicate, such as ``file_arrays.empty``.
    """

    def __init__(self, seed: int, name: str, *keys: pa.Array, empty: Callable[[tuple[int, ...], type], np.ndarray] = np.empty):
        texts = [pc.cast(_plain(k), pa.large_string()) for k in keys]
        blank = pa.array([""] * len(texts[0]), pa.large_string())
        # As in SQL, a missing key is left out with its colon.
        tails = pc.binary_join_element_wise(blank, *texts, pa.scalar(":", pa.large_string()), null_handling="skip")
        self.head = f"{seed}:{name}:"
        self.size = len(tails)
        self.starts = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + self.size + 1]
        data = tails.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.lengths = np.diff(self.starts)
        self.empty = empty
        if empty is not np.empty:
            self.starts, self.data, self.lengths = map(self._copied, (self.starts, self.data, self.lengths))
        self._kept: tuple = (None, None)

    def _copied(self, array: np.ndarray) -> np.ndarray:
        copy = self.empty(array.shape, array.dtype)
        copy[:] = array
        return copy

    def _words(self, before: int) -> list:
        """The words of the blocks in which a tail follows ``before`` bytes, which are 0."""
        if self._kept[0] == before:
            return self._kept[1]
        most = int(min(self.lengths.max(initial=0), LONGEST - before))
        used = -(-(before + most + 1) // 4)
        self._kept = (None, None)  # so that what it holds can go before
        words = self.empty((used + 1, self.size), np.uint32)
        at = np.arange(most)
        for first in range(0, self.size, AT_ONCE):
            part = slice(first, min(first + AT_ONCE, self.size))
            lengths = np.minimum(self.lengths[part], most)
            texts = np.zeros((len(lengths), used * 4), np.uint8)
            inside = at < lengths[:, None]
            places = np.minimum(self.starts[part][:, None] + at, len(self.data) - 1)
            texts[:, before : before + most] = np.where(inside, self.data[places], 0)
            texts[np.arange(len(lengths)), before + lengths] = 0x80
            words[:used, part] = texts.view("<u4").T
            words[used, part] = (self.lengths[part] + before) * 8
        *found, bits = [w if (w != w[0]).any() else int(w[0]) for w in words] if self.size else [0] * (used + 1)
        found += [0] * (14 - used) + [bits, 0]
        self._kept = (before, found)
        return found

    def heads(self, replicates: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The digests' first and second 4 bytes, a row per replicate; all of them must have as many digits."""
        texts = [f"{self.head}{rep}".encode() for rep in replicates]
        before = len(texts[0])
        out = np.empty((2, len(texts), self.size), np.uint32)
        if before <= LONGEST:
            words = self._words(before)
            fixed = np.array([np.frombuffer(x.ljust(64, b"\0"), "<u4") for x in texts], np.uint32)
            rows = max(1, AT_ONCE // max(self.size, 1))
            for r in range(0, len(texts), rows):
                some = fixed[r : r + rows]
                for first in range(0, self.size, AT_ONCE):
                    part = slice(first, min(first + AT_ONCE, self.size))
                    n = part.stop - part.start
                    block = []
                    for i, word in enumerate(words):
                        tail = word[part] if isinstance(word, np.ndarray) else word
                        if len(some) == 1:
                            block.append(tail | some[0, i] if isinstance(tail, np.ndarray) else tail | int(some[0, i]))
                        elif isinstance(tail, np.ndarray) or (some[:, i] != some[0, i]).any():
                            both = some[:, i : i + 1] | (tail if isinstance(tail, np.ndarray) else np.uint32(tail))
                            block.append(np.broadcast_to(both, (len(some), n)).ravel())
                        else:
                            block.append(tail | int(some[0, i]))
                    x, y = _md5_head(block, n * len(some))
                    out[0, r : r + rows, part], out[1, r : r + rows, part] = x.reshape(-1, n), y.reshape(-1, n)
        for i in np.flatnonzero(self.lengths + before > LONGEST):
            tail = self.data[self.starts[i] : self.starts[i + 1]].tobytes()
            for r, text in enumerate(texts):
                out[:, r, i] = np.frombuffer(hashlib.md5(text + tail).digest()[:8], ">u4")
        return out[0], out[1]

    def uniform(self, replicates: list[int]) -> np.ndarray:
        return self.heads(replicates)[0] / 4294967296.0

    def order_key(self, replicates: list[int]) -> np.ndarray:
        x, y = self.heads(replicates)
        return (x.astype(np.uint64) << np.uint64(28)) | (y >> np.uint32(4))


def together(first: int, last: int, size: int) -> Iterator[list[int]]:
    """The replicates ``first`` .. ``last`` in runs of as many digits, short ones where ``size`` rows are many."""
    rep = first
    while rep <= last:
        end = min(last, rep + max(1, AT_ONCE // max(size, 1)) - 1, 10 ** len(str(rep)) - 1)
        yield [*range(rep, end + 1)]
        rep = end + 1


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
