"""BLAKE3 (the default hash mode) from its public specification."""

from __future__ import annotations

import struct

_M = 0xFFFFFFFF
# The initial words and the message permutation of the specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *_IV[:4], counter & _M, counter >> 32 & _M, size, flags]
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word & _M
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << 32 - r1) & _M
                v[c] = v[c] + v[d] & _M
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << 32 - r2) & _M
        if turn < 6:
            m = [m[i] for i in _PERMUTE]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, first_chunk: int, root: bool) -> list[int]:
    if len(data) <= 1024:
        blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        cv = _IV
        for i, b in enumerate(blocks):
            last = i + 1 == len(blocks)
            cv = _compress(cv, b, first_chunk, len(b), (_START if i == 0 else 0) | (_END if last else 0) | (_ROOT if last and root else 0))
        return cv
    chunks = (len(data) - 1) // 1024
    left = 1 << chunks.bit_length() - 1
    pair = _node(data[: left * 1024], first_chunk, False) + _node(data[left * 1024 :], first_chunk + left, False)
    return _compress(_IV, struct.pack("<16I", *pair), 0, 64, _PARENT | (_ROOT if root else 0))


def blake3_hex(data: bytes) -> str:
    return struct.pack("<8I", *_node(data, 0, True)).hex()
