"""AES in counter mode over NumPy blocks, as encrypted zip members use it (little-endian counter from 1)."""

from __future__ import annotations

from functools import cache

import numpy as np

_SHIFT = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])  # rows of a state kept by columns
#: Blocks that are worked on at once.
STEP = 1 << 14


def _times2(a: np.ndarray) -> np.ndarray:
    return (a << np.uint8(1)) ^ ((a >> np.uint8(7)) * np.uint8(0x1B))


@cache
def _substitutions() -> np.ndarray:
    """The S-box: inverses in GF(2^8), each followed by the affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)  # times 3, a generator
    out = np.zeros(256, np.uint8)
    for value in range(256):
        inverse = power[-log[value] % 255] if value else 0
        turned = inverse
        for shift in range(1, 5):
            turned ^= (inverse << shift | inverse >> (8 - shift)) & 0xFF
        out[value] = turned ^ 0x63
    return out


def _round_keys(key: bytes) -> np.ndarray:
    box, n = _substitutions(), len(key) // 4
    words = [np.frombuffer(key[4 * i : 4 * i + 4], np.uint8) for i in range(n)]
    constant = np.array([1, 0, 0, 0], np.uint8)
    for i in range(n, 4 * (n + 7)):
        last = words[-1]
        if i % n == 0:
            last = box[np.roll(last, -1)] ^ constant
            constant = _times2(constant)
        elif n > 6 and i % n == 4:
            last = box[last]
        words.append(words[i - n] ^ last)
    return np.concatenate(words).reshape(-1, 16)


def encrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Blocks (n by 16 bytes) under the round keys."""
    box, state = _substitutions(), blocks ^ keys[0]
    for key in keys[1:-1]:
        a = box[state][:, _SHIFT].reshape(-1, 4, 4)
        every = a[..., 0:1] ^ a[..., 1:2] ^ a[..., 2:3] ^ a[..., 3:4]
        state = (a ^ every ^ _times2(a ^ np.roll(a, -1, axis=2))).reshape(-1, 16) ^ key
    return box[state][:, _SHIFT] ^ keys[-1]


def counter_mode(key: bytes, data: bytes) -> bytes:
    """``data`` enciphered, or deciphered, with a key of 16, 24 or 32 bytes."""
    keys, out = _round_keys(key), []
    for at in range(0, len(data), 16 * STEP):
        part = np.frombuffer(data[at : at + 16 * STEP], np.uint8)
        n = -(-len(part) // 16)
        blocks = np.zeros((n, 2), "<u8")
        blocks[:, 0] = np.arange(at // 16 + 1, at // 16 + 1 + n)
        stream = encrypt_blocks(keys, blocks.view(np.uint8).reshape(n, 16)).reshape(-1)
        out.append((part ^ stream[: len(part)]).tobytes())
    return b"".join(out)
