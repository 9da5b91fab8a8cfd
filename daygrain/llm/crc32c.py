"""CRC-32C (Castagnoli) of many byte strings at once in numpy, and the mask that record files put on it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected polynomial, and the constant of the mask.
POLY = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 256
U32 = np.uint32


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Row i: what a byte does to the checksum when i zero bytes follow it."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(POLY), t >> U32(1))
    rows = [t]
    for _ in range(7):
        rows.append(t[rows[-1] & U32(255)] ^ (rows[-1] >> U32(8)))
    return np.array(rows, U32)


def _lookup(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, held as four tables of a byte each, applied to many values."""
    return op[0][x & U32(255)] ^ op[1][(x >> U32(8)) & U32(255)] ^ op[2][(x >> U32(16)) & U32(255)] ^ op[3][x >> U32(24)]


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """The map that 2**power zero bytes are."""
    if power == 0:
        t = _tables()[0]
        byte = np.arange(256, dtype=U32)
        return np.array([t[x & U32(255)] ^ (x >> U32(8)) for x in (byte, byte << U32(8), byte << U32(16), byte << U32(24))], U32)
    half = _zeros(power - 1)
    return np.array([_lookup(half, half[i]) for i in range(4)], U32)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksum of each byte string."""
    if not parts:
        return np.zeros(0, U32)
    lengths = np.asarray([len(p) for p in parts], np.int64)
    blocks = -(-lengths // BLOCK)
    # Zeros in front leave a checksum that began at 0 as it is, so each string is filled up to whole blocks.
    data = np.frombuffer(b"".join([bytes(int(b) * BLOCK - len(p)) + p for p, b in zip(parts, blocks.tolist(), strict=True)]), np.uint8).reshape(-1, BLOCK)
    words = np.ascontiguousarray(data.T)
    t, state = _tables(), np.zeros(len(data), U32)
    for i in range(0, BLOCK, 8):
        w = words[i : i + 8]
        state = (
            t[7][(state & U32(255)) ^ w[0]] ^ t[6][((state >> U32(8)) & U32(255)) ^ w[1]] ^ t[5][((state >> U32(16)) & U32(255)) ^ w[2]] ^ t[4][(state >> U32(24)) ^ w[3]]
            ^ t[3][w[4]] ^ t[2][w[5]] ^ t[1][w[6]] ^ t[0][w[7]]
        )
    step, first = _zeros(BLOCK.bit_length() - 1), np.cumsum(blocks) - blocks
    out = np.zeros(len(parts), U32)
    order = np.argsort(-blocks, kind="stable")
    active = np.searchsorted(-blocks[order], -np.arange(int(blocks.max(initial=0))), side="left")  # strings with more blocks than j
    for j, n in enumerate(active.tolist()):
        on = order[:n]
        out[on] = _lookup(step, out[on]) ^ state[first[on] + j]
    begin = np.full(len(parts), 0xFFFFFFFF, U32)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> power & 1).astype(bool)
        begin[on] = _lookup(_zeros(power), begin[on])
    return out ^ begin ^ U32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> U32(15)) | (crc << U32(17))) + U32(MASK_DELTA)
