"""Blocks out of hashes: equal hashes give equal blocks, different ones almost surely different blocks."""

from __future__ import annotations

import numpy as np

from ..model import BLOCK_BYTES


def expand(content: str, size: int = BLOCK_BYTES) -> bytes:
    """A block of digits with runs, from a generator seeded by the hash.

    The bytes themselves are not those of any other system, whose generator depends on its C library.
    """
    seed = list(content.encode())
    rng = np.random.Generator(np.random.PCG64([len(seed), *seed]))
    runs = rng.integers(1, 64, size)
    digits = rng.integers(0, 5, size).astype(np.uint8) + ord("0")
    return np.repeat(digits, runs)[:size].tobytes()
