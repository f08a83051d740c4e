"""Arithmetic of unsigned 64-bit arrays modulo a prime."""

from __future__ import annotations

import numpy as np

PRIME = (1 << 61) - 1
#: Bits of an exponent that one table of powers covers.
LOW = 16


def mix(x: np.ndarray) -> np.ndarray:
    """Another order of all 64-bit numbers, in which near ones are far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mulmod(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a b modulo a prime that is 2**61 - 1 or below 2**32, without overflow of 64 bits."""
    if prime < 1 << 32:
        return a * b % np.uint64(prime)
    u = np.uint64
    a1, a0, b1, b0 = a >> u(31), a & u((1 << 31) - 1), b >> u(31), b & u((1 << 31) - 1)
    middle = a1 * b0 + a0 * b1
    x = u(2) * a1 * b1 + (middle >> u(30)) + ((middle & u((1 << 30) - 1)) << u(31)) + a0 * b0
    x = (x & u(PRIME)) + (x >> u(61))
    return np.where(x >= u(PRIME), x - u(PRIME), x)


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents, from a table for each 16 bits of the exponent that occur."""
    out, at, rest = np.ones(len(exponents), dtype=np.uint64), base % prime, exponents.astype(np.uint64)
    while rest.any():
        table = np.ones(1, dtype=np.uint64)
        while len(table) < min(1 << LOW, int(rest.max()) + 1):
            table = np.concatenate([table, mulmod(table, np.full(len(table), pow(at, len(table), prime), dtype=np.uint64), prime)])
        out = mulmod(out, table[(rest & np.uint64((1 << LOW) - 1)).astype(np.int64)], prime)
        rest, at = rest >> np.uint64(LOW), pow(at, 1 << LOW, prime)
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo PRIME of the values from each row number of ``first`` to before the next; there are less than 2**31 values."""
    low = np.add.reduceat(values & np.uint64((1 << 32) - 1), first) % np.uint64(PRIME)
    high = np.add.reduceat(values >> np.uint64(32), first) % np.uint64(PRIME)
    return (mulmod(high, np.full(len(high), 1 << 32, dtype=np.uint64), PRIME) + low) % np.uint64(PRIME)
