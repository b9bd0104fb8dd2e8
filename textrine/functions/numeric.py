"""Scalar functions: modular arithmetic, primality, hash families, formatting.

Columns in, columns out. What fits decimal arithmetic stays in the JVM; powers
and primality, which loop, are Arrow UDFs over whole batches, primality under
2^32 with one array operation for all numbers of a batch. Unsigned 64-bit
numbers are ``decimal(38, 0)``.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, LongType

WORD = 1 << 64
#: Fixed value: the greatest prime under 2^32, the universe of the cuckoo hashes.
UNIVERSE = 4_294_967_291
#: These bases decide primality for all numbers under 2^64.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def big(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(Decimal(value))).cast("decimal(38,0)")


def mul_mod(a: Column, b: Column, c: Column) -> Column:
    """(a * b) mod c for a, b under 2^63, without overflow."""
    return ((big(a) * big(b)) % big(c)).cast("decimal(38,0)")


@F.pandas_udf(DecimalType(38, 0))
def _pow_mod(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if None in t or not t[2] else Decimal(pow(int(t[0]), int(t[1]), int(t[2]))) for t in zip(a, b, c)], dtype=object)


def pow_mod(a: Column, b: Column, c: Column) -> Column:
    """(a ^ b) mod c."""
    return _pow_mod(big(a), big(b), big(c))


def witness(n: int, bases=WITNESSES) -> int:
    """A base that proves n composite, or 0 (Miller and Rabin; exact under 2^64)."""
    if n < 2:
        return 1
    for p in bases:
        if n % p == 0:
            return 0 if n == p else p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in bases:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return a
    return 0


def fermat_witness(n: int, bases=WITNESSES) -> int:
    """A base whose power n - 1 differs from 1, or 0; Carmichael numbers can pass."""
    if n < 4:
        return 0 if n in (2, 3) else 1
    return next((a for a in bases if a % n and pow(a, n - 1, n) != 1), 0)


def following_prime(n: int) -> int:
    """The least prime greater than n."""
    n += 1
    while witness(n):
        n += 1
    return n


def powers(a: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(a ^ e) mod n of arrays of numbers under 2^32."""
    out, a, e = np.ones_like(n) % n, a % n, e.copy()
    while e.any():
        out = np.where(e & np.uint64(1), out * a % n, out)
        a, e = a * a % n, e >> np.uint64(1)
    return out


def primes(n: np.ndarray) -> np.ndarray:
    """Which numbers are prime: Miller and Rabin with all bases, for whole arrays under 2^32 and one by one above."""
    out = n >= 2
    small = np.flatnonzero(out & (n < 1 << 32))
    out[n >= 1 << 32] = [witness(int(x)) == 0 for x in n[n >= 1 << 32]]
    m = n[small].astype(np.uint64)
    odd, twos = m - np.uint64(1), np.zeros(len(m), np.int64)
    for _ in range(32):
        even = (odd > 0) & (odd & np.uint64(1) == 0)
        odd, twos = np.where(even, odd >> np.uint64(1), odd), twos + even
    good = np.ones(len(m), bool)
    for p in WITNESSES[:5]:  # these decide all numbers under 2^32
        x = powers(np.full_like(m, p), odd, m)
        passes = (x == 1 % m) | (x == m - np.uint64(1))
        for k in range(1, int(twos.max(initial=1))):
            x = x * x % m
            passes |= (x == m - np.uint64(1)) & (k < twos)
        good &= (m == p) | (passes & (m % np.uint64(p) != 0))
    out[small] = good
    return out


def fermat_primes(n: np.ndarray) -> np.ndarray:
    """Which numbers pass Fermat's test with all bases: whole arrays under 2^32, one by one above."""
    out = (n == 2) | (n == 3)
    some, large = np.flatnonzero((n >= 4) & (n < 1 << 32)), n >= 1 << 32
    out[large] = [fermat_witness(int(x)) == 0 for x in n[large]]
    m = n[some].astype(np.uint64)
    good = np.ones(len(m), bool)
    for p in WITNESSES:
        good &= (np.uint64(p) % m == 0) | (powers(np.full_like(m, p), m - np.uint64(1), m) == 1)
    out[some] = good
    return out


def following_primes(n: np.ndarray) -> np.ndarray:
    """The least prime greater than each number."""
    out, left = np.maximum(n, 1) + 1, np.arange(len(n))
    while len(left):
        left = left[~primes(out[left])]
        out[left] += 1
    return out


def _known(n: pd.Series, of, dtype) -> pd.Series:
    """``of`` the numbers that are not null."""
    out, there = pd.Series([None] * len(n), dtype=object), n.notna().to_numpy()
    out[there] = of(n[there].to_numpy(np.int64)).astype(dtype)
    return out


@F.pandas_udf(BooleanType())
def is_prime(n: pd.Series) -> pd.Series:
    return _known(n, primes, object)


@F.pandas_udf(BooleanType())
def is_fermat_prime(n: pd.Series) -> pd.Series:
    return _known(n, fermat_primes, object)


@F.pandas_udf(LongType())
def next_prime(n: pd.Series) -> pd.Series:
    return _known(n, following_primes, object)


def random_below(key: Column, bound, seed: int) -> Column:
    """A random number in 0..bound-1 from a key and a seed: 60 bits of an md5, the same on every run and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), bound)


def edge_key(node: Column, letter: Column) -> Column:
    """The hash key of (node, letter): node xor letter * 2^32."""
    return node.cast("long").bitwiseXOR(F.shiftleft(letter.cast("long"), 32))


def primary_hash(node: Column, letter: Column, size) -> Column:
    return F.pmod(edge_key(node, letter), F.lit(size).cast("long"))


def secondary_hash(node: Column, letter: Column, size) -> Column:
    return F.pmod(edge_key(node, letter), F.lit(size - 2).cast("long")) + 1


def cuckoo_hash(node: Column, letter: Column, a: int, b: int, size: int, offset: int) -> Column:
    """((a * key + b) mod 2^64) mod universe mod size, plus the table's offset."""
    wide = (big(a) * big(edge_key(node, letter)) + big(b)) % big(WORD)
    return ((wide % big(UNIVERSE)) % big(size)).cast("long") + offset


def cuckoo_settings(size: int, functions: int = 8, seed: int = 1) -> list[dict]:
    """a, b, offset and size of each cuckoo table for a requested total size.

    Each table's size is the next prime after the one before, from size divided by
    the number of functions on. Parameters are random but seeded.
    """
    import random

    r = random.Random(seed)
    functions = functions if functions >= 2 else 8
    out, offset, last = [], 0, max(1, size // functions)
    for i in range(functions):
        last = following_prime(last)
        out.append({"i": i, "a": r.randrange(1, UNIVERSE), "b": r.randrange(UNIVERSE), "offset": offset, "size": last})
        offset += last
    return out


def double_settings(size: int) -> dict:
    """Table sizes of double hashing: the next prime, and two less for the second hash."""
    prime = following_prime(max(1, size))
    return {"size": prime, "first": prime, "second": prime - 2}


def digits(x: Column) -> Column:
    """Decimal digits of a non-negative number."""
    return F.length(x.cast("string"))


def human_size(size: Column) -> Column:
    """Bytes with binary prefixes and three decimals, rounded half up in thousandths."""
    n = size.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, prefix in enumerate("KMGTPE", 1):
        unit = 1 << (10 * k)
        part = F.floor(F.lit(0.5) + n.bitwiseAND(F.lit(unit - 1)).cast("double") / float(1 << (10 * (k - 1))) * 0.9765625).cast("long")
        whole = F.shiftright(n, 10 * k) + F.when(part == 1000, 1).otherwise(0)
        text = F.concat(whole.cast("string"), F.lit("."), F.lpad(F.when(part == 1000, 0).otherwise(part).cast("string"), 3, "0"), F.lit(f" {prefix}iB"))
        out = F.when(n >= unit, text).otherwise(out)
    return out


def human_time(ms: Column) -> Column:
    """Milliseconds as hours, minutes and seconds; hundredths may read 100."""
    t = ms.cast("long")
    seconds = F.floor(t / 1000).cast("long")
    s, m, h = seconds % 60, F.floor(seconds / 60).cast("long") % 60, F.floor(seconds / 3600).cast("long")
    hundredths = F.lpad(F.floor((t % 1000 + 5) / 10).cast("long").cast("string"), 2, "0")
    hundredths = F.when(t % 1000 >= 995, F.lit("100")).otherwise(hundredths)
    tail = F.when(s != 0, F.concat(s.cast("string"), F.lit("."), hundredths, F.lit(" seconds (")).cast("string")).otherwise(F.concat((t % 1000).cast("string"), F.lit(" milliseconds (")))
    return F.concat(
        F.when(h != 0, F.concat(h.cast("string"), F.lit(" hours, "))).otherwise(F.lit("")),
        F.when(m != 0, F.concat(m.cast("string"), F.lit(" minutes, "))).otherwise(F.lit("")),
        tail, t.cast("string"), F.lit(" ms)"),
    )
