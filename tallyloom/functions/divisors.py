"""All divisors of whole numbers up to 64 bits."""

from __future__ import annotations

import math

_SMALL = [p for p in range(2, 1000) if all(p % q for q in range(2, math.isqrt(p) + 1))]
#: These bases decide primality of every number below 3.3e24.
_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)


def _is_prime(n: int) -> bool:
    if n < 1_000_000:
        return n > 1 and all(n % p for p in _SMALL if p * p <= n)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in _BASES:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _factor(n: int) -> int:
    """A proper factor of a composite number without factors below 1000, by Pollard's rho."""
    root = math.isqrt(n)
    if root * root == n:
        return root
    c = 1
    while True:
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(abs(x - y), n)
        if d != n:
            return d
        c += 1


def divisors(n: int) -> list[int]:
    """The divisors of n from 1 to n itself, in no order; none for 0."""
    n = abs(n)
    if not n:
        return []
    primes: list[int] = []
    for p in _SMALL:
        if p * p > n:
            break
        while n % p == 0:
            primes.append(p)
            n //= p
    rest = [n] if n > 1 else []
    while rest:
        m = rest.pop()
        if _is_prime(m):
            primes.append(m)
        else:
            f = _factor(m)
            rest += [f, m // f]
    found = [1]
    for p in sorted(set(primes)):
        found = [d * p**k for d in found for k in range(primes.count(p) + 1)]
    return found
