"""Format-preserving pseudonyms: a keyed Feistel network over the digits and letters of a value.

Every digit is replaced by a digit and every letter by a letter of its case and script block; separators stay.  Values that
differ only in separators or case get pseudonyms that differ only there, so equal values stay linked across documents.
Names are permuted word by word, so that a surname alone stays linked to the full name.
The permutation is one-to-one on strings of one pattern and is undone by ``restore`` with the same key.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from functools import lru_cache

ROUNDS = 8


def _round(key: bytes, number: int, pattern: str, side: tuple[int, ...]) -> int:
    text = f"{number}|{pattern}|{','.join(map(str, side))}".encode()
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=16).digest(), "big")


def _number(digits: tuple[int, ...], bases: tuple[int, ...]) -> int:
    n = 0
    for digit, base in zip(digits, bases):
        n = n * base + digit
    return n


def _digits(n: int, bases: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for base in reversed(bases):
        n, digit = divmod(n, base)
        out.append(digit)
    return tuple(reversed(out))


def _size(bases: tuple[int, ...]) -> int:
    size = 1
    for base in bases:
        size *= base
    return size


def _network(values: tuple[int, ...], bases: tuple[int, ...], key: bytes, forward: bool) -> tuple[int, ...]:
    """An unbalanced network: each round shifts one half by a keyed function of the other."""
    if len(values) < 2:
        shift = _round(key, 0, str(bases), ())
        return tuple((v + (shift if forward else -shift)) % b for v, b in zip(values, bases))
    half = len(values) // 2
    a, b, bases_a, bases_b = values[:half], values[half:], bases[:half], bases[half:]
    pattern = ",".join(map(str, bases))
    for number in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        if number % 2 == 0:
            shift = _round(key, number, pattern, b)
            a = _digits((_number(a, bases_a) + (shift if forward else -shift)) % _size(bases_a), bases_a)
        else:
            shift = _round(key, number, pattern, a)
            b = _digits((_number(b, bases_b) + (shift if forward else -shift)) % _size(bases_b), bases_b)
    return a + b


@lru_cache(maxsize=4_000)
def _block(number: int) -> tuple[str, str]:
    """Of 64 code points the letters with two cases, in lower case, and all other letters."""
    two, other = [], []
    for code in range(number * 64, number * 64 + 64):
        c = chr(code)
        if c.isupper() and len(c.lower()) == 1 and c.lower().upper() == c and c.lower() != c:
            continue  # stands beside its small letter
        if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c and c.upper() != c:
            two.append(c)
        elif unicodedata.category(c)[0] == "L":
            other.append(c)
    return "".join(two), "".join(other)


@lru_cache(maxsize=20_000)
def _kind(c: str) -> tuple[str, str, bool] | None:
    """(alphabet, the letter in it, whether it is a capital) of a digit or letter; None for all else."""
    if "0" <= c <= "9":
        return "0123456789", c, False
    if "a" <= c.lower() <= "z" and len(c.lower()) == 1 and c.isascii():
        return "abcdefghijklmnopqrstuvwxyz", c.lower(), c.isupper()
    small = c.lower()
    capital = c.isupper() and len(small) == 1 and small.upper() == c and small != c
    for letters in _block(ord(small if capital else c) // 64):
        if (small if capital else c) in letters:
            return letters, small if capital else c, capital
    return None


def _permute(value: str, key: bytes, forward: bool) -> str:
    kinds = [_kind(c) for c in value]
    held = [k for k in kinds if k]
    if not held:
        return value
    new = iter(_network(tuple(k[0].index(k[1]) for k in held), tuple(len(k[0]) for k in held), key, forward))
    out = []
    for c, k in zip(value, kinds):
        letter = k[0][next(new)] if k else c
        out.append(letter.upper() if k and k[2] else letter)
    return "".join(out)


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=50_000)
def pseudonym(value: str, key: bytes) -> str:
    """The pseudonym of a value, in its own format."""
    return _permute(value, key, True)


def restore(value: str, key: bytes) -> str:
    return _permute(value, key, False)


def name_pseudonym(value: str, key: bytes, forward: bool = True) -> str:
    """A name's pseudonym, made of those of its words; particles stay, as they are words of the language."""
    one = pseudonym if forward else restore
    return _WORD.sub(lambda m: m[0] if m[0].lower() in PARTICLES else one(m[0], key), value)


# Particles of names.
PARTICLES = frozenset("von van der den dem vom zu zur de la du des le ter ten".split())


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date_pseudonym(day: datetime.date, key: bytes, forward: bool = True) -> datetime.date:
    """Another day of the same two centuries: the day's number is permuted, cycle walking keeps it in range."""
    span = _LAST - _FIRST + 1
    n = day.toordinal() - _FIRST
    if not 0 <= n < span:
        raise ValueError("dates from 1900 to 2099 can be permuted")
    while True:
        n = _number(_network(_digits(n, (10, 10, 10, 10, 10)), (10, 10, 10, 10, 10), key, forward), (10, 10, 10, 10, 10))
        if n < span:
            return datetime.date.fromordinal(_FIRST + n)
