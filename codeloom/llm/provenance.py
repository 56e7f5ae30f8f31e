"""Files that nobody in the project wrote by hand: generated, minified, vendored, or data kept as code.

1. ``fingerprints``: each file, and each known vendor item, is lexed.  Shingles of five tokens, identifiers masked,
   give MinHash bands of the whole file; windows of the same text with literals masked too are its units.
2. ``clusters``: files that share a band are compared with the first files of that band, and so on until no two of
   its files that haven't met could join two clusters, all shingles verified.  A cluster that spans repositories, or holds a vendor item, is vendored.
3. ``families``: windows in which few masked shingles recur with ever new names are units of one template.  They are
   banded and verified within their repository; a file that consists of such units is generated, and one whose units
   hold nothing but literals is a data blob.
4. ``tells``: what the files of these clusters have in common and others haven't.  Shingles of five words of comments, and
   folders, that mostly belong to clustered files, mark the files that have no second copy or no units.  No word list is
   used; the clusters teach which words and folders tell.
5. Minified text is told by its layout, for which the clusters have no sign.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.lexing import KEPT, classes, tokens, without_line_ends  # noqa: F401
from codeloom.llm.syntax import language
from codeloom.operators.components import connected_components
from codeloom.session import pin, spread

SHINGLE = 5
#: A band joins minima of masked and plain shingles: masked ones alone are half alike in any two files of one house style.
#: At the least similarities accepted (0.8 and 0.6) a band agrees with probability 0.083, one of 40 with 0.97.
BANDS, MASKED_ROWS, PLAIN_ROWS = 40, 2, 4
SIMILAR, PLAIN_SIMILAR = 0.8, 0.6
#: Files of fewer tokens have no text to compare; they are judged by what their comments and folders share with others.
LEAST_TOKENS = 20
#: Parities of a file's plain minima.  At a similarity of 0.6 two files differ in 26 of 128 on average (deviation 4.5), unrelated ones in 54 or more.
SKETCH_BITS, APART = 128, 40
#: The same of forms, for siblings: at 0.95 two files differ in 6 of 256 on average (deviation 2.5), at 0.8 in 26 (4.8).
FORM_BITS, FORM_APART = 256, 16
#: Kinds of bands; the last two bits of a band's number say which it is of.
KINDS = ("copy", "sibling", "unit")
#: Leads of a band in the first round, and how many times as many in each further one.
LEADS, MORE_LEADS = 4, 8
#: A window of WINDOW shingles holds units of one template if at most UNIT of them differ with names and literals masked.
WINDOW, UNIT, PROSE = 60, 0.6, 0.25
#: A family is two different texts of one masked form or more; a file of which FAMILY_SHARE of the windows are in families is generated.
FAMILY, FAMILY_SIMILAR, FAMILY_SHARE = 2, 0.8, 0.6
FAMILY_BANDS, FAMILY_ROWS = 8, 4
#: Whole files of one repository whose forms agree to SIBLING_SIMILAR and whose plain texts don't are a family if they are
#: SIBLINGS or more; shorter texts than SIBLING_TOKENS are of one form by chance.  A band of 24 minima agrees with probability 0.29 at
#: 0.95, one of 10 with 0.97, and hardly ever below 0.8.
SIBLINGS, SIBLING_SIMILAR, SIBLING_TOKENS, SIBLING_BANDS, SIBLING_ROWS = 3, 0.95, 150, 10, 24
#: Windows of literals: tokens, the literals they hold at least, and the share of a file's windows that makes it data.
LITERAL_WINDOW, LITERALS, LITERAL_SHARE = 16, 4, 0.5
#: Cuts of a text by content: one in CHUNK shingles ends a chunk.  A file is a piece of a vendor item that holds CONTAINED of its shingles.
CHUNK, MAYBE_CONTAINED, CONTAINED = 16, 0.5, 0.9
#: Words of comments, or a folder, tell if so many files have them and this share of those is in clusters.
TELL_LEAST, TELL_SHARE, FOLDER_LEAST, FOLDER_SHARE = 4, 0.25, 8, 0.4
LONG_LINE, LONG_SHARE, DENSE = 200, 0.7, 0.1
#: Files whose shingles are hashed together.
FILES_AT_ONCE = 512
_OWNER_BITS = 9

#: Which class letters are words or literals.
_WORD = np.zeros(1 << 16, dtype=bool)
_WORD[[ord(c) for c in "nsitrM"]] = True
_WORD[0xE000:0xF900] = True
_LITERAL = np.zeros(1 << 16, dtype=bool)
_LITERAL[[ord(c) for c in "ns"]] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(max(SHINGLE, MASKED_ROWS, PLAIN_ROWS, SIBLING_ROWS))], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_NAME, _VALUE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EACH = np.arange(BANDS, dtype=np.uint64)
_MASK = np.uint64((1 << 64 - _OWNER_BITS) - 1)


def _crc(token: str) -> int:
    raw = token.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


@cache
def _code() -> Callable[[str], int]:
    """A hash that is the same in all workers: the language's own where its seed is fixed, as Spark does by default."""
    return hash if os.environ.get("PYTHONHASHSEED", "random").isdigit() else _crc


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


#: Odd factors, each of which orders the shingles of a unit anew.
_ORDERS = _mix(np.arange(1, FAMILY_ROWS * FAMILY_BANDS + 1, dtype=np.uint64)) | np.uint64(1)
#: The shingle of five masked names.
_PROSE = _mix((np.repeat(_NAME, SHINGLE) * _POWERS[:SHINGLE]).sum(keepdims=True, dtype=np.uint64))[0] >> np.uint64(_OWNER_BITS)


def words_of(found: list[str], kinds: list[str]) -> tuple[list[str], str]:
    """Tokens and their class letters without comments and line ends."""
    return [t for t, k in zip(found, kinds) if k and k != "N"], "".join(kinds).replace("N", "")


def coded(words: list[str], row: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens with identifiers masked, of the plain tokens, and the class letters."""
    plain = np.fromiter(map(_code(), words), dtype=np.int64, count=len(words)).view(np.uint64)
    letters = np.frombuffer(row.encode("utf-16-le"), dtype=np.uint16)
    return np.where(letters == ord("i"), _NAME, plain), plain, letters


class _Numbers(dict):
    """Token text to its number in a lexicon, filled as tokens turn up."""

    def __init__(self, lang: str, lexicon: _Lexicon):
        super().__init__()
        self.lang, self.lexicon = lang, lexicon

    def __missing__(self, token: str) -> int:
        self[token] = out = self.lexicon.add(classes(self.lang, [token])[0] or "N", token)
        return out


class _Lexicon:
    """Numbers of tokens, and by number the class letter, ``N`` for what isn't code, the code, and whether it is a comment with words."""

    def __init__(self):
        self.numbers: dict[str, _Numbers] = {}
        self.n, self.letters, self.codes, self.comment = 0, np.zeros(1 << 16, dtype=np.uint16), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=bool)

    def add(self, letter: str, token: str) -> int:
        n = self.n
        if n == len(self.letters):
            self.letters, self.codes, self.comment = (np.concatenate([x, np.zeros_like(x)]) for x in (self.letters, self.codes, self.comment))
        self.letters[n], self.codes[n], self.comment[n] = ord(letter), _code()(token), letter == "N" and len(token) > 4 and not token.isspace()
        self.n = n + 1
        return n

    def of(self, lang: str) -> _Numbers:
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(lang, self)
        return self.numbers[lang]

    def forget(self) -> None:
        """To be called between texts only: numbers given before mean nothing after."""
        if self.n > KEPT:
            self.n, self.numbers = 0, {}


_LEXICON = _Lexicon()


class Lexed:
    """Files lexed together: their codes one after the other, without comments and line ends, and the class letters.

    ``sizes`` says how many tokens each file has, ``quiet`` where in ``found`` the others stand, all files in a row, and
    ``before`` how many tokens of code stand before each token and at the end.
    """

    def __init__(self, langs: list[str], found: list[list[str]]):
        _LEXICON.forget()
        self.found, self.all_sizes = found, np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        numbers = [np.fromiter(map(_LEXICON.of(lang).__getitem__, own), dtype=np.int64, count=len(own)) for lang, own in zip(langs, found)]
        self.numbers = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        letters = _LEXICON.letters[self.numbers]
        code = letters != ord("N")
        self.before = np.append(0, np.cumsum(code))
        self.ends = np.cumsum(self.all_sizes)
        self.sizes = self.before[self.ends] - self.before[self.ends - self.all_sizes]
        self.quiet = np.flatnonzero(~code)
        self.letters = letters[code]
        self.plain = _LEXICON.codes[self.numbers[code]].view(np.uint64)
        self.hidden = np.where(self.letters == ord("i"), _NAME, self.plain)

    def forms(self) -> np.ndarray:
        return np.where(_LITERAL[self.letters], _VALUE, self.hidden)

    def remarks(self) -> tuple[list[set[int]], list[set[int]]]:
        """Of each file the word shingles of the comments before the first token, and of all comments."""
        head: list[set[int]] = [set() for _ in self.found]
        said: list[set[int]] = [set() for _ in self.found]
        at = self.quiet[_LEXICON.comment[self.numbers[self.quiet]]]
        file = np.searchsorted(self.ends, at, side="right")
        start = (self.ends - self.all_sizes)[file]
        for f, k, first in zip(file.tolist(), (at - start).tolist(), (self.before[at] == self.before[start]).tolist()):
            words = _COMMENTS[self.found[f][k]]
            said[f].update(words)
            if first:
                head[f].update(words)
        return head, said


def lexed(lang: str, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``coded`` gives for the tokens without comments and line ends, and the places of those."""
    one = Lexed([lang], [found])
    return one.hidden, one.plain, one.letters, one.quiet


class Layout:
    """Where the shingles of files of so many tokens lie; a file of fewer than five counts as filled up with zeros."""

    def __init__(self, sizes: np.ndarray):
        self.counts = np.maximum(sizes, SHINGLE) - SHINGLE + 1
        self.starts = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(sizes)), self.counts)
        filled = self.counts + SHINGLE - 1
        begin = np.cumsum(filled) - filled
        self.at = np.arange(len(self.owner)) + (begin - self.starts)[self.owner]
        self.high = self.owner.astype(np.uint64) << np.uint64(64 - _OWNER_BITS)
        self.spread = None
        if (filled != sizes).any():
            self.spread = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        self.total = int(filled.sum())

    def fill(self, flat: np.ndarray) -> np.ndarray:
        if self.spread is None:
            return flat
        out = np.zeros(self.total, dtype=np.uint64)
        out[self.spread] = flat
        return out


class Shingles:
    """The shingles of up to FILES_AT_ONCE files.

    ``placed`` are the hashes in the order of the texts, ``hashes`` the distinct ones of each file, sorted.  ``owner``
    and ``set_owner`` say whose a hash is, ``starts`` and ``bounds`` where each file's hashes begin.  A file
    of fewer than five tokens counts as filled up with zeros.
    """

    def __init__(self, codes: list[np.ndarray] | np.ndarray, layout: Layout | None = None):
        """``codes`` of each file, or of all in a row and how they lie."""
        if layout is None:
            layout = Layout(np.array([len(c) for c in codes], dtype=np.int64))
            codes = np.concatenate(codes) if len(codes) else np.zeros(0, dtype=np.uint64)
        flat = layout.fill(codes)
        n = max(0, len(flat) - SHINGLE + 1)
        hashes = flat[:n].copy()
        for k in range(1, SHINGLE):
            hashes += flat[k : k + n] * _POWERS[k]
        self.counts, self.starts, self.owner = layout.counts, layout.starts, layout.owner
        self.placed = _mix(hashes[layout.at]) >> np.uint64(_OWNER_BITS)
        self.keys = layout.high | self.placed
        keys = np.sort(self.keys)
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.set_owner = (keys >> np.uint64(64 - _OWNER_BITS)).astype(np.int64)
        self.hashes = keys & _MASK
        self.bounds = np.searchsorted(self.set_owner, np.arange(len(layout.counts) + 1))

    def of(self, file: int) -> np.ndarray:
        return self.hashes[self.bounds[file] : self.bounds[file + 1]]

    def before(self) -> np.ndarray:
        """Of each placed hash where it stood last in its file, -1 if nowhere."""
        keys = self.keys
        order = np.argsort(keys, kind="stable")
        out = np.full(len(keys), -1, dtype=np.int64)
        own = keys[order]
        same = own[1:] == own[:-1]
        out[order[1:][same]] = order[:-1][same]
        return out

    def minima(self, bins: int) -> np.ndarray:
        """One permutation: the range of the hashes is cut into equal bins, whose minima are a file's signature (files, bins).

        An empty bin takes the minimum of the next filled one, marked by the distance.
        """
        files = len(self.bounds) - 1
        of = ((self.hashes >> np.uint64(32 - _OWNER_BITS)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        at = np.full(files * bins, len(self.hashes))
        place = self.set_owner * bins + of
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=np.int64)
        at[place[first]] = first
        at = np.minimum.accumulate(at.reshape(files, bins)[:, ::-1], axis=1)[:, ::-1]
        at = np.where(at >= self.bounds[1:, None], self.bounds[:-1, None], at)
        off = of[at] - np.arange(bins)
        off += (off < 0) * bins
        return _mix(self.hashes[at] + off.astype(np.uint64) * _MIX)

    def sums(self) -> np.ndarray:
        """One number per file that stands for its set of shingles."""
        return np.add.reduceat(_mix(self.hashes), self.bounds[:-1])


def band_keys(hidden: Shingles, plain: Shingles) -> np.ndarray:
    """(files, BANDS) keys, each of some minima of the masked and some of the plain shingles.

    A band's minima lie BANDS bins apart: neighbouring empty bins of a small file take the same minimum.
    """
    a = hidden.minima(BANDS * MASKED_ROWS).reshape(-1, MASKED_ROWS, BANDS) * _POWERS[:MASKED_ROWS, None]
    b = plain.minima(BANDS * PLAIN_ROWS).reshape(-1, PLAIN_ROWS, BANDS) * _POWERS[:PLAIN_ROWS, None]
    return _mix(a.sum(axis=1, dtype=np.uint64) + _mix(b.sum(axis=1, dtype=np.uint64)) + _EACH).view(np.int64)


def sibling_keys(forms: Shingles) -> np.ndarray:
    """(files, SIBLING_BANDS) keys, each of some minima of the masked forms alone."""
    a = forms.minima(SIBLING_BANDS * SIBLING_ROWS).reshape(-1, SIBLING_ROWS, SIBLING_BANDS) * _POWERS[:SIBLING_ROWS, None]
    return _mix(a.sum(axis=1, dtype=np.uint64) + _EACH[:SIBLING_BANDS]).view(np.int64)


def sketches(of: Shingles, bits: int) -> np.ndarray:
    """(files, bits / 64) words of the parities of the minima."""
    return np.packbits((of.minima(bits) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def units(forms: Shingles, plain: Shingles) -> tuple[np.ndarray, pa.Array]:
    """Windows of each file, and its units: windows in which few masked shingles (``forms``) recur.

    Windows that mostly hold names in a row are prose, not program text, and no units.  A unit is the set of its
    masked shingles; ``texts`` says how many plain texts each of them stands for
    in all such windows of the file together, and ``windows`` how many of them there are.
    """
    n_windows = np.maximum(1, (forms.counts - WINDOW) // (WINDOW // 2) + 1)
    first = np.cumsum(n_windows) - n_windows
    file = np.repeat(np.arange(len(n_windows)), n_windows)
    start = forms.starts[file] + (np.arange(len(file)) - first[file]) * (WINDOW // 2)
    end = np.minimum(start + WINDOW, (forms.starts + forms.counts)[file])
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    at = np.minimum(at, max(0, len(forms.placed) - 1))
    fresh = inside & (forms.before()[at] < start[:, None])
    few = fresh.sum(axis=1) <= UNIT * (end - start)
    few &= (end - start) >= LEAST_TOKENS - SHINGLE + 1
    few &= (inside & (forms.placed == _PROSE)[at]).sum(axis=1) <= PROSE * (end - start)
    few &= (np.bincount(file, weights=few, minlength=len(n_windows)) >= FAMILY_SHARE * n_windows)[file]  # others can't reach the share
    few = np.flatnonzero(few)
    at, fresh = at[few], fresh[few]
    keys = np.where(fresh, _mix(forms.placed)[at], np.uint64(0)).sum(axis=1, dtype=np.uint64)
    found: dict[tuple[int, int], list[int]] = {}
    for k, (owner, key) in enumerate(zip(file[few].tolist(), keys.tolist())):
        found.setdefault((owner, key), []).append(k)
    heads = np.array([windows[0] for windows in found.values()], dtype=np.int64)
    # a window's first shingle is fresh and stands for those that aren't
    own = forms.placed[np.where(fresh, at, at[:, :1])[heads]]
    minima = np.empty((len(heads), len(_ORDERS)), dtype=np.uint64)
    for k, order in enumerate(_ORDERS):
        minima[:, k] = _mix(own * order).min(axis=1)
    minima = minima.reshape(-1, FAMILY_ROWS, FAMILY_BANDS) * _POWERS[:FAMILY_ROWS, None]
    bands = _mix(minima.sum(axis=1, dtype=np.uint64) + _EACH[:FAMILY_BANDS])
    shingles = [np.sort(forms.placed[at[k][fresh[k]]]) for k in heads]
    texts = []
    for windows, each in zip(found.values(), shingles):
        all_plain = np.sort(np.concatenate([plain.placed[start[w] : end[w]] for w in few[windows]]))
        texts.append((1 + np.count_nonzero(all_plain[1:] != all_plain[:-1])) / len(each))
    columns = {
        "key": pa.array((keys[heads] ^ np.uint64(1 << 63)).view(np.int64)),
        "windows": pa.array([len(x) for x in found.values()], pa.int32()),
        "texts": pa.array(texts, pa.float64()),
        "shingles": _lists(shingles),
        "bands": _lists(list(bands)),
    }
    held = np.bincount(np.array([owner for owner, _ in found], dtype=np.int64), minlength=len(n_windows))
    return n_windows, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _lists(rows: list[np.ndarray], absent: np.ndarray | None = None) -> pa.Array:
    """An array of longs per row, null where ``absent``."""
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    ends = np.append(0, np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)), mask=None if absent is None else pa.array(absent))


def literal_shares(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each file the share of its short windows that hold literals and no name or keyword, by the class letters of all in a row."""
    literal, named = _LITERAL[flat], _WORD[flat]
    literals, others = (np.concatenate([[0], np.cumsum(x)]) for x in (literal, named & ~literal))
    n = np.maximum(1, (sizes - LITERAL_WINDOW) // (LITERAL_WINDOW // 2) + 1)
    file = np.repeat(np.arange(len(sizes)), n)
    begin = np.cumsum(sizes) - sizes
    start = begin[file] + (np.arange(len(file)) - (np.cumsum(n) - n)[file]) * (LITERAL_WINDOW // 2)
    stop = np.minimum(start + LITERAL_WINDOW, (begin + sizes)[file])
    alone = (others[stop] == others[start]) & (literals[stop] - literals[start] >= LITERALS)
    return np.bincount(file, weights=alone, minlength=len(sizes)) / n


_WORDS = re.compile(r"[^\W\d_]+|\d+")
_KEPT_COMMENTS = 100_000


class Comments(dict):
    """Comment text to the hashes of the shingles of five words of its lines, numbers masked; filled as comments turn up."""

    def __missing__(self, comment: str) -> tuple[int, ...]:
        if len(self) > _KEPT_COMMENTS:
            self.clear()
        found = set()
        for line in comment.lower().split("\n"):
            words = ["0" if w[0].isdigit() else w for w in _WORDS.findall(line)]
            if len(words) - words.count("0") < 2:
                continue
            words = ["^", *words, "$"]
            found.update(" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))
        self[comment] = out = tuple(map(_code(), found))
        return out


_COMMENTS = Comments()
_UNITS = "units array<struct<key: long, windows: int, texts: double, shingles: array<long>, bands: array<long>>>"
FINGERPRINT = f"file_path string, project string, lang string, n_tokens int, exact long, bands array<long>, siblings array<long>, sketch array<long>, n_plain int, n_forms int, chunks array<long>, n_windows int, {_UNITS}, literal double, minified boolean, head array<long>, said array<long>"
_COLUMNS = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<.*?>+", "", FINGERPRINT))


def minified(text: str) -> bool:
    """Most of the text stands in overlong lines that hold hardly a blank."""
    lengths = list(map(len, text.split("\n")))
    if max(lengths) <= LONG_LINE or sum(x for x in lengths if x > LONG_LINE) < LONG_SHARE * len(text):
        return False
    return text.count(" ") + text.count("\n") + text.count("\t") <= DENSE * len(text)


def chunks(plain: Shingles) -> list[np.ndarray]:
    """Of each file the hashes of its chunks, cut where the text says so, so that a piece has most chunks of its whole."""
    ends = np.flatnonzero(plain.placed % np.uint64(CHUNK) == 0)
    if not len(ends):
        return [np.zeros(0, dtype=np.int64)] * len(plain.counts)
    keys = _mix(np.add.reduceat(plain.placed[: ends[-1] + 1], np.append(0, ends[:-1] + 1)))  # what follows the last cut is no chunk
    owner = plain.owner[ends]
    inner = np.append(False, owner[1:] == owner[:-1])  # the first chunk of a file begins where the file does, not where the text says so
    keys, owner = keys[inner].view(np.int64), owner[inner]
    at = np.searchsorted(owner, np.arange(len(plain.counts) + 1))
    return [np.unique(keys[a:b]) for a, b in zip(at[:-1], at[1:])]


def _texts(batch: pa.RecordBatch) -> tuple[list[str], Lexed]:
    """The texts of a batch (lang, content), and the same lexed."""
    langs, texts = batch.column("lang").to_pylist(), [(text or "").replace("\r\n", "\n") for text in batch.column("content").to_pylist()]
    return texts, Lexed(langs, list(map(without_line_ends, langs, texts)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, dtype=np.int64)
    for whole in batches:
        for start in range(0, whole.num_rows, FILES_AT_ONCE):
            batch = whole.slice(start, FILES_AT_ONCE)
            texts, files = _texts(batch)
            layout = Layout(files.sizes)
            masked, exact, form = (Shingles(x, layout) for x in (files.hidden, files.plain, files.forms()))
            usable = files.sizes >= LEAST_TOKENS
            head, said = files.remarks()
            n_windows, unit = units(form, exact)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("file_path", "project", "lang")),
                    pa.array(files.sizes, pa.int32()),
                    pa.array(_mix(exact.sums() + masked.sums()).view(np.int64)),
                    _lists([k if u else none for k, u in zip(band_keys(masked, exact), usable)]),
                    _lists([k if n >= SIBLING_TOKENS else none for k, n in zip(sibling_keys(form), files.sizes)]),
                    _lists(list(np.concatenate([sketches(exact, SKETCH_BITS), sketches(form, FORM_BITS)], axis=1))),
                    *(pa.array(np.diff(x.bounds), pa.int32()) for x in (exact, form)),
                    _lists([k if u else none for k, u in zip(chunks(exact), usable)]),
                    pa.array(n_windows, pa.int32()),
                    unit,
                    pa.array(literal_shares(files.letters, files.sizes)),
                    pa.array(list(map(minified, texts)), pa.bool_()),
                    *(_lists([np.fromiter(x, dtype=np.int64, count=len(x)) for x in each]) for each in (head, said)),
                ],
                _COLUMNS,
            )


def fingerprints(files: DataFrame) -> DataFrame:
    """Bands, units, comments and layout of each row of (file_path, project, lang, content)."""
    return spread(files.select("file_path", "project", "lang", "content")).mapInArrow(_fingerprints, FINGERPRINT)


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, FILES_AT_ONCE):
            batch = whole.slice(start, FILES_AT_ONCE)
            _, files = _texts(batch)
            owner = np.repeat(np.arange(len(files.sizes)), files.sizes)
            out = [batch.column("fid")]
            for codes, kind in ((files.hidden, "copy"), (files.plain, "copy"), (files.forms(), "sibling")):
                asked = np.array(batch.column(kind).to_pylist(), dtype=bool)
                of = Shingles(codes[asked[owner]], Layout(files.sizes[asked]))
                held = np.zeros(len(asked), dtype=np.int64)
                held[asked] = np.diff(of.bounds)
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(of.hashes.view(np.int64)), mask=pa.array(~asked)))
            yield pa.RecordBatch.from_arrays(out, ["fid", "hidden", "plain", "form"])


def shingle_sets(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fid, hidden, plain, form): all distinct shingles of the files named in ``wanted`` (fid, kind), lexed again; no text is kept with the bands.

    Only what the kinds of a file ask for is filled: hidden and plain for a copy, form for a sibling.
    """
    asked = pin(wanted.groupBy("fid").agg(F.max(F.col("kind") == "copy").alias("copy"), F.max(F.col("kind") == "sibling").alias("sibling")), "asked")
    texts = files.select(F.xxhash64("file_path").alias("fid"), "lang", "content").join(asked, "fid").dropDuplicates(["fid"])
    return texts.mapInArrow(_all_shingles, "fid long, hidden array<long>, plain array<long>, form array<long>")


def near_enough(a: str, b: str, least: float) -> Column:
    """Whether two sets that aren't both empty have a Jaccard similarity of ``least`` (in hundredths) or more.

    Multiplied out, so that the common part is computed once, and only where the sizes allow it.
    """
    per, of_a, of_b = round(100 * least), F.size(a).cast("long"), F.size(b).cast("long")
    return (F.least(of_a, of_b) * 100 >= F.greatest(of_a, of_b) * per) & (F.size(F.array_intersect(a, b)).cast("long") * (100 + per) >= (of_a + of_b) * per)


def settle_bands(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], parts: Callable[[DataFrame], DataFrame], traits: DataFrame | None = None, likely: str = "true") -> DataFrame:
    """What ``verify`` gives for pairs (fid, lead, kind) among members of one band and kind of ``keys`` (fid, band, kind).

    The first members of each band are its leads and meet all others; then the next ones do, until what is left of the
    band is one part.  ``parts`` says of the pairs verified so far which part (fid, kind, part) a member is in; members of one part
    needn't meet, all others do, so a family of any size gives about as many pairs as it has members times bands, and
    no pair that would join two parts is left out.  The smaller parts of a band lead first.  ``verify`` keeps the close ones of the pairs for which ``likely``
    holds, a condition on kind and the ``traits`` (fid, t) of the two, t1 and t2.
    """
    leads, found = LEADS, None
    own = ["t"] if traits is not None else []
    band = Window.partitionBy("band")
    packed = F.col("band").bitwiseAND(~3).bitwiseOR(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1)
    ranked = keys.select("fid", packed.alias("band")).select("band", "fid", F.lead("fid").over(band.orderBy("fid")).alias("_next"), F.row_number().over(band.orderBy("fid")).alias("rank"))
    kind = F.array(*map(F.lit, KINDS))[F.col("band").bitwiseAND(3)]
    left = ranked.where("rank > 1 or _next is not null").select("band", kind.alias("kind"), "fid", F.col("fid").alias("part"), "rank")
    if own:
        left = pin(left, "shared").join(traits, "fid")
    while True:
        left = pin(left, "ranked")
        lead = left.where(F.col("rank") <= leads).select("band", F.col("fid").alias("lead"), F.col("rank").alias("_r"), F.col("part").alias("_p"), *[F.col(c).alias("t2") for c in own])
        met = left.withColumnsRenamed({c: "t1" for c in own}).join(lead, "band").where(f"rank > _r and part <> _p and ({likely})").select("fid", "lead", "kind").distinct()
        good = pin(verify(met), "verified")
        found = good if found is None else found.unionByName(good)
        rest = left.where(F.col("rank") > leads)
        if rest.where(F.col("rank") > leads + 1).isEmpty():
            return found  # all members of all bands have met
        known = parts(found).select("fid", "kind", F.col("part").alias("_p"))
        rest = rest.join(known, ["fid", "kind"], "left").select("band", "kind", "fid", F.coalesce("_p", "fid").alias("part"), *own)
        several = rest.groupBy("band").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select("band")
        sized = rest.join(several, "band", "left_semi").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("band", "part")))
        left = sized.select("band", "kind", "fid", "part", *own, F.row_number().over(band.orderBy("_n", "part", "fid")).alias("rank"))
        leads *= MORE_LEADS


def parts_by_kind(links: DataFrame) -> DataFrame:
    """(fid, kind, part): the components of the pairs (fid, lead, kind), in one run: the ids of siblings are turned over, so that theirs are apart."""
    turned = links.select(*[F.expr(f"if(kind = 'copy', {c}, ~{c})").alias(c) for c in ("fid", "lead")], "kind")
    found = connected_components(turned, "fid", "lead")
    sibling = turned.where("kind <> 'copy'").select(F.explode(F.array("fid", "lead")).alias("id")).distinct().withColumn("_s", F.lit(True))
    return found.join(sibling, "id", "left").select(F.expr("if(_s, ~id, id)").alias("fid"), F.expr("if(_s, 'sibling', 'copy')").alias("kind"), F.col("component").alias("part"))


def clusters(prints: DataFrame, files: DataFrame, of_units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fid, cluster) of files with a verified near-copy, and (fid) of files that are whole-file siblings in their repository.

    ``fid`` is the 64-bit hash of the path, of which ``prints`` has one row each.  Files of the same shingles and language form a class with one
    representative; representatives meet the leads of each of their bands (``settle_bands``), never all each other in
    pairs.  Copies of one text count once among siblings, and texts that share their names are edits of one, not siblings.
    Files that consist of units of a family (``of_units``, by fid) need no siblings.
    """
    usable = prints.where(F.size("bands") > 0).select(F.xxhash64("file_path").alias("fid"), "project", "lang", "exact", "bands", "siblings", "sketch", "n_plain", "n_forms")
    each = usable.select("lang", "exact", "fid")
    reps = each.groupBy("lang", "exact").agg(F.min("fid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = pin(each.join(reps, ["lang", "exact"]).where("fid <> rep").select("fid", "rep"), "copies")
    single = usable.join(copies.select("fid"), "fid", "left_anti")
    keys = single.select("fid", F.explode("bands").alias("band"), F.lit("copy").alias("kind"))
    traits = single.select("fid", F.struct("sketch", "n_plain", "n_forms").alias("t"))
    if of_units is not None:
        single = single.join(of_units, "fid", "left_anti")
    alike = single.select("fid", "project", "lang", F.explode("siblings").alias("b")).select("fid", F.xxhash64("b", "project", "lang").alias("band"), F.lit("sibling").alias("kind"))
    keys = keys.unionByName(alike)
    words = [f"bit_count(t1.sketch[{k}] ^ t2.sketch[{k}])" for k in range((SKETCH_BITS + FORM_BITS) // 64)]
    plain, forms = " + ".join(words[: SKETCH_BITS // 64]), " + ".join(words[SKETCH_BITS // 64 :])
    # sets of sizes too far apart can't be that similar
    sizes = lambda n, least: f"least(t1.{n}, t2.{n}) >= {least} * greatest(t1.{n}, t2.{n})"
    forms, plain = f"{sizes('n_forms', SIBLING_SIMILAR)} and {forms}", f"{sizes('n_plain', PLAIN_SIMILAR)} and {plain}"
    near = f"if(kind = 'sibling', {forms} <= {FORM_APART} and not ({plain} <= {APART}), {plain} <= {APART})"

    def verify(pairs: DataFrame) -> DataFrame:
        likely = pin(pairs, "likely")
        sets = pin(shingle_sets(files, likely.select(F.explode(F.array("fid", "lead")).alias("fid"), "kind")), "sets")
        own = sets.where("plain is not null")
        a = own.select("fid", F.col("hidden").alias("h1"), F.col("plain").alias("p1"))
        b = own.select(F.col("fid").alias("lead"), F.col("hidden").alias("h2"), F.col("plain").alias("p2"))
        close = likely.where("kind = 'copy'").join(a, "fid").join(b, "lead").where(near_enough("p1", "p2", PLAIN_SIMILAR) & near_enough("h1", "h2", SIMILAR))
        own = sets.where("form is not null")
        a, b = own.select("fid", F.col("form").alias("f1")), own.select(F.col("fid").alias("lead"), F.col("form").alias("f2"))
        alike = likely.where("kind = 'sibling'").join(a, "fid").join(b, "lead").where(near_enough("f1", "f2", SIBLING_SIMILAR))
        return close.select("fid", "lead", "kind").unionByName(alike.select("fid", "lead", "kind"))

    found = settle_bands(keys, verify, parts_by_kind, traits, near)
    # one run for both kinds: the ids of siblings are turned over, so that their components are apart
    links = copies.unionByName(found.select(F.expr("if(kind = 'copy', fid, ~fid)").alias("fid"), F.expr("if(kind = 'copy', lead, ~lead)").alias("rep"), "kind"), allowMissingColumns=True)
    links = pin(links, "links")
    parts = pin(connected_components(links, "fid", "rep"), "components")
    turned = links.where("kind = 'sibling'").select(F.explode(F.array("fid", "rep")).alias("id")).distinct()
    joined = parts.join(turned, "id", "left_anti").select(F.col("id").alias("fid"), F.col("component").alias("cluster"))
    kin = parts.join(turned, "id", "left_semi")
    large = kin.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SIBLINGS).select("component")
    kin = kin.join(large, "component", "left_semi").select(F.bitwise_not("id").alias("fid"))
    return joined, kin.unionByName(copies.join(kin.select(F.col("fid").alias("rep")), "rep", "left_semi").select("fid"))


def contained(prints: DataFrame, files: DataFrame) -> DataFrame:
    """(fid) of files that are a piece of a vendor item: chunks they share name the pair, all shingles then decide."""
    own = prints.where(F.size("chunks") > 0).select(F.xxhash64("file_path").alias("fid"), "project", "lang", "chunks")
    parts = own.where(F.col("project") != VENDOR).select("fid", "lang", F.size("chunks").alias("n"), F.explode("chunks").alias("chunk"))
    items = pin(own.where(F.col("project") == VENDOR).select(F.col("fid").alias("lead"), "lang", F.explode("chunks").alias("chunk")), "items")
    shared = parts.join(items, ["lang", "chunk"]).groupBy("fid", "lead", "n").agg(F.count(F.lit(1)).alias("k"))
    pairs = pin(shared.where(F.col("k") >= F.col("n") * MAYBE_CONTAINED).select("fid", "lead"), "pieces")
    sets = pin(shingle_sets(files, pairs.select(F.explode(F.array("fid", "lead")).alias("fid"), F.lit("copy").alias("kind"))).select("fid", "plain"), "sets")
    both = pairs.join(sets, "fid").join(sets.select(F.col("fid").alias("lead"), F.col("plain").alias("whole")), "lead")
    return both.where(F.size(F.array_intersect("plain", "whole")) >= F.size("plain") * CONTAINED).select("fid").distinct()


def families(prints: DataFrame) -> DataFrame:
    """(fid, share): the share of a file's windows that are units of a family of its repository.

    Distinct units of a repository are banded by MinHash of their masked shingles and verified; a unit is of a
    family if it stands for FAMILY different texts of one form or more itself, or is linked to another.  Small projects need one file only.
    """
    own = prints.where(F.size("units") > 0).select(F.xxhash64("file_path").alias("fid"), "project", "lang", "n_windows", F.explode("units").alias("u"))
    place = ["project", "lang"]
    each = own.select("fid", "n_windows", F.xxhash64(F.coalesce("project", F.lit("")), "lang", "u.key").alias("unit"), "u.windows", "u.texts", *place, "u.shingles", "u.bands")
    sets = pin(each.groupBy("unit").agg(F.sum("texts").alias("texts"), *[F.first(c).alias(c) for c in ("shingles", "bands", *place)]), "units")
    keys = sets.select(F.col("unit").alias("fid"), F.explode("bands").alias("b"), *place).select("fid", F.xxhash64("b", *place).alias("band"), F.lit("unit").alias("kind"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("unit").alias("fid"), F.col("shingles").alias("a"))
        b = sets.select(F.col("unit").alias("lead"), F.col("shingles").alias("b"))
        return pairs.join(a, "fid").join(b, "lead").where(near_enough("a", "b", FAMILY_SIMILAR)).select("fid", "lead", "kind")

    # each unit stands for one text or more of its form, so two that are linked are a family already, and all that are linked count as one part
    ends = lambda pairs: pairs.select(F.explode(F.array("fid", "lead")).alias("fid"), "kind").distinct().withColumn("part", F.lit(0).cast("long"))
    linked = settle_bands(keys, verify, ends).select(F.explode(F.array("fid", "lead")).alias("unit"))
    member = sets.where(F.col("texts") >= FAMILY).select("unit").unionByName(linked).distinct()
    return each.select("fid", "unit", "n_windows", "windows").join(member, "unit", "left_semi").groupBy("fid").agg((F.sum("windows") / F.max("n_windows")).alias("share"))


def told(features: DataFrame, least: int, share: float) -> DataFrame:
    """(fid) of files with a feature that ``least`` files or more have, a ``share`` of which are known.

    ``features`` is (fid, feature, known), each pair once; counts are combined before the shuffle, so a feature of a
    third of all files is no hot key.
    """
    rated = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("k"))
    tells = pin(rated.where((F.col("n") >= least) & (F.col("k") >= F.col("n") * share) & (F.col("k") > 0)).select("feature"), "tells")
    return pin(features.join(tells, "feature", "left_semi").select("fid").distinct(), "told")


VENDOR = "\x00vendor"


def once(prints: DataFrame) -> DataFrame:
    """One row of each path: of those that repeat (``row`` tells them apart) the one of the greatest project."""
    named = prints.select(F.xxhash64("file_path").alias("fid"), "project", "exact", "row")
    repeated = named.groupBy("fid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fid")
    order = Window.partitionBy("fid").orderBy(F.desc_nulls_last("project"), "exact", "row")
    further = named.join(pin(repeated, "repeated"), "fid", "left_semi").withColumn("_n", F.row_number().over(order)).where("_n > 1").select("row")
    return prints.join(pin(further, "further"), "row", "left_anti")


def provenance(files: DataFrame, vendor_items: DataFrame) -> DataFrame:
    """(file_path, project, lang, kind, rule) of every file that wasn't written by hand.

    ``kind`` is the first that holds of vendored, data, minified, generated; ``rule`` says what it rests on (cluster,
    piece, family, siblings, comment, folder, layout).  ``files`` is what ``known_files`` gives; repeated rows count once.  Files
    too short to compare (under LEAST_TOKENS tokens) and empty ones are judged by comments and folder alone.  Vendor
    items of unknown languages are left out.
    """
    name = F.concat(F.lit(VENDOR + "/"), F.col("item_id").cast("string"), F.lit("/"), F.coalesce("file_name", F.lit("")))
    items = vendor_items.where(F.col("item_id").isNotNull()).select(name.alias("file_path"), F.lit(VENDOR).alias("project"), language(F.col("file_name")).alias("lang"), F.coalesce("content", F.lit("")).alias("content")).where(F.col("lang").isNotNull())
    every = files.select("file_path", "project", "lang", "content").unionByName(items)
    prints = once(pin(fingerprints(every).withColumn("row", F.monotonically_increasing_id()), "fingerprints"))
    recurring = pin(families(prints).where(F.col("share") >= FAMILY_SHARE).select("fid"), "families")
    joined, kin = clusters(prints, every, recurring)
    joined = pin(joined, "clusters")
    one = prints.select(F.xxhash64("file_path").alias("fid"), "file_path", "project", "lang", "literal", "minified", "head", "said")
    placed = joined.join(one.select("fid", "project"), "fid")
    foreign = placed.groupBy("cluster").agg(F.min("project").alias("p0"), F.max("project").alias("p1")).where("p0 <> p1").select("cluster")
    abroad = pin(placed.join(foreign, "cluster", "left_semi").select("fid", F.lit("cluster").alias("copy")), "abroad")
    pieces = pin(contained(prints, every).select("fid", F.lit("piece").alias("piece")), "found")
    kin = pin(kin.select("fid", F.lit(True).alias("kin")), "kin")
    # the lists are pinned, so Spark knows how small they are before it moves any file
    known = (
        one.join(abroad, "fid", "left").join(pieces, "fid", "left").join(recurring.withColumn("units", F.lit(True)), "fid", "left").join(kin, "fid", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("units", "kin")}).withColumn("family", F.col("units") | F.col("kin")).where(F.col("project").isNull() | (F.col("project") != VENDOR))
    )
    copied = (F.col("copy").isNotNull() | F.col("piece").isNotNull()) & ~F.col("units")
    generated = told(known.select("fid", F.explode("said").alias("feature"), F.col("family").alias("known")), TELL_LEAST, TELL_SHARE).withColumn("by_comment", F.lit(True))
    vendored = told(known.select("fid", F.explode("head").alias("feature"), copied.alias("known")), TELL_LEAST, TELL_SHARE).withColumn("by_head", F.lit(True))
    judged = known.drop("head", "said").join(generated, "fid", "left").join(vendored, "fid", "left")
    # folders above the file's own, below the project's
    below = F.expr("substr(file_path, locate(concat('/', project, '/'), file_path) + length(project) + 2)")
    above = F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 2, F.lit(0)))
    foreign_text = copied | (F.coalesce("by_head", F.lit(False)) & ~F.col("family"))
    places = judged.where("locate(concat('/', project, '/'), file_path) > 0").select("fid", F.explode(F.array_distinct(above)).alias("feature"), foreign_text.alias("known"))
    folder = told(places, FOLDER_LEAST, FOLDER_SHARE).withColumn("by_folder", F.lit(True))
    data = F.col("family") & (F.col("literal") >= LITERAL_SHARE)
    rule = (
        F.when(copied, F.concat(F.lit("vendored "), F.coalesce("copy", "piece")))
        .when(data, "data family")
        .when(F.col("minified"), "minified layout")
        .when(F.col("units"), "generated family")
        .when(F.col("kin"), "generated siblings")
        .when(F.col("by_comment"), "generated comment")
        .when(F.col("by_head"), "vendored comment")
        .when(F.col("by_folder"), "vendored folder")
    )
    found = judged.join(folder, "fid", "left").withColumn("_rule", F.split(rule, " ")).where(F.col("_rule").isNotNull())
    return found.select("file_path", "project", "lang", F.col("_rule")[0].alias("kind"), F.col("_rule")[1].alias("rule"))
