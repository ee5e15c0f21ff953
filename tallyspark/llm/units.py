"""Encoding of whole columns of texts by way of units that a tokenizer's pre-split never crosses.

Most words of a corpus recur.  A column of texts is split at spaces and
dictionary-encoded by Arrow; each different unit of it is looked up once, the
units not known yet are encoded together, and the texts' ids are gathered from
the units' ids in one step.  No Python code runs for each word of a text.

Ids are little-endian bytes of a fixed width.  A text that holds white space
or marks which could join neighbouring units is encoded whole instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a dictionary keeps.
MAX_UNITS = 800_000
#: Units joined to one string for a tokenizer.
CHUNK = 200

_SPACES = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that could join a neighbour's match: any run of two, and any but space and newline.
JOINED = rf"[ \n][ \n]|[{_SPACES}]"
#: Characters that aren't normalised one by one, and white space but space and newline.
NORMALISED = rf"[{_SPACES}\x00\p{{M}}\x{{130}}\x{{1100}}-\x{{11ff}}\x{{a960}}-\x{{a97f}}\x{{d7b0}}-\x{{d7ff}}]"


_M = np.uint64
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> _M(29))) * _M(factor)
    return x ^ (x >> _M(32))


def text_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, read eight bytes at a time."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.zeros((data.size if data else 0) + 8, np.uint8)
    if data:
        raw[:-8] = np.frombuffer(data, np.uint8)
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    at, left = ends[:-1].copy(), np.diff(ends)
    h1, h2 = _mixed(left.astype(np.uint64) + _M(1), 0x9E3779B97F4A7C15), _mixed(left.astype(np.uint64) + _M(2), 0xC2B2AE3D27D4EB4F)
    active = np.flatnonzero(left > 0)
    while len(active):
        x = lanes[at[active]] & _MASKS[np.minimum(left[active], 8)]
        h1[active] = _mixed(h1[active] ^ x, 0xBF58476D1CE4E5B9) * _M(0x94D049BB133111EB)
        h2[active] = _mixed((h2[active] + x) * _M(0xD6E8FEB86659FD93), 0xFF51AFD7ED558CCD)
        at[active] += 8
        left[active] -= 8
        active = active[left[active] > 0]
    return h1, h2


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of flat, end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def values_of(ids: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of binaries that starts at its buffers' start, and the bounds of each."""
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(ids) + 1].astype(np.int64) // kind.itemsize if len(ids) else np.zeros(1, np.int64)
    return np.frombuffer(data, kind)[: ends[-1]] if data else np.zeros(0, kind), ends


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of binaries that holds data, cut to so many values each."""
    offsets = np.concatenate([[0], np.cumsum(sizes * data.dtype.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joined(ids: pa.Array, counts: np.ndarray) -> pa.Array:
    """Joins runs of so many neighbouring binaries to one each."""
    _, offsets, data = ids.buffers()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.frombuffer(offsets, np.int32)[: len(ids) + 1][bounds] if len(ids) else np.zeros(len(bounds), np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(cuts)), data])


class Units:
    """A bounded dictionary of units' ids, by 128 bits of their hashes.  When it is full, units not met since it last was go."""

    def __init__(self, encode: Callable[[list[str]], pa.Array], dtype: str, most: int = MAX_UNITS):
        self.encode, self.kind, self.most = encode, np.dtype(dtype), most
        self.h1 = self.h2 = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int32)  # in flat, which holds less than 2**31 values
        self.met = np.zeros(0, bool)
        self.flat, self.end = np.zeros(1 << 16, self.kind), 0

    def _appended(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = values_of(ids, self.kind)
        size = np.diff(ends)
        if self.end + len(data) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.end], np.zeros(self.end // 2 + len(data), self.kind)])
        self.flat[self.end : self.end + len(data)] = data
        start = self.end + np.cumsum(size) - size
        self.end += len(data)
        return start, size

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.met)
        if 2 * len(keep) > self.most:  # all are in use: every second one goes
            keep = keep[::2]
        self.h1, self.h2, self.size = self.h1[keep], self.h2[keep], self.size[keep]
        self.flat = gathered(self.flat, self.start[keep].astype(np.int64), self.size.astype(np.int64))
        self.end = len(self.flat)
        self.start, self.met = (np.cumsum(self.size) - self.size).astype(np.int32), np.zeros(len(keep), bool)

    def __call__(self, words: pa.Array) -> pa.Array:
        """The ids (binary) of different words."""
        h1, h2 = text_hashes(words)
        order = np.argsort(h1)
        h1, h2 = h1[order], h2[order]
        at = np.searchsorted(self.h1, h1)
        found = np.zeros(len(h1), bool)
        start, size = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        if len(self.h1):
            near = np.minimum(at, len(self.h1) - 1)
            found = (self.h1[near] == h1) & (self.h2[near] == h2)
            hit = near[found]
            start[found], size[found] = self.start[hit], self.size[hit]
            self.met[hit] = True
        new = np.flatnonzero(~found)
        if len(new):
            start[new], size[new] = self._appended(self.encode(words.take(pa.array(order[new])).to_pylist()))
            put = new[np.append(True, h1[new][1:] != h1[new][:-1])]  # words of equal first hashes: one of them is kept
            if len(self.h1):
                put = put[self.h1[np.minimum(at[put], len(self.h1) - 1)] != h1[put]]
            where = at[put]
            self.h1, self.h2 = np.insert(self.h1, where, h1[put]), np.insert(self.h2, where, h2[put])
            self.start, self.size = np.insert(self.start, where, start[put].astype(np.int32)), np.insert(self.size, where, size[put].astype(np.int32))
            self.met = np.insert(self.met, where, True)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        start, size = start[back], size[back]
        data = gathered(self.flat, start, size)
        if len(self.h1) > self.most or self.end > 16 * self.most:
            self._shrink()
        return binaries(data, size)


class Pieces:
    """Ids of units by way of the pre-split pieces in them, which recur more often than units."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], pa.Array], dtype: str, most: int = MAX_UNITS):
        self.split, self.known = split, Units(encode, dtype, most)

    def __call__(self, words: list[str]) -> pa.Array:
        pieces, counts = [], []
        for w in words:
            found = self.split(w)
            pieces += found
            counts.append(len(found))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        return joined(self.known(coded.dictionary).take(coded.indices), np.array(counts, np.int64))


class Column:
    """Encodes a column of texts.  units() encodes a list of units, whole() of texts; unsafe: an RE2 pattern of texts to be encoded whole."""

    unsafe: str

    def __init__(self, units: Callable[[list[str]], pa.Array], whole: Callable[[list[str]], pa.Array], dtype: str = "<u4", most: int = MAX_UNITS):
        self.units, self.whole, self.kind = Units(units, dtype, most), whole, np.dtype(dtype)

    def prepared(self, texts: pa.Array) -> pa.Array:
        return texts

    def firsts(self, words: pa.Array) -> pa.Array | None:
        """Ids of the first units of texts, where they differ from those of other units."""

    def __call__(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, a null one as an empty one, with end appended to each."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        bad = np.flatnonzero(pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False))
        split = texts
        if len(bad):
            mask = np.zeros(n, bool)
            mask[bad] = True
            split = pc.if_else(pa.array(mask), "", texts)
        lists = pc.split_pattern(self.prepared(split), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0] if n else 0
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int32)
        known = [self.units(coded.dictionary)]
        total = len(known[0])
        first = bounds[:-1]
        own = self.firsts(coded.dictionary.take(pa.array(index[first])))
        if own is not None:
            index[first] = total + np.arange(n, dtype=np.int32)
            known.append(own)
            total += n
        if len(bad):
            index[first[bad]] = total + np.arange(len(bad), dtype=np.int32)
            known.append(self.whole(texts.take(pa.array(bad)).to_pylist()))
            total += len(bad)
        if end:
            index = np.insert(index, bounds[1:], total)
            known.append(pa.array([end], pa.binary()))
            bounds = bounds + np.arange(n + 1)
        return joined(pa.concat_arrays(known).take(pa.array(index)), np.diff(bounds))


class SpacedColumn(Column):
    """For patterns whose matches hold white space only as one leading space or as a run of their own.

    units() is given strings that begin with their only space.
    """

    unsafe = JOINED

    def __init__(self, units, whole, dtype: str = "<u4", most: int = MAX_UNITS):
        super().__init__(lambda words: units([" " + w for w in words]), whole, dtype, most)
        self.starts = Units(whole, dtype, most)

    def firsts(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        return self.starts(coded.dictionary).take(coded.indices)


class BareColumn(Column):
    """For tokenizers that drop white space before they split; A-Z are lowered first.  units() is given strings without white space, "" among them."""

    unsafe = NORMALISED

    def prepared(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_lower(pc.replace_substring(texts, "\n", " "))


def library_column(kind: type[Column], path: str, pattern: str, mark: Callable[[str], bool], dtype: str) -> Column:
    """A column encoder for a file of the tokenizers library; ids as bytes of dtype.

    pattern is the file's pre-split.  Pieces are joined to strings of CHUNK
    pieces, and the ids cut at the tokens that mark() tells from their text:
    first tokens of pieces with a leading space, else last tokens.  Where
    their count differs from the pieces', these are encoded one by one.
    """
    import os

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    find, value, spaced = regex.compile(pattern).findall, np.dtype(dtype), kind is SpacedColumn
    marked = np.zeros(tok.get_vocab_size() + 1, bool)
    for token, i in tok.get_vocab().items():
        marked[i] = mark(token)

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, value) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(texts: list[str]) -> pa.Array:
        ids = encoded(texts)
        return binaries(np.concatenate(ids) if ids else np.zeros(0, value), np.array(list(map(len, ids)), np.int64))

    def pieces(found: list[str]) -> pa.Array:
        easy = [i for i, w in enumerate(found) if w[0] == " " and len(w) > 1] if spaced else list(range(len(found)))
        out: list = [None] * len(found)
        chunks = [easy[i : i + CHUNK] for i in range(0, len(easy), CHUNK)]
        for chunk, ids in zip(chunks, encoded([("" if spaced else " ").join(map(found.__getitem__, c)) for c in chunks])):
            at = np.flatnonzero(marked[ids])
            cuts = np.append(at, len(ids)) if spaced else np.concatenate([[0], at + 1])
            if len(at) == len(chunk) and cuts[0] == 0 and cuts[-1] == len(ids):
                for i, a, b in zip(chunk, cuts.tolist(), cuts[1:].tolist()):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, encoded([found[i] for i in rest])):
            out[i] = ids
        return binaries(np.concatenate(out) if out else np.zeros(0, value), np.array(list(map(len, out)), np.int64))

    def split(w: str) -> list[str]:
        return [w] if w.isalpha() or (spaced and w[1:].isalpha()) else find(w)

    return kind(Pieces(split, pieces, dtype), whole, dtype)
