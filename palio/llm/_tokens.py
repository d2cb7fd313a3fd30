"""Token ids of whole texts, with the encoding of repeated words looked up.

A byte-level BPE splits a text into pre-tokens first and encodes each alone. Its splitting rule always cuts
before a space that a character other than white space follows, behind a run of letters, between other
marks than the apostrophe and letters, and behind a single line end. Texts are cut at such places into *units*;
Arrow finds the distinct ones of a batch, the tokenizer sees each distinct one once per cache, and ids are
gathered by unit. Texts that hold one of the file's added tokens, which the tokenizer finds before it splits, are encoded
whole; so are all texts if a tokenizer file's rule differs (a probe tells).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _flat as K

#: Distinct units a worker holds; when there are more, those seen in one slice only go, or the less seen half. Longer
#: units are encoded afresh every time.
UNITS, LONGEST_CACHED = 600_000, 64
#: What a byte-level splitter writes for a space.
SPACE_MARK = "\u0120"
#: How a unit is encoded: by the model alone, as one line of a text of many, or by itself; and how if it isn't remembered.
MODEL, LINE, ALONE, LONG = range(4)
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 22

#: What a byte can be: an ASCII letter; a mark (seen, no letter, digit or apostrophe); the end of a run of letters; a
#: space; no beginning of white space of any script; seen.
LETTER, MARK, STOP, SPACE, SAFE, SEEN = (1 << i for i in range(6))


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    byte = np.arange(256)
    letter = ((byte | 0x20) >= 0x61) & ((byte | 0x20) <= 0x7A) & (byte < 0x80)
    digit = (byte >= 0x30) & (byte <= 0x39)
    seen = (byte > 0x20) & (byte < 0x7F)
    out[letter] |= LETTER
    out[seen & ~letter & ~digit & (byte != 0x27)] |= MARK
    out[(byte < 0x80) & ~letter & ~digit & (byte != 0x20)] |= STOP
    out[0x20] |= SPACE
    out[(byte > 0x20) & ~np.isin(byte, [0x7F, 0xC2, 0xE1, 0xE2, 0xE3])] |= SAFE
    out[seen] |= SEEN
    return out


_KINDS = _kinds()
_PROBES = ["", "a", " a", "a b", "a  b ", "a\nb", "a\n\nb", "a \n b", "it's 'so', he'd've", "x,y;z 1a a1 3.14", "word.\nNext, word's\r\n", "café, d’or　z  q", "日B's Δx", "<|endoftext|> x"]


def cuts(data: np.ndarray) -> np.ndarray:
    """For each byte of one text or more, whether a unit begins with it."""
    kind = _KINDS[data]
    one, two = kind[:-1], kind[1:]
    here = np.zeros(len(data), bool)
    if len(data) < 2:
        return here
    # bits that stand one or two places apart are moved onto each other
    here[1:] = ((one & (two >> 2)) | (two & (one >> 1))) & 1
    line = np.flatnonzero((data[1:-1] == 0x0A) & (kind[2:] & LETTER).view(bool) & (kind[:-2] & SEEN).astype(bool))
    here[line + 2] = True
    here[:-1] |= ((one >> 3) & (two >> 4) & 1).view(bool)
    return here


class Encoder:
    """Encodes string columns with a tokenizers file."""

    def __init__(self, path: str, units: int = UNITS, slice_bytes: int = SLICE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are a token by themselves wherever they stand in a text; texts with one are encoded whole.
        self.own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.most, self.slice_bytes = units, slice_bytes
        line = self._raw(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self.letters = self._keeps_letters()
        self.forget()
        self.whole = False
        direct = [np.array(x, "<u4") for x in self._raw(_PROBES)]
        ids, offs = self.encode(pa.array(_PROBES))
        self.whole = any(not np.array_equal(d, ids[a:z]) for d, a, z in zip(direct, offs[:-1], offs[1:], strict=True))
        self.forget()

    def forget(self) -> None:
        """Empties the cache."""
        self.known: dict[bytes, int] = {}
        self.ids, self.end = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)  # ids of unit i end at end[i]
        self.seen = np.zeros(1 << 14, np.int32)  # slices
        self.count = 0

    def _shrink(self) -> None:
        seen = self.seen[: self.count]
        least = 2 if (seen > 1).sum() <= self.most // 2 else int(np.partition(seen, self.count - self.most // 2)[self.count - self.most // 2]) + 1
        keep = seen >= least
        place = np.cumsum(keep) - 1
        self.known = {u: int(place[i]) for u, i in self.known.items() if keep[i]}
        begin = np.concatenate((np.zeros(1, np.int64), self.end[: self.count]))
        lens = np.diff(begin)
        self.ids = self.ids[K.ragged(begin[:-1][keep], lens[keep])]
        self.end, self.seen = np.cumsum(lens[keep]), seen[keep] >> 1
        self.count = len(self.end)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keeps_letters(self) -> bool:
        """Whether words of ASCII letters reach the file's model whole and as they are, but for the mark of the space before them."""
        cutter = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or cutter is None:
            return False
        low, high = ("".join(map(chr, range(a, a + 26))) for a in (0x61, 0x41))
        words = (low + high, high + low, "a", "Z")
        return all([w for w, _ in cutter.pre_tokenize_str(s + t)] == [m + t] for t in words for s, m in (("", ""), (" ", SPACE_MARK)))

    def _way(self, text: str) -> int:
        if len(text) > LONGEST_CACHED:
            return LONG
        word = text[1:] if text[:1] == " " else text
        if not word.isalpha():
            return ALONE
        if self.letters and word.isascii():
            return MODEL
        return LINE if self.line is not None else ALONE

    def _encoded(self, words: list[str], plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit, one after another, and how many each has.

        ``words``, of ASCII letters, go to the tokenizer's model, without the steps that cut a text; ``plain`` units, of
        letters only, as the lines of one text.
        """
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(w.replace(" ", SPACE_MARK))] for w in words]
        size = [np.fromiter(map(len, got), np.int64, len(got))]
        ids = [np.fromiter(chain.from_iterable(got), "<u4", int(size[0].sum()))]
        for s in range(0, len(plain), 500):
            part = plain[s : s + 500]
            own = np.array(self._raw(["\n".join(part)])[0], "<u4")
            line = np.flatnonzero(own == self.line)
            if len(line) == len(part) - 1:
                ids.append(np.delete(own, line))
                size.append(np.diff(np.concatenate(([-1], line, [len(own)]))) - 1)
            else:
                got = self._raw(part)
                ids += [np.array(g, "<u4") for g in got]
                size.append(np.array([len(g) for g in got], np.int64))
        for s in range(0, len(others), 1000):
            got = self._raw(others[s : s + 1000])
            ids.append(np.array([t for g in got for t in g], "<u4"))
            size.append(np.array([len(g) for g in got], np.int64))
        return np.concatenate(ids), np.concatenate(size)

    def _rows(self, units: list[bytes]) -> tuple[np.ndarray, int]:
        """Store rows of distinct units, and how many rows may stay."""
        if self.count > self.most:
            self._shrink()
        rows = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(rows < 0).tolist()
        stay = self.count
        if new:
            texts = [units[i].decode() for i in new]
            by: list[list[int]] = [[], [], [], []]
            for k, t in enumerate(texts):
                by[self._way(t)].append(k)
            order = by[MODEL] + by[LINE] + by[ALONE] + by[LONG]
            short = len(order) - len(by[LONG])
            ids, size = self._encoded(*([texts[k] for k in some] for some in (by[MODEL], by[LINE], by[ALONE] + by[LONG])))
            new = [new[k] for k in order]
            start = int(self.end[self.count - 1]) if self.count else 0
            if start + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:start], np.zeros(len(ids) + start, "<u4")))
            self.ids[start : start + len(ids)] = ids
            if self.count + len(new) > len(self.end):
                more = self.count + 2 * len(new)
                self.end, self.seen = (np.concatenate((v[: self.count], np.zeros(more, v.dtype))) for v in (self.end, self.seen))
            own = slice(self.count, self.count + len(new))
            self.end[own] = start + np.cumsum(size)
            self.seen[own] = 0
            rows[new] = np.arange(self.count, own.stop)
            self.known.update(zip([units[i] for i in new[:short]], range(self.count, self.count + short), strict=True))
            stay = self.count + short
            self.count = own.stop
        self.seen[rows] += 1
        return rows, stay

    def _units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one slice of rows and their offsets by row."""
        first = offs[:-1][np.diff(offs) > 0]
        at = cuts(data)
        at[first] = True
        starts = np.flatnonzero(at)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = pieces.dictionary_encode()
        rows, stay = self._rows(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        unit = rows[distinct.indices.to_numpy(zero_copy_only=False)]
        begin = np.concatenate((np.zeros(1, np.int64), self.end[: self.count]))
        lens = begin[unit + 1] - begin[unit]
        ids = self.ids[K.ragged(begin[unit], lens)]
        self.count = stay
        ahead = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
        return ids, ahead[np.searchsorted(starts, offs)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (u32) and where each row's begin, with the end; null is empty."""
        if self.whole:
            got = [e for i in range(0, len(column), 256) for e in self._raw([t or "" for t in column.slice(i, 256).to_pylist()])]
            return np.array([t for g in got for t in g], "<u4"), np.cumsum([0, *(len(g) for g in got)])
        marked = np.zeros(len(column), bool)
        for token in self.own:
            marked |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(marked)
        if len(rows):
            ids, offs = self._by_units(pc.if_else(pa.array(marked), pa.scalar("", column.type), column))
            got = [self._raw([column[i].as_py()])[0] for i in rows.tolist()]
            size = np.array([len(g) for g in got], np.int64)
            ids = np.insert(ids, np.repeat(offs[rows], size), [t for g in got for t in g])
            more = np.zeros(len(offs), np.int64)
            more[rows + 1] = size
            return ids, offs + np.cumsum(more)
        return self._by_units(column)

    def _by_units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = K.text_buffers(column)
        ids, ends, total = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        for i, j in K.slices(offs, self.slice_bytes):
            own, at = self._units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ids.append(own)
            ends.append(at[1:] + total)
            total += len(own)
        return np.concatenate(ids), np.concatenate(ends)

    def encode_with_end(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode``, with ``end`` behind the ids of every row."""
        ids, offs = self.encode(column)
        out = np.full(len(ids) + len(offs) - 1, end, "<u4")
        own = np.ones(len(out), bool)
        own[offs[1:] + np.arange(len(offs) - 1)] = False
        out[own] = ids
        return out, offs + np.arange(len(offs))


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, units: int = UNITS, slice_bytes: int = SLICE_BYTES) -> Encoder:
    """The worker's encoder of a file; workers are reused, and so are the units they have seen."""
    key = path, units, slice_bytes
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def forget() -> None:
    """Frees the encoders of a reused worker, and what else it holds but doesn't use."""
    _ENCODERS.clear()
    K.give_back()


def fresh(run):
    """``run``, a function over batches, in a worker that gives back what tasks before left there, and then what ``run`` leaves."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        K.give_back()

    return begin


def default_path() -> str:
    """The tokenizer file that queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
