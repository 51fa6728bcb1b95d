"""Token ids of whole texts by public tokenizers, a word at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

#: Marks that every tokenizer here parts, as one run, from the letters before them.
_MARKS = ",.;:!?#$%&*"

#: Letters below are letters still in lower case and in every normal form; of others some are not (U+0130).
_SURE = "\u0100"

#: How byte-level vocabularies write bytes that are no visible Latin-1 character: from U+0100 on, in order.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


#: Kinds of UTF-8 bytes: white space, letters up to U+00FF, marks, all others (U+00D7 and U+00F7 end like none of those letters).
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \t\n\r")], _KIND[list(_MARKS.encode())] = _SPACE, _MARK
_KIND[[b for b in range(256) if bytes([b]).isalpha() or b == 0xC3 or 0x80 <= b <= 0xBF and b not in (0x97, 0xB7)]] = _LETTER

#: Bytes in lower case: of ASCII, and of what follows 0xC3.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_LOWER_C3 = np.array([b + 32 * (0x80 <= b <= 0x9E) for b in range(256)], np.uint8)


#: How byte-level vocabularies write each byte, in UTF-16, but for spaces.
_SHOWN_CODES = np.array([_SHOWN.get(b, b) if b != 32 else 32 for b in range(256)], "<u2")

_SHORT = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _SHORT[n](*ids) if n < 32 else struct.pack(f"<{n}I", *ids)


def _shown(text: str) -> str:
    """A text's bytes as byte-level vocabularies write them; ASCII letters stay."""
    return text.encode().decode("latin-1").translate(_SHOWN)


class _Words(dict):
    """Ids of words, as bytes of little-endian 32-bit integers, found by the tokenizer when first asked for.

    At most two generations of ``most`` words are kept: when the young one is
    full it takes the place of the old one, so words in use stay. Marks after
    letters that stay letters when normalised are a token run of their own, so
    those letters are looked up without it, and in lower case if that is how the
    tokenizer reads them.
    """

    def __init__(self, tokenizer: Tokenizer, before: str, most: int = 400_000):
        super().__init__()
        self.tokenizer, self.before, self.shown, self.most = tokenizer, before, _shown(before), most
        self.old: dict[str, bytes] = {}
        self.lower = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.model = tokenizer.model
        self.marks: dict[str, bytes] = {}
        self.direct = all(self._letters(w) == self._ids(before + w) for w in ("a", "the", "Word", "QzXv", "\u00c9t\u00e9", "\u00f1and\u00fa"))

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            head = word.rstrip(_MARKS)
            if not head.isalpha() or not (head.isascii() or max(head) < _SURE):
                packed = self._ids(self.before + word)
            elif len(head) < len(word):
                packed = self[head] + self._run(word[len(head) :])
            elif self.lower and (small := word.lower()) != word:
                packed = self[small]
            else:
                packed = self._letters(word) if self.direct else self._ids(self.before + word)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[word] = packed
        return packed

    def _run(self, marks: str) -> bytes:
        """Ids of a run of marks; the short ones are kept, and are few."""
        if (packed := self.marks.get(marks)) is None:
            packed = self._ids(marks)
            if len(marks) <= 3:
                self.marks[marks] = packed
        return packed

    def _letters(self, word: str) -> bytes:
        """Ids of letters up to U+00FF, a token run of their own, straight from the tokenizer's model."""
        word = word.lower() if self.lower else word
        shown = self.shown + (word if word.isascii() else _shown(word))
        return _packed([x.id for x in self.model.tokenize(shown)])

    def _ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class Runs:
    """Encodes a block of texts at once, for tokenizers that drop white space and mark ends of runs.

    Letters up to U+00FF and marks are token runs of their own; words with other
    characters are kept whole. Arrow numbers a block's runs together with those
    that are known; the others go through the tokenizer's model all at once.
    When more than ``most`` runs are known, those stay that came in more blocks
    than one, with less credit each time.
    """

    def __init__(self, tokenizer: Tokenizer, lower: bool, most: int, block: int = 8_000_000):
        self.tokenizer, self.lower, self.most, self.block = tokenizer, lower, most, block
        self.known = pa.array([], pa.binary())
        self.seen, self.starts, self.sizes, self.ids = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        self.parts = Tokenizer(tokenizer.model)
        self.parts.pre_tokenizer = Split(" ", "removed")
        suffix, vocabulary = tokenizer.model.end_of_word_suffix, tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids (null: empty), packed as little-endian unsigned 32-bit integers."""
        if not len(texts):
            return
        texts.validate(full=True)  # UTF-8
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, at = np.frombuffer(data or b"", np.uint8), 0
        while at < len(texts):
            end = int(np.searchsorted(bounds, bounds[at] + self.block, side="right")) - 1
            if end == at:
                yield self._long(data[bounds[at] : bounds[at + 1]])
                at += 1
                continue
            ids, cuts = self._encoded(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
            packed, cuts = ids.tobytes(), (4 * cuts).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield packed[a:b]
            at = end

    def _long(self, text: np.ndarray) -> bytes:
        """The ids of a text longer than a block, cut at white space."""
        spaces, packed, at = np.flatnonzero(_KIND[text] == _SPACE), [], 0
        while at < len(text):
            k = np.searchsorted(spaces, at + self.block)
            end = int(spaces[k]) + 1 if k < len(spaces) else len(text)
            packed.append(self._encoded(text[at:end], np.array([0, end - at]))[0].tobytes())
            at = end
        return b"".join(packed)

    def _encoded(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of the texts between ``bounds`` of ``raw``: text k's ids are those from cuts[k] to cuts[k + 1]."""
        if not len(raw):
            return np.empty(0, "<u4"), np.zeros(len(bounds), np.int64)
        kind, begins = _KIND[raw], np.zeros(len(raw) + 1, bool)
        begins[bounds] = True
        begins = begins[:-1]
        if len(others := np.flatnonzero(kind == _OTHER)):
            spaces = kind == _SPACE
            edges = np.flatnonzero(begins | spaces | np.r_[False, spaces[:-1]])
            word = np.unique(np.searchsorted(edges, others, side="right") - 1)
            others = _ranges(edges[word], np.diff(np.r_[edges, len(raw)])[word])
            kind[others] = _OTHER
        begins[1:] |= kind[1:] != kind[:-1]
        low = raw
        if self.lower:
            low, accented = _LOWER[raw], np.flatnonzero(raw == 0xC3) + 1
            low[accented] = _LOWER_C3[raw[accented]]
            low[others] = raw[others]
        starts = np.flatnonzero(begins)
        full = kind[starts] != _SPACE
        lengths, starts = np.diff(np.r_[starts, len(raw)])[full], starts[full]
        number = self._numbered(low[kind != _SPACE], lengths, kind[starts] != _OTHER)
        sizes = self.sizes[number]
        ids = self.ids[_ranges(self.starts[number], sizes)]
        self._forget()
        return ids, np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds)]

    def _numbered(self, data: np.ndarray, lengths: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The numbers in ``known`` of the runs in ``data``; new ones are added with their ids."""
        ends, n = np.r_[0, np.cumsum(lengths)].astype(np.int32), len(self.known)
        runs = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        runs = runs.dictionary_encode()
        coded = pa.concat_arrays([self.known, runs.dictionary]).dictionary_encode()
        self.known, here = coded.dictionary, coded.indices.to_numpy()[n:]
        number = here[runs.indices.to_numpy()]
        straight = np.empty(len(self.known), bool)
        straight[number] = plain
        straight, new = straight[n:], self.known[n:]
        ids, sizes = self._letters(new.filter(pa.array(straight)))
        whole = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in new.filter(pa.array(~straight)).to_pylist()]
        order = np.r_[np.flatnonzero(straight), np.flatnonzero(~straight)]
        sizes = np.r_[sizes, np.array([len(x) for x in whole], np.int64)]
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.ids) + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.r_[self.starts, starts], np.r_[self.sizes, sizes[np.argsort(order)]]
        self.ids = np.concatenate([self.ids, ids, *(np.array(x, "<u4") for x in whole)])
        self.seen = np.r_[self.seen, np.zeros(len(new), np.uint8)]
        self.seen[here] = np.minimum(self.seen[here] + 1, 3)
        return number

    def _letters(self, runs: pa.Array, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of runs of letters or of marks, straight from the tokenizer's model."""
        found = [np.empty(0, "<u4")]
        for at in range(0, len(runs), most):
            part = runs[at : at + most]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), b" ")[0].as_buffer()
            shown = _SHOWN_CODES[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
            found.append(np.array(self.parts.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs):
            raise ValueError("ids do not tell where runs end")
        return ids, np.diff(np.r_[0, ends])

    def _forget(self) -> None:
        if len(self.known) > self.most or self.known.nbytes > 64 * self.most:
            stay = np.flatnonzero(self.seen > 1)
            self.known, self.seen = self.known.take(pa.array(stay)), self.seen[stay] // 2
            self.ids, self.sizes = self.ids[_ranges(self.starts[stay], self.sizes[stay])], self.sizes[stay]
            self.starts = np.cumsum(self.sizes) - self.sizes


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Encodes texts exactly as the tokenizer does, but each distinct word once.

    The tokenizer never joins what a single space or line end parts from a word
    on either side: a space goes to the word that follows it (``keeps_space``)
    or to none. Texts with other white space are encoded whole. ``path`` names a
    file of the tokenizers library. Words kept are bounded; the memory is small.
    Text that spells a special token is text like any other
    (``encode_special_tokens``), so no document can write an end of its own.
    """

    def __init__(self, path: str, keeps_space: bool, words: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = _Words(self.tokenizer, "", words)
        self.later = _Words(self.tokenizer, " ", words) if keeps_space else self.first
        self.newline = self.first["\n"]
        self.runs: Runs | None = None
        if not keeps_space and not self.newline and self.tokenizer.model.end_of_word_suffix:
            tried = ["The end, of  it;\t\u00c9t\u00e9", "QzXv!?;a,b", "x1\n\u00f1and\u00fa ***"]
            runs = Runs(self.tokenizer, self.first.lower, 2 * words)
            if list(runs(pa.array(tried))) == [self.first._ids(x) for x in tried]:
                self.runs = runs

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: empty), by blocks where the tokenizer drops white space."""
        if self.runs is not None:
            yield from self.runs(texts)
        else:
            yield from (self(text or "") for text in texts.to_pylist())

    def __call__(self, text: str) -> bytes:
        """The ids of ``text``, packed as little-endian unsigned 32-bit integers."""
        words, first, later = text.split(), self.first, self.later
        lines = text.count("\n")
        # single spaces and line ends between words, and no other white space
        if len(text) != sum(map(len, words)) + len(words) - 1 or text.count(" ") + lines != len(words) - 1:
            return first._ids(text)
        if not lines or (later is first and not self.newline):
            return first[words[0]] + b"".join(map(later.__getitem__, words[1:]))
        packed = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            packed.append(first[head] + b"".join(map(later.__getitem__, rest)))
        return self.newline.join(packed)


@cache
def encoder(path: str, keeps_space: bool, words: int = 400_000) -> WordEncoder:
    """The process's own encoder of a file; two generations of ``words`` words are kept at most."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no tokenizer at {path}; each executor needs the file at this path")
    return WordEncoder(path, keeps_space, words)
