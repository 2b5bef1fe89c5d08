"""Words, word hashes and token ids of Arrow string columns, vectorised over a batch.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``: what Arrow's ASCII split leaves, without empty pieces.
Everything here runs inside a task on one slice of a batch, so memory is bounded by the slice
(or by the longest single text).
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: texts are handled in slices of about this many bytes
SLICE_BYTES = 2 << 20

#: words whose ids a Python worker remembers; beyond it the memory starts anew
REMEMBERED_WORDS = 600_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about ``limit`` bytes; at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and the place where each text's words begin.

    The places have one more entry than there are texts. Null counts as empty.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[bounds]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def hash_words(words: pa.Array, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit hashes of each word, the same on every machine; one for each seed, independent of each other.

    Polynomials of the bytes, taken over all words at once.
    """
    n = len(words)
    if not n:
        return [np.zeros(0, np.uint64) for _ in seeds]
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    own = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    place = np.arange(len(own)) - np.repeat(offsets[:-1], size)
    power = _powers(0x9E3779B97F4A7C15, int(size.max()))[place]
    length = size.astype(np.uint64) * _M1
    out = []
    for seed in seeds:
        letters = mix(np.arange(1, 257, dtype=np.uint64) * _M2 + np.uint64(seed))
        # words are never empty, so each has bytes to add up
        out.append(mix(np.add.reduceat(letters[own] * power, offsets[:-1]) + length))
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element, the number of the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds; 0 where there are none."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


class WordEncoder:
    """Token ids by a word-level BPE that drops white space, so that words can be encoded one by one.

    Each distinct word is encoded once and remembered by two 64-bit hashes, so that known words are found in bulk. Letters
    followed by ASCII punctuation are encoded apart from it, as the tokenizer splits there anyway; of such words only the
    letters are remembered, as the ends are few.
    """

    #: words that the tokenizer neither normalises (but for their case) nor splits
    _PLAIN = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$"
    _LETTERS = "".join(c for c in map(chr, range(0x100)) if re.fullmatch("[a-zA-ZÀ-ÖØ-öø-ÿ]", c))

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # how the model sees letters: those beyond ASCII as two characters
        self._first, self._second = np.arange(256, dtype="<u2"), np.zeros(256, "<u2")
        for c in range(0xDF, 0x100):
            if chr(c) != "÷":
                self._first[c], self._second[c] = map(ord, level.pre_tokenize_str(chr(c))[0][0])
        self._forget()

    def _forget(self) -> None:
        # hashes in order, and where in the ids each word's begin and how many there are
        self._keys, self._checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._starts, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember words; returns where in the ids each one's begin.

        Of words that share their first hash the first one is remembered, the others are encoded each time.
        """
        starts = len(self._ids) + np.cumsum(sizes) - sizes
        self._ids = np.concatenate([self._ids, ids])
        own = np.unique(keys, return_index=True)[1]
        place = np.searchsorted(self._keys, keys[own])
        if len(self._keys):
            free = self._keys[np.minimum(place, len(self._keys) - 1)] != keys[own]
            own, place = own[free], place[free]
        self._keys = np.insert(self._keys, place, keys[own])
        self._checks = np.insert(self._checks, place, checks[own])
        self._starts = np.insert(self._starts, place, starts[own])
        self._sizes = np.insert(self._sizes, place, sizes[own])
        return starts

    def _as_seen(self, words: pa.Array) -> list[str]:
        """Plain words the way the model sees them; their letters all lie below U+0100."""
        lower = " ".join(pc.utf8_lower(words).to_numpy(zero_copy_only=False).tolist())
        letters = np.frombuffer(lower.encode("latin-1"), np.uint8)
        second = self._second[letters]
        each = 1 + (second > 0)
        out = np.repeat(self._first[letters], each)
        out[np.cumsum(each)[second > 0] - 1] = second[second > 0]
        return out.tobytes().decode("utf-16-le").split(" ")

    def _encoded(self, words: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            # with nothing to split the model alone gives the same ids
            found = map(self._tokenizer.model.tokenize, self._as_seen(words))
        else:
            encode = self._tokenizer.encode
            found = (encode(word, add_special_tokens=False).ids for word in words.to_pylist())
        sizes = []

        def each():
            for tokens in found:
                sizes.append(len(tokens))
                yield tokens

        flat = chain.from_iterable(each())
        ids = np.fromiter(map(attrgetter("id"), flat) if plain else flat, np.uint32)
        return ids, np.array(sizes, np.int64)

    def _find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each of the distinct words begin and how many there are."""
        keys, checks = hash_words(words, (0, 1))
        known, at = self._known(keys, checks)
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[known], sizes[known] = self._starts[at[known]], self._sizes[at[known]]
        if known.all():
            return self._ids, starts, sizes
        new = np.flatnonzero(~known)
        words = words.take(pa.array(new))
        heads = pc.ascii_rtrim(words, string.punctuation)
        plain = pc.match_substring_regex(heads, self._PLAIN).to_numpy(zero_copy_only=False)
        tailed = plain & (pc.binary_length(heads).to_numpy() < pc.binary_length(words).to_numpy())
        for kind, of in ((True, plain & ~tailed), (False, ~plain)):
            own = new[of]
            ids, sizes[own] = self._encoded(words.filter(pa.array(of)), kind)
            starts[own] = self._add(keys[own], checks[own], ids, sizes[own])
        if not tailed.any():
            return self._ids, starts, sizes
        own = new[tailed]
        ids, sizes[own] = self._with_tails(words.filter(pa.array(tailed)), heads.filter(pa.array(tailed)))
        starts[own] = len(self._ids) + np.cumsum(sizes[own]) - sizes[own]
        return np.concatenate([self._ids, ids]), starts, sizes

    def _with_tails(self, words: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are a head, which may be known, and punctuation; and how many each has."""
        coded = heads.dictionary_encode()
        # adds new heads to what is remembered
        head_ids, head_starts, head_sizes = self._find(coded.dictionary)
        of_head = coded.indices.to_numpy()
        tails = pc.utf8_ltrim(words, self._LETTERS).dictionary_encode()
        ids, tail_sizes = self._encoded(tails.dictionary, False)
        of_tail = tails.indices.to_numpy()
        tail_starts = len(head_ids) + np.cumsum(tail_sizes) - tail_sizes
        # two runs of ids for each word
        starts = np.stack([head_starts[of_head], tail_starts[of_tail]], 1).ravel()
        each = np.stack([head_sizes[of_head], tail_sizes[of_tail]], 1).ravel()
        before = np.cumsum(each) - each
        places = np.repeat(starts - before, each) + np.arange(int(each.sum()))
        return np.concatenate([head_ids, ids])[places], each.reshape(-1, 2).sum(1)

    def _known(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are remembered, and where."""
        if not len(self._keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return (self._keys[at] == keys) & (self._checks[at] == checks), at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each ended by ``end_id``, and their bounds."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        # names of special tokens count as written; all else is lower-cased by the tokenizer
        words, bounds = split_words(texts, lower=not special)
        coded = words.dictionary_encode()
        if len(self._keys) > REMEMBERED_WORDS:
            self._forget()
        known_ids, starts, sizes = self._find(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        token_bounds = np.concatenate([[0], np.cumsum(each)])
        own = token_bounds[bounds]
        total = int(token_bounds[-1])
        ids = known_ids[np.repeat(starts[which] - token_bounds[:-1], each) + np.arange(total)]
        out_bounds = own + np.arange(len(own))
        out = np.empty(total + len(own) - 1, np.uint32)
        ends = out_bounds[1:] - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = ids, end_id
        return out, out_bounds


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; its memory lasts as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
