"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is a ``tokenizers`` JSON of a BPE model whose words end in a
suffix: NFC, white space to one blank, lower case, split by one pattern, bytes
to printable characters. Words are cut, told apart and looked up as arrays, so
that no word is an object of its own. Those that aren't known yet are laid out
in one flat array of symbols; each round finds every pair's rank by binary
search in the sorted pair keys and merges, in each word, all occurrences of its
lowest-rank pair, until no word has a pair left to merge.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of words and ids that a worker keeps, each with what its entry takes besides; beyond, words are encoded anew in each batch.
CACHE, ENTRY = 4 << 20, 12
#: Characters that are cut into words at a time, if they have a blank, and symbols in one flat array.
PART, FLAT = 1 << 20, 1 << 15
# Fixed value: the pattern that splits words, 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+, by kinds of characters.
KINDS = {1: r"\p{L}+", 2: r"\p{N}+", 3: r"[^\s\p{L}\p{N}]+"}
BLANK = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def _byte_chars() -> list[str]:
    """The printable character of each byte: itself if it is printable, else the next one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point: 0 for white space."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in KINDS.items():
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for m in BLANK.finditer(every):
        out[m.start() : m.end()] = 0
    return out


class Encoder:
    """Encodes and decodes as the library does; made once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.token = [b""] * self.size
        for text, i in chain(vocab.items(), added.items()):
            self.token[i] = text.encode()
        self.kinds = _kinds()
        self.known = pa.array([], pa.binary())
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.room = CACHE

    def _find(self, rank: np.ndarray, at: np.ndarray, ids: np.ndarray, word: np.ndarray, places: np.ndarray) -> None:
        """Sets rank and table place of the pairs that start at ``places``; the number of merges means none."""
        places = places[(places >= 0) & (places < len(ids) - 1)]
        key = ids[places] * self.size + ids[places + 1]
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[row] == key) & (word[places] == word[places + 1])
        rank[places] = np.where(fits, self.rank[row], len(self.keys))
        at[places] = row

    def merge(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (UTF-8, none of them empty) that ``text`` is cut into by ``sizes``, and how many each has."""
        n, none = len(sizes), len(self.keys)
        last = np.cumsum(sizes) - 1
        ids = self.inner[text]
        ids[last] = self.last[text[last]]
        word = np.repeat(np.arange(n), sizes)
        rank, at = np.full(len(ids), none), np.zeros(len(ids), np.int64)
        self._find(rank, at, ids, word, np.arange(len(ids)))
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            least = np.repeat(lowest, np.diff(np.concatenate((starts, [len(ids)]))))
            over = least == none  # nothing is left to merge in this word
            done_ids.append(ids[over].astype("<u4"))
            done_words.append(word[over])
            places = np.flatnonzero((rank == least) & ~over)
            if len(places):  # of pairs that overlap, every second one from the left
                run = np.concatenate(([True], np.diff(places) != 1))
                first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            ids[places] = self.made[at[places]]
            stays = ~over
            stays[places + 1] = False
            moved = np.cumsum(stays)[places] - 1
            ids, word, rank, at = ids[stays], word[stays], rank[stays], at[stays]
            self._find(rank, at, ids, word, np.concatenate((moved, moved - 1)))
            rank[len(rank) - 1 :] = none
        flat_words = np.concatenate(done_words)
        flat = np.concatenate(done_ids)[np.argsort(flat_words, kind="stable")]
        return flat, np.bincount(flat_words, minlength=n)

    def _words(self, text: str) -> tuple[np.ndarray, pa.Array]:
        """The place of each word's first character and the words in UTF-8, of a text that ends in two blanks."""
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kinds[chars]
        new = kind == 2  # each number is a word of its own
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        if "'" in text:  # an apostrophe that begins a word takes these letters after it, and no others
            at = np.flatnonzero((chars == ord("'")) & new)
            a, b = chars[at + 1], chars[at + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            new[at[one | two] + 1] = False
            new[at[one] + 2] = True
            new[at[two] + 3] = True
        full = kind != 0
        starts = np.flatnonzero(new & full)
        shown = chars[full].tobytes().decode("utf-32-le").encode()
        if len(shown) == np.count_nonzero(full):
            before = np.cumsum(full)[starts] - 1
        else:
            sizes = full.astype(np.int64)
            for least in (0x80, 0x800, 0x10000):
                sizes += full & (chars >= least)
            before = np.cumsum(sizes)[starts] - sizes[starts]
        return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(before, len(shown)).astype(np.int32)), pa.py_buffer(shown)])

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words that aren't known, and how many each has; keeps what there is room for."""
        _, bounds, text = words.buffers()
        bounds = np.frombuffer(bounds, np.int32)[: len(words) + 1].astype(np.int64)
        text = np.frombuffer(text, np.uint8)
        cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], FLAT)), len(words)))
        done = [self.merge(text[bounds[i] : bounds[j]], np.diff(bounds[i : j + 1])) for i, j in pairwise(cuts.tolist())]
        flat, counts = np.concatenate([f for f, _ in done]), np.concatenate([n for _, n in done])
        if self.room > 0:  # what comes first is what comes often
            ends = np.cumsum(counts)
            taken = bounds[1:] + 4 * ends + ENTRY * np.arange(1, len(words) + 1)
            some = int(np.searchsorted(taken, self.room, side="right"))
            self.room = self.room - int(taken[-1])
            if some:
                self.known = pa.concat_arrays([self.known, words[:some]])
                self.ends = np.concatenate((self.ends, len(self.flat) + ends[:some]))
                self.flat = np.concatenate((self.flat, flat[: ends[some - 1]]))
        return flat, counts

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of lower-case texts."""
        starts, words = self._words("\n".join([*texts, "", ""]))
        if not len(starts):
            yield from [b""] * len(texts)
            return
        words = words.dictionary_encode()
        row = pc.index_in(words.dictionary, value_set=self.known)
        fresh = row.is_null().to_numpy(zero_copy_only=False)
        row = row.fill_null(0).to_numpy()[~fresh]
        first, size, flat = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), self.flat
        first[~fresh], size[~fresh] = self.ends[row], self.ends[row + 1] - self.ends[row]
        if fresh.any():
            more, counts = self._learn(words.dictionary.filter(pa.array(fresh)))
            first[fresh], size[fresh] = len(flat) + np.cumsum(counts) - counts, counts
            flat = np.concatenate((flat, more))
        place = words.indices.to_numpy()
        n = size[place]
        ends = np.cumsum(n)
        at = np.repeat(first[place] - ends + n, n)
        at += np.arange(len(at))
        ids = flat[at].tobytes()
        ends = np.concatenate(([0], 4 * ends))[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))].tolist()
        for a, b in pairwise([0, *ends]):
            yield ids[a:b]

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """The text in lower case, cut at blanks."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        at = 0
        while len(text) - at > PART and (blank := BLANK.search(text, at + PART)):
            yield text[at : blank.start()]
            at = blank.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        held: list[list[str | bytes]] = []
        size = 0
        for text in texts:
            special = "<|" in text and self.special.search(text)
            held.append([q for p in (self.special.split(text) if special else [text]) for q in ([self.added[p]] if p in self.added else self._parts(p))])
            size += len(text)
            if size >= PART:
                yield from self._flushed(held)
                held, size = [], 0
        yield from self._flushed(held)

    def _flushed(self, cut: list[list[str | bytes]]) -> Iterator[bytes]:
        """The ids of texts in parts; bytes are ids already."""
        todo = [p for parts in cut for p in parts if isinstance(p, str)]
        ids = chain.from_iterable(map(self._encode, batches_of(iter(todo), PART)))
        for parts in cut:
            yield b"".join([p if isinstance(p, bytes) else next(ids) for p in parts])

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids joined by blanks, in UTF-8: the vocabulary file names no decoder."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def batches_of(texts: Iterator[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of texts (null as empty) of about ``limit`` characters, so that memory follows the longest text alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
