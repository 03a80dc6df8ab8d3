"""Byte-level BPE encoding and decoding.

Merging is done for many words at once. The symbols of all words of a batch lie in one flat array; in each round the pairs
of neighbours are looked up by binary search in the sorted array of mergeable pair keys, the lowest-ranked pair of every
word is merged wherever it stands in that word, and the array is compacted. The number of rounds is that of the longest
chain of merges in one word, not the number of words.

Texts are cut into words over arrays of characters, too: each character has a class, and the pre-tokenizer's pattern cuts
where classes change. A worker keeps the words that it has seen and their ids in a bounded table of arrays. Words are found by
hashes and compared; one whose hash is another word's is merged by itself.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import regex

from .common import give_back
from .hashing import equal_spans, gathered, span_hashes

#: Words that a worker's table keeps at most; of more, those used last stay. It costs time and changes no result.
MOST_WORDS = 1 << 19
#: Characters of text that are cut into words at a time, and words that are merged together.
CHUNK, WORD_BATCH = 1 << 17, 1 << 15

#: Classes of characters: white space, letters, numbers, all others, and what stands between texts.
_SPACE, _LETTER, _NUMBER, _OTHER, _BETWEEN = range(5)
_CLASSES = [(_SPACE, regex.compile(r"\s")), (_LETTER, regex.compile(r"\p{L}")), (_NUMBER, regex.compile(r"\p{N}"))]
#: What follows an apostrophe as a word of its own (fixed values), by how many letters it has.
_ENDINGS = {1: "stmd", 2: ("re", "ve", "ll")}
#: A space that always begins a word.
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in names]
    names |= {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Characters:
    """The class of every character, found by blocks of 256 as they come up."""

    def __init__(self):
        self.of = np.full(0x110000, _OTHER, np.uint8)
        self.known = np.zeros(0x1100, bool)

    def classes(self, points: np.ndarray) -> np.ndarray:
        for block in np.flatnonzero((np.bincount(points >> 8, minlength=0x1100) > 0) & ~self.known):
            text = "".join(map(chr, range(block << 8, block + 1 << 8)))
            for kind, pattern in _CLASSES:
                for m in pattern.finditer(text):
                    self.of[(block << 8) + m.start()] = kind
            self.known[block] = True
        return self.of[points]


def word_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in an array of characters, texts in it ended by one of class _BETWEEN, which is a word by itself.

    A word is a run of one class, with the space before it if there is one. Of several white-space characters before a word
    all but the last are one; the last is the word's if it is a space, else one by itself. An apostrophe that begins a word
    takes an ending after it.
    """
    begin = np.append(True, classes[1:] != classes[:-1])
    between = classes == _BETWEEN
    begin |= between
    begin[1:] |= between[:-1]
    last = np.flatnonzero((classes[:-1] == _SPACE) & (classes[1:] != _SPACE) & ~between[1:])
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & (classes[1:] == _LETTER))
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        size = np.isin(one, list(map(ord, _ENDINGS[1]))).astype(np.int64)
        for a, b in _ENDINGS[2]:
            size[(one == ord(a)) & (two == ord(b))] = 2
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        begin[quote + 1 + size] = True
    return np.flatnonzero(begin)


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers format (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = list(map(str, range(size)))
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.by_rank = keys[order], np.arange(len(keys), dtype=np.int32)[order], made
        # The ranks of pairs of bytes, of which the first round has nothing else.
        both = (self.first.astype(np.int64)[:, None] << 32 | self.first[None, :]).ravel()
        self.of_bytes = self._ranks(both)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.characters = Characters()
        self.forget()

    # -- merging -----------------------------------------------------------------------------------------------------

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; the number of merges where there is none."""
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.rank[found], np.int32(len(self.keys)))

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words (not empty) that stand in ``data`` one after the other."""
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        flat, none = self.first[data], np.int32(len(self.keys))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(flat), none, np.int32)
        if len(flat):
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]][inside]
        while len(flat):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, starts), counts)
            done = least == none
            if done.any():  # words with nothing left to merge leave the array
                out.append((owner[done], flat[done]))
                keep = ~done
                flat, owner, rank, least = flat[keep], owner[keep], rank[keep], least[keep]
                if not len(flat):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # runs such as "aaa": every second one from the left
                idx = np.flatnonzero(hit)
                begins = np.flatnonzero(np.append(True, np.diff(idx) != 1))
                offset = idx - np.repeat(idx[begins], np.diff(np.append(begins, len(idx))))
                hit[idx[offset % 2 == 1]] = False
            where = np.flatnonzero(hit)
            flat[where] = self.by_rank[least[where]]
            keep = np.ones(len(flat), bool)
            keep[where + 1] = False
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            merged = where - np.arange(len(where))  # where the new symbols stand now
            rank[-1] = none
            for at in (merged[merged < len(flat) - 1], merged[merged > 0] - 1):  # only the pairs with a new symbol have changed
                rank[at] = np.where(owner[at] == owner[at + 1], self._ranks(flat[at].astype(np.int64) << 32 | flat[at + 1]), none)
        if not out:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        owner, flat = np.concatenate([o for o, _ in out]), np.concatenate([f for _, f in out])
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    # -- the table of words ------------------------------------------------------------------------------------------

    def forget(self) -> None:
        self.hashes, self.ids, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.start, self.size, self.used, self.text_start, self.text_size = (np.zeros(0, np.int64) for _ in range(5))
        self.tick = 0

    def _merge_all(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many) of words of ``data``, merged in batches of like length."""
        order = np.argsort(size, kind="stable")  # words of like length finish in like rounds
        found, counts = [np.zeros(0, np.int32)], np.zeros(len(size), np.int64)
        for k in range(0, len(order), WORD_BATCH):
            part = order[k : k + WORD_BATCH]
            ids, counts[part] = self.merge(data[gathered(start[part], size[part])], size[part])
            found.append(ids)
        starts = np.zeros(len(size), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), starts, counts

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Put unseen words (ascending hashes) into the table."""
        if len(self.hashes) and len(self.hashes) + len(hashes) > MOST_WORDS:  # the half that was used last stays, this chunk's words with it
            keep = np.flatnonzero(self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
            self.ids = self.ids[gathered(self.start[keep], self.size[keep])]
            self.text = self.text[gathered(self.text_start[keep], self.text_size[keep])]
            self.hashes, self.size, self.used, self.text_size = self.hashes[keep], self.size[keep], self.used[keep], self.text_size[keep]
            self.start, self.text_start = (np.cumsum(x) - x for x in (self.size, self.text_size))
        ids, starts, counts = self._merge_all(data, start, size)
        at, place = np.searchsorted(self.hashes, hashes), len(self.text) + np.cumsum(size) - size
        self.hashes, self.start = np.insert(self.hashes, at, hashes), np.insert(self.start, at, len(self.ids) + starts)
        self.size, self.used = np.insert(self.size, at, counts), np.insert(self.used, at, self.tick)
        self.text_start, self.text_size = np.insert(self.text_start, at, place), np.insert(self.text_size, at, size)
        self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, data[gathered(start, size)]])

    # -- texts -------------------------------------------------------------------------------------------------------

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens, all at once."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        classes = self.characters.classes(points)
        between = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[between] = _BETWEEN
        begin = word_starts(points, classes)
        words = classes[begin] != _BETWEEN
        if len(points) == len(data):
            start = begin
        else:
            width = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
            start = (np.cumsum(width, dtype=np.int64) - width)[begin]
        end = np.append(start[1:], len(data))
        start, size = start[words], (end - start)[words]
        self.tick += 1
        unique, first, which = np.unique(span_hashes(data, start, start + size), return_index=True, return_inverse=True)
        model = first[which]
        same = size == size[model]
        same[same] = equal_spans(data, start[same], data, start[model[same]], size[same])
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != unique if len(self.hashes) else np.ones(len(unique), bool)
        known = np.flatnonzero(~new)
        if len(known):  # what the table has under this hash may be another word
            self.used[at[known]] = self.tick
            mine = self.text_size[at[known]] == size[first[known]]
            some = known[mine]
            mine[mine] = equal_spans(data, start[first[some]], self.text, self.text_start[at[some]], size[first[some]])
            other = np.zeros(len(unique), bool)
            other[known[~mine]] = True
            same &= ~other[which]
        if new.any():
            self._learn(unique[new], data, start[first[new]], size[first[new]])
            at = np.searchsorted(self.hashes, unique)
        at = at[which]
        begins, counts, ids = self.start[at], self.size[at], self.ids
        odd = np.flatnonzero(~same)
        if len(odd):
            more, starts, counts[odd] = self._merge_all(data, start[odd], size[odd])
            begins[odd] = len(ids) + starts
            ids = np.concatenate([ids, more])
        all_counts = np.zeros(len(begin), np.int64)
        all_counts[words] = counts
        return np.split(ids[gathered(begins, counts)], np.cumsum(all_counts)[~words][:-1])

    def _units(self, text: str) -> list[str | int]:
        """A text as what is encoded by itself, in order: special tokens, what stands between them, and parts of long texts."""
        out: list[str | int] = []
        for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            at = 0
            while len(part) - at > CHUNK:
                found = _CUT.search(part, at + CHUNK - CHUNK // 8)
                if not found:
                    break
                out.append(part[at : found.start()])
                at = found.start()
            out.append(part[at:])
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text; special tokens in a text are taken as such, as the library does."""
        held: list[list[str | int]] = []
        plain: list[str] = []
        done: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            ready = iter(done + (self._ids(plain) if plain else []))
            for units in held:
                parts = [next(ready) if isinstance(u, str) else np.array([u], np.int32) for u in units]
                yield parts[0] if len(parts) == 1 else np.concatenate(parts)
            held.clear()
            plain.clear()
            done.clear()

        for text in texts:
            held.append(self._units(text))
            for u in held[-1]:
                if isinstance(u, str):
                    plain.append(u)
                    size += len(u) + 1
                    if size >= CHUNK:
                        done += self._ids(plain)
                        plain.clear()
                        size = 0
            if not plain:
                yield from flush()
        yield from flush()


@functools.cache
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def release(path: str) -> None:
    """Forget the worker's words at the end of a task: workers last over many stages, memory is bounded by a task's."""
    codec(path).forget()
    give_back()


def encode_to_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    for ids in codec(path).encode(texts):
        yield ids.astype("<u4").tobytes()


def decode(ids: list[int], path: str) -> str:
    """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD as in the library."""
    return b"".join(map(codec(path).bytes_of.__getitem__, ids)).decode("utf-8", "replace")
