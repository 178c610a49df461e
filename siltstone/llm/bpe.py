"""BPE encoding and decoding with a pair occurrence index.

The vocabulary file is a BPE with end-of-word marks over byte-level letters, in
the JSON format of the tokenizers library; its path is a parameter, and every
executor reads it once a task.  Texts are normalised (NFC, white space, lower
case), split at white space, and each chunk into letter runs, single digits,
clitics and other runs.  The distinct pieces of a batch form one symbol array.
An index maps every mergeable pair to all its positions in that array; ranks
are applied in ascending order from a heap, all positions of a rank at once,
and the lists of the neighbouring pairs are updated.  Pieces are encoded once
for a batch and remembered for the task (the memory is emptied at CACHE_CHUNKS
chunks, which changes no result).

Edge cases: null and empty texts encode to nothing and decode to ""; special
tokens inside a text become their ids, as in the library; repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_CHUNKS = 200_000
#: Rows of an output batch hold at most about so many characters of input.
SLICE_CHARS = 2_000_000
# Fixed values of the format: White_Space, the separators that str.split() adds to it, and the pieces.
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SPACE = re.compile(f"[{_SPACES}]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


# Letters and digits (first and last) that Unicode 16 adds to 15.1, and lower case that Unicode 16 and 17 add.
_NEW_LETTERS = """
1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E
11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0
"""
_NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

# Marks that take no part in the library's NFC, which is that of Unicode 9, and U+11930, which composes with nothing there.
_LATER_MARKS = """
07FD-07FD 0898-089F 08CA-08D3 09FE-09FE 0C3C-0C3C 0D3B-0D3C 0EBA-0EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C 10D24-10D27
10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070-11070 1133B-1133B 1145E-1145E 11839-1183A 11930-11930 1193D-1193E
11943-11943 119E0-119E0 11A34-11A34 11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 11F41-11F42 16FF0-16FF1
1E08F-1E08F 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""


def _ranges(table: str) -> list[tuple[int, int]]:
    return [(int(first, 16), int(last, 16)) for first, last in (r.split("-") for r in table.split())]


def _bracketed(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_LATER_MARK = re.compile(f"([{_bracketed(_ranges(_LATER_MARKS))}])")


def composed(text: str) -> str:
    """NFC as the library has it."""
    if _LATER_MARK.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in _LATER_MARK.split(text))
    return unicodedata.normalize("NFC", text)


def _class_of(major: str, added: str) -> str:
    """The code points of a general category, as Unicode 16 (the library's version) has it, as ranges of a character class."""
    new = {c for first, last in _ranges(added) for c in range(first, last + 1)}
    inside = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major or c in new]
    starts = [c for c, before in zip(inside, [-2, *inside], strict=False) if c != before + 1]
    ends = [c for c, after in zip(inside, [*inside[1:], -2], strict=True) if c + 1 != after]
    return _bracketed(list(zip(starts, ends, strict=True)))


@cache
def piece_pattern() -> re.Pattern:
    """Clitics, letter runs, single digits and other runs."""
    letters, digits = _class_of("L", _NEW_LETTERS), _class_of("N", _NEW_DIGITS)
    return re.compile(f"{_CLITICS}|[{letters}]+|[{digits}]|[^{_SPACES}{letters}{digits}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self._forget()

    def _forget(self) -> None:
        """Empty the memories: ids and text of chunks (special tokens under a leading blank, which no chunk has), and of pieces."""
        self.ids = {" " + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.texts = {" " + t: t.encode() for t in self.special}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array, and the offsets of each piece in it."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        stop = np.cumsum(size)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbol = self.inner[raw]
        symbol[stop - 1] = self.final[raw[stop - 1]]
        after = np.arange(1, len(raw) + 1)
        after[stop - 1] = -1
        before = np.arange(-1, len(raw) - 1)
        before[(stop - size)] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions into the index."""
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, edges]].tolist(), np.split(at, edges), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(part)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            found = lists.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # overlapping occurrences: the leftmost wins
                taken, kept = -1, []
                for p in np.sort(at).tolist():
                    if p != taken:
                        kept.append(p)
                        taken = after[p]
                at = np.array(kept, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            following = after[gone]
            symbol[at], symbol[gone] = self.made[rank], -1
            after[at] = following
            inside = following >= 0
            before[following[inside]] = at[inside]
            previous = before[at]
            note(np.unique(np.concatenate([previous[previous >= 0], at[inside]])))
        alive = symbol >= 0
        count = np.cumsum(alive)
        return symbol[alive], np.r_[0, count[stop - 1]]

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not yet in memory."""
        known, ids, texts = self.pieces, self.ids, self.texts
        new = [c for c in chunks if c not in ids]
        if not new:
            return
        parts = [piece_pattern().findall(c if c.isascii() else c.translate(_NEW_LOWER)) for c in new]
        missing = list(set(chain.from_iterable(parts)).difference(known))
        if missing:
            found, offset = self.merge([p.encode() for p in missing])
            packed, words, ends = found.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, found.tolist())), offset.tolist()
            for piece, s, e in zip(missing, ends[:-1], ends[1:], strict=True):
                known[piece] = packed[4 * s : 4 * e], b" ".join(words[s:e])
        for c, ps in zip(new, parts, strict=True):
            if len(ps) == 1:
                ids[c], texts[c] = known[ps[0]]
            else:
                both = [known[p] for p in ps]
                ids[c], texts[c] = b"".join([x for x, _ in both]), b" ".join([t for _, t in both])

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks of the normalised text; a special token is one of its own."""
        if self.special_split and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.special_split.split(text)):
                out += [" " + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = composed(text)
            if "Σ" in text:  # lower() would look at its place in the word
                text = text.replace("Σ", "σ")
        text = text.lower()
        if _ODD_SPACE.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if len(self.ids) > CACHE_CHUNKS:
            self._forget()
        split = [self.chunks(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        ids, decoded = self.ids.__getitem__, self.texts.__getitem__
        return [b"".join(map(ids, cs)) for cs in split], [b" ".join(map(decoded, cs)) for cs in split]


def _slices(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """Consecutive runs of about SLICE_CHARS characters."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size or 0
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (the text that decoding gives)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PairIndexBpe(vocabulary)
        for batch in batches:
            for a, b in _slices(pc.utf8_length(batch.column(1)).to_pylist()):
                ids, decoded = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    pruned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pruned.mapInArrow(run, "doc_id long, ids binary, decoded string")
