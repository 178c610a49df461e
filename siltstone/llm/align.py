"""Links between the tokens of two tokenizers, weighed by how many documents hold them.

Both tokenizers cut a text's bytes; where tokens of both end at the same byte, a
group of tokens ends, and every token of A is linked with every token of B in its group.  A
pair of ids is one packed integer, A's id in the upper 32 bits.  Each partition counts its
documents' different pairs with ``np.unique``; the partial counts are range-partitioned and
sorted by key, equal keys are runs whose counts are summed, and every range is written as a sorted
shard of raw 64-bit integers in the folder that all executors share.  Lookups map the shards into memory and
find keys with ``searchsorted``.

A shard's name holds a random part, so a task that runs again writes anew, and only the shards that the
stored manifest names are read.  What the driver sees is the manifest: a row a shard and
the highest count of each of A's ids, so at most A's vocabulary.

Neither tokenizer joins across a single space or line end between two other characters (A splits
there before it merges; no piece of B holds a space or line end after another character), so a text is cut there and each
different chunk is tokenized once while it is remembered; the memory is bounded and changes no result.  A Python worker
keeps both tokenizers and this memory from task to task: loaded anew by each, they left it larger every time.

Edge cases: a null or empty text has no tokens, nor has one that B does not give back byte for byte
(it holds U+2581): zeros, and '' for the digest; repeated rows are documents each; a null id is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stored
from .warc import filesystem

#: Chunks that a worker remembers, beside those of one batch.
MEMORY = 200_000
#: Texts that are cut, and chunks that are tokenized, at once.
TEXTS, CHUNKS = 256, 8192
#: Keys that a task holds before it folds equal ones, and different ones before it hands them on.
FOLD = 4_000_000
SHIFT = 32
#: A chunk begins with a single space or line end between two characters that are not white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Such a line end.
_LINE = re.compile(r"\n\S")
#: Links of a group beyond which its equal ids are counted first.
LARGE = 4096
_LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
_MANIFEST = "first long, last long, n long, name string, ids binary, best binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers: ids of chunks, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; every further thread keeps memory of its own
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        whole = lambda token: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a_bytes = [whole(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in several], dtype=np.int64) for several in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def ids(self, chunks: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """A's and B's ids of chunks, which begin with a space or a line end; None where either does not give back the bytes."""
        in_a = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        in_b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for i, chunk in enumerate(chunks):
            if chunk[0] != " ":  # the space that B puts first
                in_b[i] = in_b[i][1:] if in_b[i][:1] == [self.space] else []
            elif len(chunk) == 1:
                in_b[i] = [self.space]
        whole = "".join(chunks).encode()
        if all(b"".join(map(of.__getitem__, chain.from_iterable(ids))) == whole for of, ids in ((self.a_bytes, in_a), (self.b_bytes, in_b))):
            return list(zip(in_a, in_b, strict=True))
        same = [b"".join(map(self.a_bytes.__getitem__, a)) == c.encode() == b"".join(map(self.b_bytes.__getitem__, b)) for c, a, b in zip(chunks, in_a, in_b, strict=True)]
        return [(a, b) if ok else None for a, b, ok in zip(in_a, in_b, same, strict=True)]


def split(text: str) -> list[str]:
    """Chunks that begin with a line end and another character, and others without the space they begin with."""
    if " ".join(text.split()) == text.replace("\n", " "):  # single spaces and line ends between other characters
        return text.replace("\n", " \n").split(" ")
    out = [c if _LINE.match(c) else c[1:] for c in _CUT.split(" " + text)]
    return ["", *out] if _LINE.match(out[0]) else out


class Aligner:
    """Links of texts, with a bounded memory of chunks."""

    def __init__(self, tokenizers: Tokenizers, memory: int = MEMORY):
        self.tokenizers, self.memory = tokenizers, memory
        # An id as it is shown before another one of its side, before the other side, and at the end of a group.
        both = [str(i) for i in range(len(tokenizers.a_bytes))], [str(i) for i in range(len(tokenizers.b_bytes))]
        self.shapes = np.array([f"{i}{mark}" for side, marks in zip(both, (",|", ",;"), strict=True) for mark in marks for i in side], dtype=object)
        self.index: dict[str, int] = {}
        self.shown: list[str] = []
        self.size = 0
        #: n_a, n_b, n_groups, n_links, bad, first key, number of keys, uses of each chunk.
        self.stats = np.zeros((8, 0), dtype=np.int64)
        self.keys, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Forget what came in one text only since the last time, or all if that is still too much."""
        kept = np.flatnonzero(self.stats[7] > 1)
        size, n = sum(len(self.shown[i]) for i in kept.tolist()), self.stats[6, kept]
        if 2 * len(kept) > self.memory or size > 32 * self.memory or n.sum() > 16 * self.memory:
            kept, size, n = kept[:0], 0, n[:0]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.stats[5, kept] - (ends - n), n)
        chunks = list(self.index)
        self.index = {chunks[i]: k for k, i in enumerate(kept.tolist())}
        self.shown, self.size = [self.shown[i] for i in kept.tolist()], size
        self.keys, self.times, self.stats = self.keys[at], self.times[at], self.stats[:, kept]
        self.stats[5], self.stats[7] = ends - n, 0

    def _add(self, chunks: list[str]) -> None:
        """Tokenize chunks and remember their links; all are aligned at once, as if they stood in one text."""
        found = self.tokenizers.ids([c if _LINE.match(c) else " " + c for c in chunks])
        self.index.update(zip(chunks, range(len(self.shown), len(self.shown) + len(chunks)), strict=True))
        good = [x for x in found if x is not None]
        stats = np.zeros((8, len(chunks)), dtype=np.int64)
        bad = np.array([x is None for x in found])
        stats[4], stats[5] = bad, len(self.keys)
        shown: list[str] = []
        if good:
            n_a, n_b = (np.array([len(x[side]) for x in good], dtype=np.int64) for side in (0, 1))
            a, b = (np.array([i for x in good for i in x[side]], dtype=np.int64) for side in (0, 1))
            ends_a, ends_b = np.cumsum(self.tokenizers.a_size[a]), np.cumsum(self.tokenizers.b_size[b])
            last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
            cut_a, cut_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
            in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)  # tokens of each group
            chunk_ends = np.searchsorted(cut_a, np.cumsum(n_a)) + 1
            keys, times, group = self._pairs(a, b, cut_a - in_a, in_a, cut_b - in_b, in_b)
            in_chunk = np.diff(np.searchsorted(group, chunk_ends), prepend=0)
            links = np.concatenate([[0], np.cumsum(in_a * in_b)])[chunk_ends]
            stats[:4, ~bad] = n_a, n_b, np.diff(chunk_ends, prepend=0), np.diff(links, prepend=0)
            stats[5, ~bad] += np.cumsum(in_chunk) - in_chunk
            stats[6, ~bad] = in_chunk
            # All ids as shown: a group's of A, then its of B.
            place_a = np.arange(len(a)) + np.repeat(cut_b - in_b, in_a)
            place_b = np.arange(len(b)) + np.repeat(cut_a, in_b)
            shape = np.zeros(len(a) + len(b), dtype=np.int64)
            many_a, many_b = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
            shape[place_a], shape[place_b] = a + many_a * last_a, 2 * many_a + b + many_b * last_b
            parts, at = self.shapes[shape].tolist(), 0
            for n in (n_a + n_b).tolist():
                shown.append("".join(parts[at : at + n]))
                at += n
            self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        rest = iter(shown)
        self.shown.extend("" if x is None else next(rest) for x in found)
        self.stats = np.concatenate([self.stats, stats], axis=1)
        self.size += sum(map(len, chunks)) + sum(map(len, shown))

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, in_a: np.ndarray, from_b: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair keys of all groups, how often each is linked there, and the group, in order; equal keys of a large group are one."""
        n = in_a * in_b
        large = np.flatnonzero(n > LARGE)
        n = np.where(n > LARGE, 0, n)
        group = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        keys = a[from_a[group] + inside // in_b[group]] << SHIFT | b[from_b[group] + inside % in_b[group]]
        times = np.ones(len(keys), dtype=np.int64)
        for g in large.tolist():  # tokens said over and over, as a rule
            x, m = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            y, k = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            at = np.searchsorted(group, g)
            keys = np.insert(keys, at, (x[:, None] << SHIFT | y[None]).ravel())
            times = np.insert(times, at, (m[:, None] * k[None]).ravel())
            group = np.insert(group, at, np.full(len(x) * len(y), g))
        return keys, times, group

    def links(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """Of each text n_a, n_b, n_groups, n_links, digest of the groups, different pair keys in order, how often each is linked."""
        if len(self.index) > self.memory or self.size > 64 * self.memory or len(self.keys) > 32 * self.memory:
            self._forget()
        cut = [split(t) if t else [] for t in texts]
        if new := set().union(*cut).difference(self.index):
            ordered = sorted(new)
            for at in range(0, len(ordered), CHUNKS):
                self._add(ordered[at : at + CHUNKS])
        return [self._of(chunks) for chunks in cut]

    def _of(self, chunks: list[str]) -> tuple[int, int, int, int, str, bytes, bytes]:
        index, shown = self.index, self.shown
        places = [index[c] for c in chunks]
        which, often = np.unique(np.array(places, dtype=np.int64), return_counts=True)
        self.stats[7, which] += 1
        stats = self.stats[:, which]
        if not chunks or stats[4].any():
            return _NOTHING
        n = stats[6]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(stats[5] - (ends - n), n)
        keys, inverse = np.unique(self.keys[at], return_inverse=True)
        times = np.bincount(inverse, weights=self.times[at] * np.repeat(often, n), minlength=len(keys)).astype(np.int64)
        digest = hashlib.sha256("".join([shown[i] for i in places])[:-1].encode()).hexdigest()
        return (*(stats[:4] @ often).tolist(), digest, keys.tobytes(), times.tobytes())


@cache
def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker."""
    return Aligner(Tokenizers(a_path, b_path))


_NOTHING: tuple[int, int, int, int, str, bytes, bytes] = (0, 0, 0, 0, "", b"", b"")


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its groups and links; texts are tokenized once, the result is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_path, b_path)
        for batch in batches:
            rows = [row for at in range(0, batch.num_rows, TEXTS) for row in aligner.links(batch.column(1).slice(at, TEXTS).to_pylist())]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(plain.mapInArrow(run, _LINKS), "token-links")


def _count_batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def _fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def partial_counts(links: DataFrame, fold: int = FOLD) -> DataFrame:
    """(key, n): in how many of a partition's documents a pair is linked; a key may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: list[tuple[np.ndarray, np.ndarray]] = []
        pending: list[np.ndarray] = []
        size = 0

        def fold_all() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.int64),) * 2
            return _fold([keys, *[k for k, _ in folded]], [counts, *[c for _, c in folded]])

        for batch in batches:
            for value in batch.column(0):
                keys = np.frombuffer(value.as_buffer(), dtype=np.int64)
                pending.append(keys)
                size += len(keys)
                if size >= fold:
                    found = fold_all()
                    if len(found[0]) > fold // 2:
                        yield from _in_parts(*found)
                        found = (np.zeros(0, np.int64),) * 2
                    folded, pending, size = [found], [], len(found[0])
        yield from _in_parts(*fold_all())

    return links.select("keys").mapInArrow(run, "key long, n long")


def _in_parts(keys: np.ndarray, counts: np.ndarray, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), rows):
        yield _count_batch(keys[at : at + rows], counts[at : at + rows])


@dataclass
class LinkCounts:
    """Where the sorted shards are: folder; (first key, last key, number, name) of each in order; the highest count of each of A's ids."""

    folder: str
    shards: list[tuple[int, int, int, str]]
    best: np.ndarray

    def reader(self) -> ShardReader:
        return ShardReader(self)


class ShardReader:
    """Counts of keys; a shard is mapped when one of its keys is first asked for."""

    def __init__(self, counts: LinkCounts):
        self.counts, self.open = counts, {}
        self.last = np.array([s[1] for s in counts.shards], dtype=np.int64)

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            from pyarrow import fs

            _, _, n, name = self.counts.shards[i]
            files, root = filesystem(self.counts.folder)
            if isinstance(files, fs.LocalFileSystem):
                both = np.memmap(f"{root}/{name}.keys", np.int64, "r", shape=n), np.memmap(f"{root}/{name}.counts", np.int64, "r", shape=n)
            else:  # a store without files to map
                both = tuple(np.frombuffer(files.open_input_file(f"{root}/{name}.{kind}").read(), np.int64) for kind in ("keys", "counts"))
            self.open[i] = both
        return self.open[i]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; keys ascend and all are in the shards."""
        out = np.zeros(len(keys), dtype=np.int64)
        of = np.searchsorted(self.last, keys)
        ends = np.flatnonzero(np.diff(of)) + 1
        for start, end in zip([0, *ends], [*ends, len(keys)], strict=True):
            if end > start:
                shard_keys, shard_counts = self._shard(int(of[start]))
                out[start:end] = shard_counts[np.searchsorted(shard_keys, keys[start:end])]
        return out


def link_counts(links: DataFrame, vocabulary: int, fold: int = FOLD) -> LinkCounts:
    """Documents per pair, over all links: partial counts, a global sort by ranges, sums of runs, a shard a range."""
    spark = links.sparkSession
    folder = fresh_path(spark, "link-counts")
    partial = stored(partial_counts(links, fold), "link-partials")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        name, n, first, last = f"shard-{uuid.uuid4().hex}", 0, None, None
        best = np.zeros(vocabulary, dtype=np.int64)
        out = None
        open_run: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal out, n, first, last
            if not len(keys):
                return
            if out is None:
                out = [files.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("keys", "counts")]
                first = int(keys[0])
            for stream, values in zip(out, (keys, counts), strict=True):
                stream.write(values.astype(np.int64).tobytes())
            n, last = n + len(keys), int(keys[-1])
            np.maximum.at(best, keys >> SHIFT, counts)

        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([open_run[0], batch.column(0).to_numpy()])
                counts = np.concatenate([open_run[1], batch.column(1).to_numpy()])
                heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, counts = keys[heads], np.add.reduceat(counts, heads)
                write(keys[:-1], counts[:-1])
                open_run = keys[-1:], counts[-1:]
        write(*open_run)
        if out is not None:
            for stream in out:
                stream.close()
            ids = np.flatnonzero(best)
            row = ([first], [last], [n], [name], [ids.astype(np.int64).tobytes()], [best[ids].tobytes()])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["first", "last", "n", "name", "ids", "best"])

    shards = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _MANIFEST)
    manifest = sorted(stored(shards, "link-shards").collect(), key=lambda r: r["first"])  # a row a shard
    best = np.zeros(vocabulary, dtype=np.int64)
    for row in manifest:
        ids = np.frombuffer(row["ids"], np.int64)
        best[ids] = np.maximum(best[ids], np.frombuffer(row["best"], np.int64))
    return LinkCounts(folder, [(r["first"], r["last"], r["n"], r["name"]) for r in manifest], best)


def weighed(links: DataFrame, counts: LinkCounts) -> DataFrame:
    """Documents with n_best (links whose count is their A id's highest) and count_sum (counts summed over links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = counts.reader()
        for batch in batches:
            each = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(6)]
            times = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(7)] or [np.zeros(0, np.int64)])
            keys, inverse = np.unique(np.concatenate(each or [np.zeros(0, np.int64)]), return_inverse=True)
            n = reader.look_up(keys)
            is_best = (n == counts.best[keys >> SHIFT]) if len(keys) else n.astype(bool)
            ends = np.cumsum([0, *map(len, each)])
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * is_best[inverse], times * n[inverse])]
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            columns = [*batch.columns[:5], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return stored(links.mapInArrow(run, _RESULT), "weighed-links")


def vocabulary_size(a_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(a_path).get_vocab_size()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    links = linked(docs, a_path, b_path, id_col, text_col)
    return weighed(links, link_counts(links, vocabulary_size(a_path)))
