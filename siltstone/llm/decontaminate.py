"""Benchmark decontamination with a distributed positional inverted index.

1. One pass over the training texts, whatever the benchmark, writes the index to the shared
   folder.  It is made of blocks of about BLOCK_WORDS words; a row is a term (the hash of a word) and the
   ascending positions at which a block has it.  Documents follow each other in a block's positions
   with room between them, so that no window reaches from one into the next; a block's
   directory names its documents and where each begins.
2. The windows of all items (WINDOW consecutive words; a shorter item is one window), each text
   once, have their terms ordered by their frequency in the index.  A window with a term that the corpus lacks occurs nowhere.
3. Windows meet the blocks that hold their PROBE rarest terms.  In each block the lists of a window's
   terms are adjusted by their offsets and intersected, from the rarest term on, until nothing is left or
   all terms agree: an exact phrase match.  For proximity, places at which at least ``min_terms`` of a window's distinct
   terms lie within RADIUS words of one of its rarest terms are matches, in any order.

Only lists of benchmark terms leave the index, by block, and nothing of benchmark or corpus
comes to the driver; the terms are broadcast up to BROADCAST_TERMS and joined by a shuffle beyond.

Edge cases: null and empty texts have no words and no hits; repeated items and
rows count each; items without an id produce hits but are not listed; an empty
benchmark leaves every document clean; ties in frequency go to the smaller term hash; other columns are ignored,
and clean() keeps them whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_name, row_key, scratch, settled, stored

WINDOW = 10
RADIUS = WINDOW - 1
#: Words of a block: bounds a task's memory; a longer text is a block of its own.
BLOCK_WORDS = 1_000_000
#: A window goes to the blocks that hold so many of its rarest terms.
PROBE = 3
#: Benchmark terms that are broadcast at most (8 bytes each).
BROADCAST_TERMS = 200_000
_MEMORY = 200_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_INDEX = "term long, block long, n int, at array<int>, keys array<binary>, ids array<long>, sizes array<int>"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all other non-ASCII characters."""
    return (text or b"").translate(_FOLD).split()


class Terms(dict):
    """Signed hashes of words, found once."""

    def __missing__(self, word: bytes) -> int:
        x = xxh64_intdigest(word)
        self[word] = x = x - (1 << 64) if x >> 63 else x
        return x

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self) > _MEMORY:
            self.clear()
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _block(keys: list, ids: list, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The directory of a block, and a row for each of its terms."""
    names = ["term", "block", "n", "at", "keys", "ids", "sizes"]
    block = uuid.uuid4().int >> 65
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    begin = np.r_[0, np.cumsum(sizes + WINDOW)[:-1]]
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), _lists(begin.astype(np.int32), np.array([len(begin)])), one(keys, pa.binary()), one(ids, pa.int64()), _lists(sizes.astype(np.int32), np.array([len(sizes)]))], names)
    term = np.concatenate(codes)
    if not len(term):
        return
    place = np.concatenate([np.arange(b, b + n, dtype=np.int32) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)])
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    ends = np.r_[np.flatnonzero(np.diff(term)) + 1, len(term)]
    n = len(ends)
    count = np.diff(np.r_[0, ends]).astype(np.int32)
    empty = [pa.nulls(n, pa.list_(kind)) for kind in (pa.binary(), pa.int64(), pa.int32())]
    yield pa.RecordBatch.from_arrays([pa.array(term[ends - 1]), pa.array(np.full(n, block, dtype=np.int64)), pa.array(count), _lists(place, ends), *empty], names)


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index of all rows of docs, stored: for every block its directory (term is null) and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        keys: list = []
        ids: list = []
        codes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                code = terms.of(text.as_py())
                if codes and held + len(code) > block_words:
                    yield from _block(keys, ids, codes)
                    keys, ids, codes, held = [], [], [], 0
                keys.append(key)
                ids.append(doc_id)
                codes.append(code)
                held += len(code) + WINDOW
        if codes:
            yield from _block(keys, ids, codes)

    pruned = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(pruned.mapInArrow(run, _INDEX), "positional-index")


def directory(index: DataFrame) -> DataFrame:
    """(block, doc, key, doc_id, n_words) of every indexed row; doc numbers the rows of a block."""
    rows = index.where("term is null").select("block", F.posexplode(F.arrays_zip("keys", "ids", "sizes")).alias("doc", "d"))
    return rows.select("block", "doc", F.col("d.keys").alias("key"), F.col("d.ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words"))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, terms) of every different window, terms in the order of the text, and (window, item_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            lists = _lists(np.concatenate([np.zeros(0, dtype=np.int64), *found]), np.cumsum([len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "code"])

    kind = items.schema["item_id"].dataType.simpleString()
    coded = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, code array<long>").where(F.size("code") > 0)
    length = F.least(F.lit(WINDOW), F.size("code"))
    starts = coded.select("item_id", "code", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("code") - length + 1)).alias("s"))
    rows = starts.select("item_id", F.slice("code", F.col("s"), F.col("length")).alias("terms"))
    rows = stored(rows.withColumn("window", F.xxhash64("terms")).distinct(), "item-windows")
    return rows.groupBy("window").agg(F.first("terms").alias("terms")), rows.select("window", "item_id").distinct()


def _of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of the index whose term is among terms(term)."""
    return index.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")


def _ordered(windows: DataFrame, lists: DataFrame) -> DataFrame:
    """(window, length, ordered: (frequency, term, offset), rarest first; the frequency is null where the corpus lacks the term)."""
    frequency = lists.groupBy("term").agg(F.sum("n").alias("df"))
    each = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term", "left")
    ranked = each.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("df", "term", "offset"))).alias("ordered"))
    return stored(ranked, "ordered-windows")


def _met(ranked: DataFrame, places: DataFrame, min_terms: int | None) -> DataFrame:
    """(window, block) where a block holds the PROBE rarest different terms of a window, or with min_terms any one that a match must have."""
    different = F.array_distinct(F.transform("ordered", lambda o: o["term"]))
    first = F.lit(PROBE) if min_terms is None else F.size(different) - F.least(F.lit(min_terms), F.size(different)) + 1
    rarest = ranked.select("window", F.slice(different, F.lit(1), first).alias("r"))
    needed = F.size("r") if min_terms is None else F.lit(1)
    probes = rarest.select("window", needed.alias("needed"), F.explode("r").alias("term"))
    return probes.join(places, "term").groupBy("window", "block", "needed").count().where("count >= needed").select("window", "block")


def exact_starts(ordered: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Starts at which all (ascending positions, offset) lists agree; the first list should be the shortest."""
    place, offset = ordered[0]
    start = place.astype(np.int64) - offset
    for place, offset in ordered[1:]:
        if not len(start):
            break
        wanted = start + offset
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        start = start[place[at] == wanted]
    return start


def near_places(terms: list[np.ndarray], anchors: int, least: int) -> np.ndarray:
    """Positions of the first ``anchors`` terms (ascending) around which at least ``least`` terms lie within RADIUS words."""
    centre = np.unique(np.concatenate(terms[:anchors])).astype(np.int64)
    met = np.zeros(len(centre), dtype=np.int64)
    for place in terms:
        met += np.searchsorted(place, centre + RADIUS, "right") > np.searchsorted(place, centre - RADIUS, "left")
    return centre[met >= least]


def _matches(index: DataFrame, items: DataFrame, min_terms: int | None, spans: bool) -> tuple[DataFrame, DataFrame]:
    """(block, doc, window, start, length, n_hit): with ``spans`` every match, else one row a document and window, and n_hit (window is null) per document; and (window, item_id)."""
    windows, of_item = item_windows(items)
    terms = stored(windows.select(F.explode("terms").alias("term")).distinct(), "benchmark-terms")
    lists = stored(_of_terms(index.where("term is not null").select("term", "block", "n", "at"), terms), "benchmark-lists")
    ranked, places = _ordered(windows, lists), lists.select("term", "block")
    if min_terms is None:
        ranked = ranked.where(F.forall("ordered", lambda o: o["df"].isNotNull()))
    pairs = _met(ranked, places, min_terms).join(ranked, "window").select("block", "window", "length", F.transform("ordered", lambda o: o["term"]).alias("terms"), F.transform("ordered", lambda o: o["offset"]).alias("offsets"))
    pairs = stored(pairs, "window-blocks")
    begins = index.where("term is null").select(F.lit(None).cast("long").alias("term"), "block", "at")
    sides = lists.select("term", "block", "at").unionByName(begins)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[], [], [], []]
        hits: list[np.ndarray] = []
        block = 0
        if len(held) and len(asked):
            block = held["block"][0].as_py()
            at = held["at"].combine_chunks()
            ends, flat = at.offsets.to_numpy(), at.values.to_numpy()
            place = {t: flat[a:b] for t, a, b in zip(held["term"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            begin = place.pop(None)
            covered = np.zeros(0, dtype=bool)
            for window, length, terms, offsets in zip(*(asked[c].to_pylist() for c in ("window", "length", "terms", "offsets")), strict=True):
                if min_terms is None:
                    if any(t not in place for t in terms):
                        continue
                    start = exact_starts([(place[t], o) for t, o in zip(terms, offsets, strict=True)])
                else:
                    different = list(dict.fromkeys(terms))
                    least = min(min_terms, len(different))
                    found = [place[t] for t in different if t in place]
                    # Any ``least`` of the terms include one of the rarest size - least + 1.
                    anchors = sum(t in place for t in different[: len(different) - least + 1])
                    if not anchors or len(found) < least:
                        continue
                    start = near_places(found, anchors, least)
                if not len(start):
                    continue
                doc = np.searchsorted(begin, start, "right") - 1
                if not spans:
                    if int(start[-1]) + length > len(covered):
                        covered = np.r_[covered, np.zeros(2 * (int(start[-1]) + length) - len(covered), dtype=bool)]
                    for s in start.tolist():
                        covered[s : s + length] = True
                    doc, first = np.unique(doc, return_index=True)
                    start = start[first]
                for column, values in zip(rows, (doc, np.full(len(doc), window), start - begin[doc], np.full(len(doc), length)), strict=True):
                    column.append(values)
            if not spans and len(covered):
                total = np.add.reduceat(np.r_[covered, np.zeros(int(begin[-1]) + 1, dtype=bool)].astype(np.int64), begin)
                hits = [np.flatnonzero(total), total[total > 0]]
        doc, window, start, length = (np.concatenate([np.zeros(0, dtype=np.int64), *r]).astype(np.int64) for r in rows)
        extra = len(hits[0]) if hits else 0
        pad = lambda a, kind: pa.concat_arrays([pa.array(a, kind), pa.nulls(extra, kind)])
        return pa.table(
            [
                pa.array(np.full(len(doc) + extra, block, dtype=np.int64)),
                pa.array(np.r_[doc, hits[0] if hits else doc[:0]], pa.int32()),
                pad(window, pa.int64()),
                pad(start, pa.int64()),
                pad(length, pa.int64()),
                pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(hits[1] if hits else doc[:0], pa.int64())]),
            ],
            names=["block", "doc", "window", "start", "length", "n_hit"],
        )

    found = sides.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, "block long, doc int, window long, start long, length long, n_hit long")
    return stored(found, "index-matches"), of_item


def _spans(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, block_words: int, min_terms: int | None) -> DataFrame:
    index = positional_index(docs, id_col, text_col, block_words)
    found, of_item = _matches(index, items, min_terms, True)
    named = found.join(of_item, "window").select("block", "doc", "item_id", "start", "length").distinct()
    return directory(index).select("block", "doc", "doc_id").join(named, ["block", "doc"]).drop("block", "doc")


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Exact phrases: one row (doc_id, item_id, start, length) per occurrence of an item window, in words."""
    return _spans(docs, items, id_col, text_col, block_words, None)


def proximity_matches(docs: DataFrame, items: DataFrame, min_terms: int = 8, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Places where at least min_terms of the different terms of an item window (all, if it has fewer) lie within RADIUS words, in any order.

    start is the place of one of the window's rarest terms, around which the others lie; length is the window's.  No place is missed for a changed word: with one of
    a window's terms gone, another one anchors it.
    """
    return _spans(docs, items, id_col, text_col, block_words, min_terms)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark window."""
    name = free_name(docs, "key")
    with scratch(docs.sparkSession):
        index = positional_index(docs, id_col, text_col, block_words)
        found, _ = _matches(index, items, None, False)
        hit = found.where("n_hit is not null").select("block", "doc")
        dirty = settled(directory(index).select("block", "doc", F.col("key").alias(name)).join(hit, ["block", "doc"], "left_semi").select(name).distinct(), "dirty-rows")
    return docs.withColumn(name, row_key(id_col, text_col)).join(dirty, name, "left_anti").select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside a matched window), item_ids (sorted strings)."""
    index = positional_index(docs, id_col, text_col, block_words)
    found, of_item = _matches(index, items, None, False)
    hit = found.where("window is null").select("block", "doc", "n_hit")
    listed = found.where("window is not null").join(of_item, "window").groupBy("block", "doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    none = F.array().cast("array<string>")
    out = directory(index).join(hit, ["block", "doc"], "left").join(listed, ["block", "doc"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))
