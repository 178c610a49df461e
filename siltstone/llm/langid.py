"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs.

A text is lower-cased, runs of anything but letters become one space, and its
UTF-8 bytes give counts of one-, two- and three-byte grams, hashed into DIMS
bins, square-rooted and scaled to unit length.  One-versus-one linear support
vector machines vote for the family; those between the languages of that family
vote for the language.  The score is the product of the winner's weakest
pairwise confidences at both levels.

The models are trained from at most ``per_lang`` labelled texts a language, those with the
smallest hashes.  Each machine is a group of its own, with the feature vectors of the languages it
separates, so machines are trained side by side in tasks; only their weights (bounded
by the number of languages) come to the driver.  Prediction reads every whole text.

Edge cases: null texts and texts without letters are ``und`` with score 0, and
so is everything if there is nothing to learn from; one known language is
predicted for all; rows without a label or an id are predicted but not learned
from (null id: not held out, not learned); repeated rows are predicted each and
learned once; kept columns that clash with the outputs give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

UND = "und"
PER_LANG = 400
UNIGRAMS, BIGRAMS, TRIGRAMS = 256, 1024, 4096
DIMS = UNIGRAMS + BIGRAMS + TRIGRAMS
#: Language codes by family; a code in none of them is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_CLEAN = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_CHUNK = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed byte grams; None where the text has no letters."""
    if not text:
        return None
    clean = b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split())
    if not clean:
        return None
    if min(clean.replace(b" ", b"")) >= 0x80 and not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(DIMS, dtype=np.float32)
    padded = b" " + clean + b" "
    for start in range(0, len(padded), _CHUNK):  # whole text, in pieces that overlap by two bytes
        a = np.frombuffer(padded[start : start + _CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        n = min(len(a), _CHUNK)
        two = (a[:-1] << 8) | a[1:]
        three = (two[:-1] << 8) | a[2:]
        counts[:UNIGRAMS] += np.bincount(a[:n], minlength=UNIGRAMS)
        counts[UNIGRAMS : UNIGRAMS + BIGRAMS] += np.bincount((two[:n] * np.uint32(2654435761)) >> 22, minlength=BIGRAMS)
        counts[UNIGRAMS + BIGRAMS :] += np.bincount((three[:n] * np.uint32(2654435761)) >> 20, minlength=TRIGRAMS)
    counts[0x20] = 0
    np.sqrt(counts, out=counts)
    return counts / np.sqrt(counts @ counts)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (last: bias) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1."""
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    diagonal = 0.5 / cost
    square = np.array([float(v @ v) for v in x]) + 1 + diagonal  # the bias counts as a feature of 1
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Votes:
    """One-versus-one classifiers between labels; row k of weights separates pairs[k]."""

    labels: list[str]
    pairs: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The label with most votes (ties: larger sum of margins, then label order), and its weakest confidence."""
        if len(self.labels) == 1:
            return self.labels[0], 1.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        a, b = self.pairs[:, 0], self.pairs[:, 1]
        votes, sums, weakest = np.zeros(len(self.labels)), np.zeros(len(self.labels)), np.full(len(self.labels), np.inf)
        np.add.at(votes, np.where(margin >= 0, a, b), 1)
        np.add.at(sums, a, margin)
        np.add.at(sums, b, -margin)
        np.minimum.at(weakest, a, margin)
        np.minimum.at(weakest, b, -margin)
        best = max(range(len(votes)), key=lambda i: (votes[i], sums[i], -i))
        return self.labels[best], float(1 / (1 + np.exp(-4 * np.clip(weakest[best], -50, 50))))


@dataclass
class Model:
    families: Votes
    languages: dict[str, Votes]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None:
            return UND, 0.0
        family, sure = self.families.predict(x)
        lang, surer = self.languages[family].predict(x)
        return lang, sure * surer


def training_rows(docs: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, h, x): feature vectors of the texts with the smallest hashes, about 1.2 times per_lang a language."""
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col) & F.col(id_col).isNotNull()).alias("learn")
    ).where("learn and lang is not null and text is not null")
    # Hashes are even, so a share of their range is a share of the rows; a fifth more than needed is looked at.
    bound = F.lit(None).cast("long")
    for row in labelled.groupBy("lang").count().collect():  # one row a language
        share = min(1.0, 1.2 * per_lang / row["count"])
        bound = F.when(F.col("lang") == row["lang"], F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).otherwise(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            packed = pa.array([None if x is None else x.astype("<f2").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["lang", "h", "x"])

    chosen = labelled.where(F.col("h") <= bound).select("lang", "h", "text").mapInArrow(run, "lang string, h long, x binary").where("x is not null")
    return chosen.groupBy("lang", "h").agg(F.min("x").alias("x"))  # repeated rows once


def machines(labels: list[str]) -> list[tuple[str | None, str, str, dict[str, float]]]:
    """(family, or None for those between families; label of each side; the side of every language it separates, +1 or -1)."""
    families: dict[str, list[str]] = {}
    for lang in labels:
        families.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
    out = [(None, a, b, dict.fromkeys(families[a], 1.0) | dict.fromkeys(families[b], -1.0)) for a, b in combinations(sorted(families), 2)]
    return out + [(f, a, b, {a: 1.0, b: -1.0}) for f in sorted(families) for a, b in combinations(sorted(families[f]), 2)]


def train_machines(rows: DataFrame, found: list[tuple[str | None, str, str, dict[str, float]]]) -> dict[int, np.ndarray]:
    """Weights of every machine, by its place in ``found``, from rows (lang, h, x)."""
    spark = rows.sparkSession
    sides = spark.createDataFrame([(lang, m, y) for m, (*_, of) in enumerate(found) for lang, y in of.items()], "lang string, machine int, y double")

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["lang"].to_pylist(), table["h"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist(), strict=True))
        x = np.empty((len(order), DIMS), dtype=np.float32)
        for i, (_, _, packed, _) in enumerate(order):
            x[i] = np.frombuffer(packed, dtype="<f2")
        weights = train_svm(x, np.array([y for *_, y in order])).astype("<f4").tobytes()
        return pa.table([table["machine"].slice(0, 1), pa.array([weights], pa.binary())], names=["machine", "weights"])

    # A stated number of parts: the vectors are so small that adaptive execution would train all machines in one task.
    parts = max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = rows.join(sides, "lang").repartition(parts, "machine").groupBy("machine")
    return {r["machine"]: np.frombuffer(r["weights"], dtype="<f4") for r in groups.applyInArrow(run, "machine int, weights binary").collect()}


def fit(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on the rows that are not held out; None if no row has a label and letters."""
    looked_at = training_rows(docs, per_lang, id_col, text_col, lang_col)  # about 1.2 times per_lang a language
    first = F.expr("row_number() over (partition by lang order by h, x)")
    rows = stored(looked_at.withColumn("r", first).where(F.col("r") <= per_lang).drop("r"), "language-vectors")
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    found = machines(labels)
    weights = train_machines(rows, found) if found else {}

    def votes(family: str | None, names: list[str]) -> Votes:
        own = [(m, names.index(a), names.index(b)) for m, (f, a, b, _) in enumerate(found) if f == family]
        pairs = np.array([(a, b) for _, a, b in own], dtype=np.int64).reshape(-1, 2)
        return Votes(names, pairs, np.array([weights[m] for m, _, _ in own], dtype=np.float32).reshape(len(own), DIMS + 1))

    families = {f: [x for x in labels if _FAMILY_OF.get(x, x) == f] for f in sorted({_FAMILY_OF.get(x, x) for x in labels})}
    return Model(votes(None, list(families)), {f: votes(f, names) for f, names in families.items()})


def classify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of docs with the predicted language and score of every row.

    The model travels with the function; its size depends on the number of languages alone.
    """
    keep = [c for c in keep if c not in out]
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [(UND, 0.0) if model is None else model.predict(t.as_py()) for t in texts]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, *out])

    return source.mapInArrow(run, schema)
