"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning. The text is lower-cased (Unicode), and its n-grams of 1 to 4 code
points are hashed into ``BUCKETS`` counters. The learning rows are those that
are not held out and have a language; if there are more than ``max_train_docs``
distinct ones, those with the smallest hash of (doc_id, text) are used, whole.
Tasks count n-grams for each (language, bucket); Spark sums the counts, so the
driver receives a (languages x buckets) matrix, never a text.

Prediction. Log probabilities are broadcast in blocks of ``LANGS`` languages,
so one broadcast has a fixed bound (``LANGS`` x ``BUCKETS`` floats); more
languages take more passes over the texts, each of which keeps the best so far
and the sum of all. A pass is written before the next block is made, and its block is freed,
so the driver and the tasks hold one block however many languages there are. Every whole text is scored by numpy in batches: gather the
rows of its n-grams' buckets and add them up, with the logarithm of the
language's share of the learning rows. The score is the multinomial posterior
of the language predicted. Log probabilities are multiples of 2**-16, so sums are exact
and don't depend on how texts are batched.

Defined cases: null text, or no letter (Unicode L*): ``und``, score 0. Rows
without a language are predicted but teach nothing; rows without a doc_id may
teach; repeated rows teach once. Equal posteriors: the language that comes first in code-point order.
If nothing can be learned (empty table, no languages), every row is ``und``.
Extra columns stay (those named like a new one don't); lang and source are never read for a
prediction. Texts of any length are scored in windows of ``WINDOW`` code points; beside
the windows a text needs about 10 bytes a character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Rounds
from .common import chunks, code_points, held_out, hide, show, utf8, written

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
LANGS = 64
CHUNK_BYTES = 1 << 18
WINDOW = 1 << 17
_UNIT = 1 << 16


def _lower(texts: pa.Array) -> pa.Array:
    kind = pa.large_string()
    return pc.utf8_lower(texts.cast(kind).fill_null(""))


def ngram_buckets(points: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """Pairs (buckets, row of each) that hold all n-grams of every row, none across rows; a window of their first places at a time."""
    row_of = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    for first in range(0, len(points), window):
        low, row = points[first : first + window + max(ORDERS) - 1], row_of[first : first + window + max(ORDERS) - 1]
        here = min(window, len(points) - first)
        code = np.zeros(len(low), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(low) < n:
                break
            code = code[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                m = min(here, len(code))
                whole = row[:m] == row[n - 1 : n - 1 + m]
                mixed = (code[:m][whole] ^ np.uint32(n * 40503)) * np.uint32(2654435761)
                yield mixed >> np.uint32(16), row[:m][whole]


def _count(batches):
    for batch in batches:
        langs = pd.Series(batch.column("lang").to_pylist())
        total: dict[str, np.ndarray] = {}
        for lang, rows in langs.groupby(langs).groups.items():
            part = batch.take(pa.array(rows))
            for piece in chunks(iter([part]), "text", CHUNK_BYTES):
                counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for buckets, _ in ngram_buckets(*code_points(*utf8(_lower(piece.column("text"))))):
                    counts += np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"])


class Model:
    """Languages, their log shares, and the counts (lang, bucket, n) of their n-grams, from which blocks of LANGS languages are made one at a time."""

    def __init__(self, langs: list[str], shares: dict[str, int], counted: DataFrame | None):
        self.langs, self.shares, self.counted = langs, shares, counted

    def blocks(self):
        """(names, (log probabilities (BUCKETS, languages) float32, log shares)) block after block; none is kept here."""
        every = sum(self.shares.values())
        for first in range(0, len(self.langs), LANGS):
            own = self.langs[first : first + LANGS]
            found = self.counted.where(F.col("lang").isin(own)).toPandas()
            counts = np.zeros((BUCKETS, len(own)))
            counts[found["bucket"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(own)}).to_numpy(dtype=np.int64)] = found["n"].to_numpy()
            logs = np.log(counts + 0.5) - np.log((counts + 0.5).sum(0))
            yield own, (_rounded(logs).astype(np.float32), _rounded(np.log(np.array([self.shares[x] for x in own]) / every)))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT) / _UNIT


def fit(docs: DataFrame, max_train_docs: int = 20_000, seed: int = 42) -> Model:
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    keep = rows.select("h").distinct().orderBy("h").limit(max_train_docs).agg(F.max("h")).first()[0]
    if keep is None:
        return Model([], {}, None)
    chosen = rows.where(F.col("h") <= keep).dropDuplicates(["h", "lang"])
    shares = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}  # at most max_train_docs rows
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(sorted(shares), shares, written(counted, "language-counts") if len(shares) > LANGS else counted)


def joint(table: np.ndarray, prior: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, languages): log prior plus the n-grams' log probabilities, added exactly."""
    n = len(at) - 1
    total = np.tile(prior, (n, 1))
    for buckets, rows in ngram_buckets(points, at):
        for j in range(len(prior)):
            total[:, j] += np.bincount(rows, weights=table[:, j][buckets], minlength=n)
    return total


def _no_letter(text: str | None) -> bool:
    return not text or not any(map(str.isalpha, text))


def _scorer(block, names: list[str], first: bool, last: bool, keep_text: bool):
    """One pass: the columns, then best (number of the language), top (its joint logarithm), rest (sum of all others' shares of it)."""

    def score(batches):
        table, prior = block.value
        for piece in chunks(batches, "text", CHUNK_BYTES):
            texts = piece.column("text")
            total = joint(table, prior, *code_points(*utf8(_lower(texts))))
            best, top = total.argmax(1), total.max(1)
            mass = np.exp(total - top[:, None]).sum(1)
            best = np.array(names, object)[best]
            if not first:
                was, was_top, was_mass = piece.column("p_best").to_numpy(zero_copy_only=False), piece.column("p_top").to_numpy(), piece.column("p_mass").to_numpy()
                new = top > was_top
                most = np.maximum(top, was_top)
                mass = mass * np.exp(top - most) + was_mass * np.exp(was_top - most)
                best, top = np.where(new, best, was), most
            out = {c: piece.column(c) for c in piece.schema.names if not c.startswith("p_") and (c != "text" or keep_text or not last)}
            if last:
                none = np.fromiter((_no_letter(x.as_py()) for x in texts), bool, len(texts))
                best[none] = "und"
                out |= {"lang_pred": pa.array(best, pa.string()), "score": pa.array(np.where(none, 0.0, 1 / mass))}
            else:
                out |= {"p_best": pa.array(best, pa.string()), "p_top": pa.array(top), "p_mass": pa.array(mass)}
            yield pa.RecordBatch.from_pydict(out)

    return score


def predict(docs: DataFrame, max_train_docs: int = 20_000, keep_text: bool = False) -> DataFrame:
    """Columns of docs (without text unless keep_text), then held_out, lang_pred, score."""
    model = fit(docs, max_train_docs)
    rows, others = hide(docs, ["doc_id", "text"], ["held_out", "lang_pred", "score"])
    fields = rows.schema.fields
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    between = [T.StructField("p_best", T.StringType()), T.StructField("p_top", T.DoubleType()), T.StructField("p_mass", T.DoubleType())]
    if not model.langs:
        rows = rows.select(*[f.name for f in fields if f.name != "text" or keep_text], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rounds = Rounds(docs.sparkSession, "language-scores")
    for i, (names, block) in enumerate(model.blocks()):
        last = (i + 1) * LANGS >= len(model.langs)
        schema = T.StructType([*[f for f in fields if f.name != "text" or keep_text or not last], *(found if last else between)])
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_scorer(shared, names, i == 0, last, keep_text), schema)
        if not last:
            # The pass is run now, so that its block can go before the next one comes.
            rows = rounds.write(rows)
            rounds.forget()
            shared.destroy()
    return show(rows, ["doc_id", *["text"] * keep_text], others, [held_out().alias("held_out"), "lang_pred", "score"])
