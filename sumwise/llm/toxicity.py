"""Toxicity of documents: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: how dense and how strong the terms of a learned lexicon are, how many of
them stand within NEAR words of the second person, capitals, punctuation, and how often words
are obfuscated (signs or digits between letters) or hide a lexicon term that way.

The lexicon is learned too: words and word beginnings of STEMS letters with the log odds of
standing in a toxic document.  Labelled rows fall into FOLDS folds.  The features of a fold use a
lexicon learned without it; one model per fold is trained without it, and its probabilities for
the fold calibrate the mean of all models.  So nothing is calibrated on what it was fitted to.

Fitting takes at most MOST_ROWS labelled rows, those with the smallest hash of their id, and
its lexicon is bounded by them; scoring reads every whole text.  Scores are made row by row:
no shuffle, and a lost task is simply run again.

Edge cases: a null or empty text has the features of no words and is scored like any other.
Labels that are null, or whose id is null or has no document, teach nothing; a document with
several labels counts as toxic if one says so.  Without labels of both kinds all scores are
0.0.  Rows with a null id are scored and not held out, repeated rows are scored each, an empty
table gives an empty result.  Columns of the input that are not kept are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import stored
from sumwise.llm.common import slices, smallest

MOST_ROWS = 20_000
FOLDS = 3
STEMS = (4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 2
WEAK, STRONG, SURE = 1.5, 3.0, 5.0
NEAR = 4
LIMIT = 0.7
TREES, DEPTH = 12, 3
MOST_WORDS = 400_000  # words a worker remembers; a cache
BATCH_BYTES = 1 << 20

SECOND_PERSON = frozenset(
    """you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre
    vos usted ustedes ti tuyo tuya vosotros""".split()
)
#: Signs that are read as letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
OUTER = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
FEATURES = (
    "words strong_density weak_density strong_hits sure_hits distinct_strong weight_density largest_weight near_second_person capitals capital_words "
    "punctuation exclamations obfuscated hidden_hits digits"
).split()


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, as the lexicon names them."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


class Reader:
    """Turns texts into features with one lexicon (term to log odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, int]] = {}
        self.kinds = np.zeros(0x110000, np.uint8)  # 1 upper case, 2 lower case or other letter, 3 digit, 4 sign
        for code in range(0x3000):
            c = chr(code)
            self.kinds[code] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 0 if c.isspace() else 4
        self.kinds[0x3000:] = 2

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def word(self, raw: str) -> tuple[float, int]:
        """Weight, and flags: 1 second person, 2 obfuscated, 4 hides a term."""
        bare = OUTER.sub("", raw)
        weight, flags = self.weight(bare), int(bare in SECOND_PERSON)
        if INNER.search(raw):
            flags |= 2
            plain = re.sub(r"[\W\d_]+", "", raw.translate(LOOKALIKES))
            hidden = max(self.weight(plain), self.weight(re.sub(r"[\W\d_]+", "", raw)))
            if hidden >= STRONG > weight:
                weight, flags = hidden, flags | 4
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        self.known[raw] = found = (weight, flags)
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        raw = text.split()
        words = text.lower().split()
        if not words:
            return [0.0] * len(FEATURES)
        get, make = self.known.get, self.word
        found = [get(w) or make(w) for w in words]
        weights = np.array([f[0] for f in found])
        flags = np.array([f[1] for f in found])
        strong = weights >= STRONG
        n = len(words)
        near = 0
        if strong.any() and (flags & 1).any():
            sums = np.concatenate([[0], np.cumsum(flags & 1)])
            at = np.flatnonzero(strong)
            near = int((sums[np.minimum(at + NEAR + 1, n)] - sums[np.maximum(at - NEAR, 0)] > 0).sum())
        kinds = np.bincount(self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
        letters = max(1, int(kinds[1] + kinds[2]))
        return [
            math.log1p(n),
            float(strong.mean()),
            float((weights >= WEAK).mean()),
            math.log1p(int(strong.sum())),
            math.log1p(int((weights >= SURE).sum())),
            math.log1p(len({w for w, s in zip(words, strong.tolist()) if s}) if strong.any() else 0),
            float(weights.mean()),
            float(weights.max()),
            near / n,
            float(kinds[1]) / letters,
            sum(map(str.isupper, raw)) / n,
            float(kinds[4]) / len(text),
            text.count("!") / len(text),
            float((flags & 2 > 0).mean()),
            float((flags & 4 > 0).mean()),
            float(kinds[3]) / len(text),
        ]


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(text, toxic, fold) of at most MOST_ROWS rows that may be learned from, a table in the shared folder."""
    said = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("toxic")).where("id is not null and toxic is not null")
    said = said.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = smallest(said, F.xxhash64("id"), MOST_ROWS)  # so the broadcast below is bounded
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    return stored(texts.join(F.broadcast(chosen), "id").select("text", "toxic", fold))


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """One lexicon without each fold, and one of all folds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            counts: dict[tuple[str, int], list[int]] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                words = {OUTER.sub("", w) for w in (text or "").lower().split()}
                for term in {t for w in words for t in terms_of(w)}:
                    counts.setdefault((term, fold), [0, 0])[toxic > 0] += 1
            keys = list(counts)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [c[1] for c in counts.values()], [c[0] for c in counts.values()]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "fold", "toxic", "clean"])

    sums = [F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}") for c in ("toxic", "clean") for f in range(FOLDS)]
    counts = rows.mapInArrow(counted, "term string, fold int, toxic long, clean long").groupBy("term").agg(*sums).fillna(0)
    totals = {(r.fold, r.toxic > 0): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    all_toxic = sum(F.col(f"toxic{f}") for f in range(FOLDS))
    # The rest cannot reach WEAK: at equal rates the odds are even.
    rate = sum(n for (_, t), n in totals.items() if t) / max(1, sum(totals.values()))
    likely = counts.where((all_toxic >= LEAST_DOCUMENTS) & (all_toxic > rate * sum(F.col(f"{c}{f}") for c in ("toxic", "clean") for f in range(FOLDS))))
    found: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for r in likely.toLocalIterator():
        for without in range(FOLDS + 1):
            folds = [f for f in range(FOLDS) if f != without]
            toxic, clean = (sum(r[f"{c}{f}"] for f in folds) for c in ("toxic", "clean"))
            n_toxic, n_clean = (sum(totals.get((f, t), 0) for f in folds) for t in (True, False))
            weight = odds(toxic, clean, n_toxic, n_clean)
            if toxic >= LEAST_DOCUMENTS and weight >= WEAK:
                found[without][r.term] = weight
    return found


class ToxicityModel:
    """Fitted on labelled rows; scores any rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic"):
        rows = labelled(docs, labels, id, text, label)
        self.models, self.lexicon = [], {}
        if rows.agg(F.count_distinct("toxic")).first()[0] < 2:
            return
        readers = lexicons(rows)
        self.lexicon = readers[FOLDS]
        shared = rows.sparkSession.sparkContext.broadcast(readers)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Reader] = {}
            for batch in slices(batches, "text", BATCH_BYTES):
                folds = batch.column("fold").to_pylist()
                for fold in set(folds) - set(made):
                    made[fold] = Reader(shared.value[fold])
                values = [made[f].features(t) for f, t in zip(folds, batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), batch.column("fold"), pa.array(values, pa.list_(pa.float64()))], names=["toxic", "fold", "features"]
                )

        known = stored(rows.mapInArrow(read, "toxic double, fold int, features array<double>"))
        known = known.withColumn("vector", array_to_vector("features"))
        calibrating = None
        for fold in range(FOLDS):
            rest = known.where(F.col("fold") != fold)
            if rest.agg(F.count_distinct("toxic")).first()[0] < 2:
                continue
            trees = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1)
            self.models.append(trees.fit(rest))
            part = self.models[-1].transform(known.where(F.col("fold") == fold))
            part = part.select("toxic", vector_to_array("probability")[1].alias("mean"))
            calibrating = part if calibrating is None else calibrating.union(part)
        if self.models:
            self.calibration = IsotonicRegression(featuresCol="mean", labelCol="toxic", predictionCol="level").fit(stored(calibrating))

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """All columns of `docs` and the score, from 0 to 1.

        The calibrated value moves in steps; a thousandth of the mean keeps the order within them.
        """
        if not self.models:
            return docs.withColumn(score, F.lit(0.0))
        shared = docs.sparkSession.sparkContext.broadcast(self.lexicon)
        names = docs.columns
        plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
        where = f"c{names.index(text)}"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in slices(batches, where, BATCH_BYTES):
                values = [reader.features(t) for t in batch.column(where).to_pylist()]
                yield batch.append_column("features", pa.array(values, pa.list_(pa.float64())))

        schema = T.StructType([*plain.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
        rows = plain.mapInArrow(read, schema).withColumn("vector", array_to_vector("features"))
        means = []
        for i, model in enumerate(self.models):
            model = model.copy().setProbabilityCol(f"odds{i}").setPredictionCol(f"said{i}").setRawPredictionCol(f"raw{i}")
            rows = model.transform(rows)
            means.append(vector_to_array(f"odds{i}")[1])
        rows = self.calibration.transform(rows.withColumn("mean", sum(means) / len(means)))
        return rows.select(
            *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], (0.999 * F.col("level") + 0.001 * F.col("mean")).alias(score)
        )


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """`id`, held_out, score and predicted (1 from LIMIT on) of every row of `docs`."""
    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    scored = ToxicityModel(docs, labels, id, text, label).score(rows, "text")
    return scored.select(id, held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return ToxicityModel(docs, labels, id, text, label).score(docs, text, name).where(F.col(name) < LIMIT).drop(name)
