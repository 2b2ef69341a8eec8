"""Language identification with string kernels.

A text is the set of its character 1-, 2- and 3-grams (blended spectrum, presence
only); two texts are as alike as their sets overlap, cosine-normalised.  The
Nyström method replaces the kernel by its values against a few landmark texts, and
one-versus-rest kernel ridge regression on those gives a score for each language.
Scoring is a map: the presence rows of a batch of texts times the landmarks'
presence matrix, normalised, times the ridge coefficients.

Fitting takes a bounded sample of the distinct labelled texts: of every language those with the
least hashes, SAMPLE_PER_CLASS at most, fewer for each where there are more than CLASSES languages.
Texts are whole; those of more than SAMPLE_TEXT characters come after all others of their language,
as far as SAMPLE_PER_CLASS * SAMPLE_TEXT characters go.  No language is left without a text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_CLASS, SAMPLE_TEXT, CLASSES = 300, 20_000, 64
LANDMARKS_PER_CLASS = 16
#: Cells of the presence rows of texts that are multiplied at once.
BATCH_CELLS = 1 << 22
SALTS = 32
RIDGE = 1e-3
UNKNOWN = "und"

#: What is no letter, mark or digit is one boundary; all digits are one symbol.
_BOUNDARY, _DIGIT = 0, ord("0")
_BITS = 21
_table: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """The symbol of every code point: letters and marks stand for themselves."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            table[c] = c
        elif ch.isdigit():
            table[c] = _DIGIT
    return table


def gram_set(text: str) -> np.ndarray:
    """The distinct 1-, 2- and 3-grams of a text's symbols, sorted; a gram is its code points side by side, so none is taken for another."""
    if not _table:
        _table.append(_symbol_table())
    s = _table[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)
    if not len(s):
        return s
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _BOUNDARY) | (s[:-1] != _BOUNDARY)
    edge = np.zeros(1, np.uint64)
    s = np.concatenate([edge, s[keep], edge])
    # single symbols are told from longer grams by what no symbol has in the places before them
    one = s | np.uint64((1 << 2 * _BITS) - 1 << _BITS)
    two = s[:-1] << np.uint64(_BITS) | s[1:] | np.uint64((1 << _BITS) - 1 << 2 * _BITS)
    three = s[:-2] << np.uint64(2 * _BITS) | s[1:-1] << np.uint64(_BITS) | s[2:]
    return np.unique(np.concatenate([np.unique(one), two, three]))


class KernelModel:
    """classes, landmark grams (codes), presence of each in each landmark, landmark sizes, coefficients."""

    def __init__(self, classes, codes, present, sizes, weights):
        self.classes, self.codes, self.present, self.sizes, self.weights = classes, codes, present, sizes, weights
        self._factor: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_factor": None}

    def factor(self) -> np.ndarray:
        """The landmarks' presence as a matrix of numbers, made where it is used: sent are single bytes."""
        if self._factor is None:
            self._factor = self.present.astype(np.float32)
        return self._factor

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], per_class: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE) -> KernelModel:
        """texts come in the order of their drawing; the longest-known few of each class become landmarks."""
        classes = sorted(set(labels))
        chosen: list[int] = []
        for c in classes:
            own = [i for i, x in enumerate(labels) if x == c]
            middle = sorted(own, key=lambda i: (-len(texts[i]), i))[len(own) // 4 :][:per_class] or own[:per_class]
            chosen += middle
        sets = [gram_set(texts[i]) for i in chosen]
        codes = np.unique(np.concatenate(sets))
        present = np.zeros((len(codes), len(chosen)), np.uint8)
        for k, own in enumerate(sets):
            present[np.searchsorted(codes, own), k] = 1
        sizes = np.array([max(1, len(own)) for own in sets], float)
        model = cls(classes, codes, present, sizes, np.zeros((len(chosen), len(classes)), np.float32))
        kernel = model.kernel(texts)
        own = kernel[chosen]
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ root
        target = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
        # each class weighs the same, however often it was drawn
        weight = np.array([1.0 / labels.count(x) for x in classes])[np.searchsorted(classes, labels)]
        gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        model.weights = (root @ np.linalg.solve(gram, features.T @ (target * weight[:, None]))).astype(np.float32)
        return model

    def kernel(self, texts: list[str], batch: int = 256) -> np.ndarray:
        out = np.zeros((len(texts), self.present.shape[1]))
        batch = max(1, min(batch, BATCH_CELLS // max(1, len(self.codes))))
        rows = np.zeros((min(batch, max(1, len(texts))), len(self.codes)), np.float32)
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            size = np.ones(len(part))
            rows[:] = 0
            for i, text in enumerate(part):
                own = gram_set(text)
                size[i] = max(1, len(own))
                place = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
                rows[i, place[self.codes[place] == own]] = 1
            out[at : at + len(part)] = (rows[: len(part)] @ self.factor()) / np.sqrt(size[:, None] * self.sizes[None, :])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.classes or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = self.kernel(texts) @ self.weights
        best = scores.argmax(axis=1)
        return [self.classes[b] for b in best], np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0.0, 1.0)


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_class: int = SAMPLE_PER_CLASS) -> KernelModel:
    """A model of every labelled language, from a bounded sample of distinct texts; rows without a language or a letter are passed over."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.max(F.char_length("text")).alias("n"))
    first = [F.col("n") > SAMPLE_TEXT, F.col("h")]
    # the first of each salt, then the first of all, so that a frequent language is no burden to one task
    of_salt = distinct.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy(*first))).filter(F.col("at") <= per_class)
    own = Window.partitionBy("lang").orderBy(*first)
    order = of_salt.withColumns({"at": F.row_number().over(own), "chars": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))}).filter((F.col("at") <= per_class) & ((F.col("at") == 1) | (F.col("chars") <= per_class * SAMPLE_TEXT)))
    keys = order.select("lang", "h", "at").collect()  # per_class for each language at most
    classes = len({r["lang"] for r in keys})
    if not classes:
        return KernelModel([], np.zeros(0, np.uint64), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0), np.float32))
    most, landmarks = (max(1, min(each, CLASSES * each // classes)) for each in (per_class, LANDMARKS_PER_CLASS))
    wanted = labelled.sparkSession.createDataFrame([(r["lang"], r["h"], r["at"]) for r in keys if r["at"] <= most], "lang string, h long, at int")
    drawn = rows.join(F.broadcast(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()
    drawn.sort(key=lambda r: (r["lang"], r["at"]))
    return KernelModel.fit([r["text"] for r in drawn], [r["lang"] for r in drawn], landmarks)


def predict_languages(docs: DataFrame, model: KernelModel, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of docs, then lang_pred and score.

    Null, empty and letterless texts are `und` with score 0, as is everything where the
    model has no language.  Texts are read whole; nothing but the text is used.
    """
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                found, values = model.predict([texts[i] for i in usable])
                for i, lang, value in zip(usable, found, values, strict=True):
                    langs[i], scores[i] = lang, value
                yield pa.RecordBatch.from_arrays([*(part.column(f"c{i}") for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores)], [*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    out = rows.mapInArrow(run, (schema + ", " if schema else "") + "lang_pred string, score double")
    return out.toDF(*keep, "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, then kept columns.

    A row is held out of the fit if crc32 of its id as text, modulo folds, is held_out; a null id is not.
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    model = fit_languages(rows.filter("not held_out"), "t", "l")
    out = predict_languages(rows, model, "t", ("doc_id", "held_out", *(f"k{i}" for i in range(len(keep)))))
    return out.select("doc_id", "held_out", "lang_pred", "score", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))
