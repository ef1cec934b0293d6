"""Language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams of 1 to 3 bytes (lower case, UTF-8). The kernel of two
texts is the number of shared n-grams over the root of the product of their numbers. A
Nyström map over a few landmark texts turns it into features, on which one ridge regression
per language is fitted. Scoring a batch is two matrix products.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.session import written

#: First code of the 1-, 2- and 3-byte n-grams.
STARTS = (0, 256, 256 + 65536)
#: Bytes whose n-grams are made at once.
BLOCK = 1 << 20
#: Texts scored at once.
BATCH = 128
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Every language has a landmark as long as there are no more languages than this.
MOST_LANDMARKS = 1024


class Grams:
    """The distinct n-grams of texts, as sorted codes; nothing is kept between texts."""

    def of(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "replace")
        found = []
        for start in range(0, max(len(data), 1), BLOCK):
            one = np.frombuffer(data[start:start + BLOCK + 2], dtype=np.uint8).astype(np.int32)
            two = (one[:-1] << 8) + one[1:]
            three = (two[:-1] << 8) + one[2:]
            found.append(np.unique(np.concatenate(
                [one + STARTS[0], two + STARTS[1], three + STARTS[2]])))
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def grams() -> Grams:
    return Grams()


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray       # -1 and the sorted n-grams of the landmarks
    presence: np.ndarray    # n-grams x landmarks, 0 or 1
    sizes: np.ndarray       # number of n-grams per landmark
    weights: np.ndarray     # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: list[str], batch: int = BATCH) -> np.ndarray:
        """Texts x landmarks; a text without n-grams has kernel 0 with all."""
        rows = []
        for start in range(0, len(texts), batch):
            part = texts[start:start + batch]
            features = np.zeros((len(part), len(self.codes)), dtype=np.float32)
            sizes = np.ones(len(part))
            for at, text in enumerate(part):
                own = grams().of(text)
                sizes[at] = max(len(own), 1)
                place = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
                features[at, place[self.codes[place] == own]] = 1
            rows.append((features @ self.presence) / np.sqrt(np.outer(sizes, self.sizes)))
        return np.concatenate(rows) if rows else np.zeros((0, len(self.sizes)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [at for at, text in enumerate(texts) if text is not None and LETTER.search(text)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            margins = self.kernel([texts[at] for at in known]) @ self.weights + self.bias
            best = margins.argmax(axis=1)
            scores[known] = np.clip((margins[np.arange(len(known)), best] + 1) / 2, 0, 1)
            for at, language in zip(known, best):
                names[at] = self.languages[language]
        return names, scores


def fit(rows: list[tuple[str, str]], landmarks: int, ridge: float) -> Model:
    """A model from (text, language) rows in a fixed order; no rows give a model without languages."""
    languages = sorted({language for _, language in rows})
    if not languages:
        return Model([], np.zeros(1, np.int32), np.zeros((1, 0), np.float32), np.zeros(0),
                     np.zeros((0, 0)), np.zeros(0))
    share = max(1, landmarks // len(languages))
    chosen = [text for language in languages
              for text in [t for t, own in rows if own == language][:share]][:max(landmarks, MOST_LANDMARKS)]
    own = [grams().of(text) for text in chosen]
    codes = np.concatenate([[-1], np.unique(np.concatenate(own))]).astype(np.int32)
    presence = np.zeros((len(codes), len(chosen)), dtype=np.float32)
    for at, found in enumerate(own):
        presence[np.searchsorted(codes, found), at] = 1
    model = Model(languages, codes, presence,
                  np.array([max(len(found), 1) for found in own], dtype=float),
                  np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    values, vectors = np.linalg.eigh(model.kernel(chosen))
    nystroem = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = model.kernel([text for text, _ in rows]) @ nystroem
    mean = features.mean(axis=0)
    targets = np.array([[1.0 if own == name else -1.0 for name in languages] for _, own in rows])
    # Each language weighs the same however many rows it has.
    counts = {name: sum(own == name for _, own in rows) for name in languages}
    weight = np.array([len(rows) / counts[own] / len(languages) for _, own in rows])[:, None]
    centred = features - mean
    middle = (targets * weight).sum(axis=0) / weight.sum()
    solved = np.linalg.solve(centred.T @ (centred * weight) + ridge * np.eye(len(mean)),
                             centred.T @ ((targets - middle) * weight))
    model.weights = nystroem @ solved
    model.bias = middle - mean @ solved
    return model


def drawn_rows(labelled: DataFrame, text: str, lang: str, key: str, rows_per_language: int,
               sample_bytes: int, long_text: int) -> DataFrame:
    """The training sample: lang, drawn (a hash of key and text), rank within the language.

    Only languages, sizes and hashes are handled; a language is thinned by its own count before
    it is ranked, so no task ranks more than about ``rows_per_language`` rows of one.
    """
    drawn = F.xxhash64(F.col(key).cast("string"), F.col(text))
    rows = written(labelled.where(F.col(lang).isNotNull() & (F.octet_length(F.col(text)) > 0)).select(
        F.col(lang).alias("lang"), drawn.alias("drawn"), F.octet_length(F.col(text)).alias("size"))
        .groupBy("lang", "drawn").agg(F.max("size").cast("long").alias("size")), "language-rows")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A margin, so that the rank below is what bounds a language.
    part = F.least(F.lit(1.0), (1.3 * rows_per_language + 30) / F.col("n"))
    # Written, so that its size is known and frequent languages are thinned before the shuffle.
    cuts = written(counts.select("lang", "n", (part * (1 << 30)).cast("long").alias("cut")), "language-cuts")
    order = Window.partitionBy("lang").orderBy(F.col("size") > long_text, "drawn")
    ranked = (rows.join(cuts, "lang").where(F.pmod("drawn", F.lit(1 << 30)) < F.col("cut"))
              .withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= rows_per_language))
    ranked = written(ranked, "language-sample")
    held, last = 0, 0
    for row in ranked.groupBy("rank").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy(
            "rank").collect():  # one row per rank
        held += row["bytes"]
        if held > sample_bytes:
            break
        last = row["rank"]
    if last:
        return ranked.where(F.col("rank") <= last).select("lang", "drawn", "rank")
    # Not even one row of each language fits: the most frequent ones.
    size = Window.orderBy(F.desc("n"), "lang").rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.where("rank = 1").withColumn("held", F.sum("size").over(size))
            .where(F.col("held") - F.col("size") < sample_bytes).select("lang", "drawn", "rank"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows_per_language: int = 400, sample_bytes: int = 64 << 20, long_text: int = 64 << 10,
          landmarks: int = 128, ridge: float = 1.0) -> Model:
    """Fit on a bounded sample: up to ``rows_per_language`` rows of every language, drawn by a hash
    of key and text, with up to ``sample_bytes`` of text in all.

    Whole texts of any length are drawn; those above ``long_text`` bytes after the shorter ones of
    their language. Languages take turns, so every language has its first row before one has its
    second; where the bytes run out, all stop at the same number of rows. Rows without text or
    language teach nothing, equal rows teach once. An empty table gives a model that knows no
    language and predicts ``und``.
    """
    sample = written(drawn_rows(labelled, text, lang, key, rows_per_language, sample_bytes, long_text),
                     "language-drawn")
    if sample.isEmpty():
        return fit([], landmarks, ridge)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"),
                           F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("drawn"))
    texts = rows.join(sample, ["lang", "drawn"]).dropDuplicates(["lang", "drawn"])
    found = sorted(texts.select("lang", "rank", "text").collect())  # at most sample_bytes
    return fit([(row["text"], row["lang"]) for row in found], landmarks, ridge)


def predict(documents: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``documents`` with the predicted language of the whole text, a score from 0 to 1, and
    ``has_letters``, which is false where there is nothing to tell a language from.

    Null texts and texts without a letter are ``und`` with score 0; equal texts get equal
    results; a tie goes to the language first in the alphabet. A text's n-grams are made block
    by block, so a very long text needs little more memory than itself.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by train's parameters

    @F.arrow_udf("struct<lang: string, score: double, letters: boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        known, names, scores, letters = shared.value, [], [], []
        for start in range(0, len(texts), BATCH):
            values = texts.slice(start, BATCH).to_pylist()
            own, margins = known.predict(values)
            names += own
            scores += margins.tolist()
            letters += [v is not None and LETTER.search(v) is not None for v in values]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
            ["lang", "score", "letters"])

    result = documents.withColumn("_language", predicted(F.col(text)))
    return result.withColumns({lang_pred: F.col("_language.lang"), score: F.col("_language.score"),
                               "has_letters": F.col("_language.letters")}).drop("_language")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept for testing: crc32 of its id's text leaves 1 when divided by 3."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             **bounds) -> DataFrame:
    """Train on the documents that are not held out and predict all of them."""
    learned = documents.where(F.col(doc_id).isNotNull() & ~held_out(doc_id))
    model = train(learned, text, lang, doc_id, **bounds)
    return predict(documents, model, text).withColumn("held_out", held_out(doc_id))
