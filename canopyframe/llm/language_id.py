"""Language identification by word-first backoff.

A word known from training scores by its log frequency in each language.  An
unseen word falls back to its character n-grams, longest first: the first
length at which any n-gram is known scores it, by the mean over its known
n-grams.  A text scores by the sum over all its words; the posterior of the
best language, with equal priors, is its score.

Training takes, of each of the ``MAX_LANGS`` languages with the most labelled
documents, a sample of about ``docs_per_lang`` of these, chosen by a hash of the
id (never the held-out remainder), and keeps ``words_per_lang`` words and
``grams_per_lang`` n-grams of each length; these four parameters bound the model whatever the size of the corpus, so it may be
broadcast.  Prediction reads every whole text and nothing but the text.

Defined cases: null text, or text without a letter, is ``und`` with score 0,
as is every text when nothing was learned; ties go to the first language by
name; repeated rows are predicted alike; an empty table gives no rows; other
columns are carried by :func:`predict` (its own names must be free).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import free_name

DOCS_PER_LANG = 1500
WORDS_PER_LANG = 20_000
GRAMS_PER_LANG = 4_000
MAX_MODEL_ROWS = 1_000_000
MAX_LANGS = 400
#: Unseen words whose rows a task remembers.
KNOWN_UNSEEN = 200_000
GRAM_LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for the documents that are kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: lang, kind (0 for words, else n-gram length), token, count."""
    for batch in batches:
        counts: dict[tuple[str, int], Counter] = {}
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        words: dict[str, Counter] = {}
        for text, lang in zip(texts, langs):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in words.items():
            counts[lang, 0] = found
            for n in GRAM_LENGTHS:
                grams = counts[lang, n] = Counter()
                for word, times in found.items():
                    for gram in grams_of(word, n):
                        grams[gram] += times
        rows = [(lang, kind, token, times) for (lang, kind), c in counts.items() for token, times in c.items()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.record_batch(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
            ["lang", "kind", "token", "times"],
        )


@dataclass
class Model:
    """Languages, rows of known tokens, and a matrix of log frequencies (rows by languages)."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray

    def __post_init__(self) -> None:
        self.unseen: dict[str, list[int]] = {}

    def known_grams(self, word: str) -> list[int]:
        """Rows of the known n-grams of an unseen word, of the first length that has any."""
        found = self.unseen.get(word)
        if found is None:
            found = next((rows for n, table in self.grams.items() if (rows := [table[g] for g in grams_of(word, n) if g in table])), [])
            if len(self.unseen) >= KNOWN_UNSEEN:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def rows(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Rows to add and their weights."""
        index, weight, known = [], [], self.words
        for w, times in Counter(words).items():
            row = known.get(w)
            if row is not None:
                index.append(row)
                weight.append(times)
            elif found := self.known_grams(w):
                index += found
                weight += [times / len(found)] * len(found)
        return index, weight

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        index, weight = self.rows(words)
        total = np.asarray(weight) @ self.scores[index] if index else np.zeros(len(self.langs))
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def build_model(rows: list[tuple[str, int, str, int]]) -> Model:
    """Model from kept counts: (lang, kind, token, times)."""
    langs = sorted({r[0] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    totals: dict[tuple[int, str], float] = Counter()
    tokens: dict[int, dict[str, int]] = {k: {} for k in (0, *GRAM_LENGTHS)}
    size = 0
    for lang, kind, token, times in sorted(rows):
        totals[kind, lang] += times
        if token not in tokens[kind]:
            tokens[kind][token] = size
            size += 1
    counts = np.zeros((size, len(langs)))
    kinds = np.zeros(size, dtype=int)
    for lang, kind, token, times in rows:
        counts[tokens[kind][token], place[lang]] += times
        kinds[tokens[kind][token]] = kind
    scores = np.zeros_like(counts)
    for kind, table in tokens.items():
        mine = kinds == kind
        total = np.array([totals[kind, lang] for lang in langs], dtype=float)
        scores[mine] = np.log((counts[mine] + SMOOTHING) / (total + SMOOTHING * max(1, len(table))))
    return Model(langs, tokens[0], {n: tokens[n] for n in GRAM_LENGTHS}, scores)


def train(documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit the bounded model on labelled documents that are not held out."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # one row per language: how many labelled documents it has
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    held = {r["lang"]: r["n"] for r in counted.limit(MAX_LANGS).collect()}
    if not held:
        return build_model([])
    # a language that is not learned has no share, and is left out by the comparison
    share = F.try_element_at(F.create_map(*(F.lit(x) for lang, n in sorted(held.items()) for x in (lang, min(1.0, docs_per_lang / n)))), F.col("lang"))
    luck = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(luck < share).select("lang", "text")
    counts = sample.mapInArrow(_count_tokens, "lang string, kind int, token string, times long").groupBy("lang", "kind", "token").agg(F.sum("times").alias("times"))
    shrink = min(1.0, MAX_MODEL_ROWS / (len(held) * (WORDS_PER_LANG + GRAMS_PER_LANG * len(GRAM_LENGTHS))))
    keep = F.when(F.col("kind") == 0, int(WORDS_PER_LANG * shrink)).otherwise(int(GRAMS_PER_LANG * shrink))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("times"), "token")))
    return build_model([tuple(r) for r in ranked.where(F.col("rank") <= keep).select("lang", "kind", "token", "times").collect()])


def predict(documents: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with two more columns, predicted from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            at = batch.schema.names.index("text")
            found = [fitted.predict(t.as_py()) for t in batch.column(at)]
            yield pa.record_batch(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, pred, score],
            )

    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, held_out, lang_pred, score."""
    model = train(documents)
    texts = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with a posterior of at least ``least``."""
    pred, score = free_name(documents, "lang_pred"), free_name(documents, "lang_score")
    found = predict(documents, train(documents), pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)
