"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read, scratch
from resona.session import cut_lineage

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST_GRAM = 5
DOCS_PER_LANGUAGE = 800  # expected size of the training sample, by a hash of the id
MIN_WORD_COUNT = 2  # rarer words are left to their n-grams
SMOOTHING = 0.5
CACHED_WORDS = 100_000  # per task; a full cache is emptied
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word between spaces; single characters without the spaces."""
    padded = f" {word} " if size > 1 else word
    return [padded[i:i + size] for i in range(len(padded) - size + 1)]


def hashed(pieces: list[str], size: int) -> np.ndarray:
    """Hashes of n-grams, or of words for size 0; 64 bits, so two of them practically never share one."""
    return np.fromiter((xxhash.xxh64_intdigest(p, size) for p in pieces), np.uint64, len(pieces))


@dataclass
class Model:
    """Log frequencies by language. For each size (0: words) the sorted hashes of what was learned, and one row of
    scores for each of them."""

    languages: list[str]
    keys: list[np.ndarray]
    scores: list[np.ndarray]

    def known(self, pieces: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each piece was learned, and its row."""
        found, keys = hashed(pieces, size), self.keys[size]
        rows = np.searchsorted(keys, found)
        rows[rows == len(keys)] = 0
        return (keys[rows] == found if len(keys) else np.zeros(len(found), bool)), rows

    def vectors(self, words: list[str]) -> np.ndarray:
        """For each word the scores of the word itself, else the mean of its longest learned n-grams; zeros where
        nothing was learned."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        there, rows = self.known(words, 0)
        out[there] = self.scores[0][rows[there]]
        left = np.flatnonzero(~there)
        for size in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            pieces = [grams(words[i], size) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in pieces])
            there, rows = self.known([g for p in pieces for g in p], size)
            n = np.bincount(owner[there], minlength=len(left))
            total = np.zeros((len(left), len(self.languages)))
            np.add.at(total, owner[there], self.scores[size][rows[there]])
            out[left[n > 0]] = total[n > 0] / n[n > 0, None]
            left = left[n == 0]
        return out


class Predictor:
    """A model with the scores of the words met lately, as many as CACHED_WORDS and those of a batch."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.held = np.zeros((0, len(self.model.languages)), np.float32)

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Best language of each text and its probability over the learned ones; ties go to the first by name."""
        counts = [Counter(words(t)) for t in texts]
        if len(self.places) > CACHED_WORDS:
            self._forget()
        new = list(dict.fromkeys(w for c in counts for w in c if w not in self.places))
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        if new:
            self.held = np.concatenate([self.held, self.model.vectors(new)])
        return [self._best(c) for c in counts]

    def _best(self, counts: Counter) -> tuple[str, float]:
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        rows = np.fromiter(map(self.places.__getitem__, counts), np.int64, len(counts))
        total = np.fromiter(counts.values(), float, len(counts)) @ self.held[rows]
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def train(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit on the columns `key`, `text`, `lang` (rows without text or lang are left out).

    Counts come from a sample of about `per_language` documents of each language, so the model that the
    driver gathers and sends out is bounded; it has one log frequency per language for each word that
    occurs at least MIN_WORD_COUNT times and for every n-gram. Words and n-grams travel as hashes.
    """
    rows = labelled.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        none = LONGEST_GRAM + 1
        return Model([], [np.zeros(0, np.uint64)] * none, [np.zeros((0, 0), np.float32)] * none)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / sizes[k])])
    chance = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(chance < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                seen.setdefault(lang, Counter()).update(words(text))
            for lang, counts in seen.items():
                for size in range(LONGEST_GRAM + 1):
                    pieces, each = [], []
                    for word, n in counts.items():
                        own = grams(word, size) if size else [word]
                        pieces += own
                        each += [n] * len(own)
                    keys, place = np.unique(hashed(pieces, size), return_inverse=True)
                    yield pd.DataFrame({
                        "size": size, "key": keys.view(np.int64), "lang": lang,
                        "n": np.bincount(place, each, len(keys)).astype(np.int64),
                    })

    counted = sample.mapInPandas(count, "size int, key long, lang string, n long")
    summed = counted.groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    per_gram = cut_lineage(summed.groupBy("size", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n")
    ))
    kept = per_gram.filter((F.col("size") > 0) | (F.col("n") >= MIN_WORD_COUNT)).select(
        "size", "key", *[F.coalesce(F.col("by")[x], F.lit(0)).cast("int").alias(f"c{i}")
                         for i, x in enumerate(languages)]
    ).toArrow()
    sizes_of, hashes = kept["size"].to_numpy(), kept["key"].to_numpy().view(np.uint64)
    counts = np.stack([kept[f"c{i}"].to_numpy() for i in range(len(languages))], axis=1)
    keys, scores = [], []
    for size in range(LONGEST_GRAM + 1):
        own = np.flatnonzero(sizes_of == size)
        own = own[np.argsort(hashes[own])]
        smoothed = counts[own] + SMOOTHING
        keys.append(hashes[own])
        scores.append(np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32))
    return Model(languages, keys, scores)


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text. Null texts and texts without letters: `und`, 0. Letters of
    which nothing was learned get the first language by name with an even score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for batch in texts:
            yield pd.DataFrame(predictor.predict(batch), columns=["lang_pred", "score"])

    return run(text)


def held_out(key: Column) -> Column:
    """Documents that training never sees; a null id is trained on."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of `docs` without the held-out quarter."""
    bounded_batches(docs.sparkSession)
    return train(docs.filter(~held_out(col(doc_id))).select(
        col(doc_id).alias("key"), col(text).alias("text"), col(lang).alias("lang")))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the added columns held_out, lang_pred and score; columns of these names are replaced.

    Trained on `docs` without the held-out quarter. Rows come back one for one, repeated ones too; an
    empty table gives an empty result, one without any language `und` throughout. Very long texts count whole; other
    columns stay, whatever their names.
    """
    found = predicted(docs.sparkSession, fitted(docs, doc_id, text, lang), col(text))
    names = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    (both,) = scratch(docs, "found")
    marked = docs.withColumn(both, found)
    return marked.select(
        *map(col, names), held_out(col(doc_id)).alias("held_out"),
        col(both)["lang_pred"].alias("lang_pred"), col(both)["score"].alias("score"))


def with_known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` (with doc_id, text and lang) whose text is in a learned language with at least
    `least_score`; texts without letters go. An empty table gives an empty result; other columns stay, whatever
    their names."""
    (both,) = scratch(docs, "found")
    marked = docs.withColumn(both, predicted(docs.sparkSession, fitted(docs), F.col("text")))
    kept = (col(both)["lang_pred"] != UNKNOWN) & (col(both)["score"] >= least_score)
    return marked.filter(kept).select(*map(col, docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
