"""Language identification by words first, then by ever shorter character n-grams.

The model is a table of words and one of character n-grams, each with the log
of its frequency in every language. Both are counted over all labelled texts;
the most frequent entries stay (``WORDS`` and ``GRAMS``, ties by code points), so the model has a fixed
bound whatever the corpus.

A word of a text that the model knows scores with its log frequencies. Any other
word is taken apart: its n-grams of five characters (with marks at both ends of the word)
score where the model knows one of them at least, otherwise those of four, and so
on to single characters; a word that no n-gram matches says nothing. An
n-gram's score is the mean over those that matched.

A word is a run of letters, in lower case. The prediction is the language with
the highest mean score of the words, ties to the least name by code points. ``score`` is its share
when the languages' mean scores are read as log probabilities, between 0 and 1.

A text that is null or without a letter is ``und`` with score 0, and so is every
text if nothing is labelled. Null labels and null texts teach nothing. Texts that are not valid UTF-8 are
read with replacement characters. Rows that repeat count each, and each has its
prediction. A text is read whole, in some twenty times its size of memory in one task. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import slices
from tidewater.session import staged

#: Entries of the model, and the longest n-gram.
WORDS, GRAMS, LONGEST = 100_000, 100_000, 5
#: Added to every count before its log is taken.
SMOOTH = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Distinct words whose scores a worker keeps (results are the same at any size).
KEPT = 1_000_000


def words_of(text: bytes | None) -> list[str]:
    return LETTERS.findall(text.decode("utf-8", "replace").lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The character n-grams of a word between marks."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over the rows with a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                counts: dict[str, Counter] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    counts.setdefault(lang, Counter()).update(words_of(text))
                for lang, c in counts.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                                                     names=["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of the counted words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                mine = counts.setdefault(lang, {})
                for k in range(1, LONGEST + 1):
                    for g in grams(word, k):
                        mine[g] = mine.get(g, 0) + n
            for lang, mine in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.string()), pa.array(list(mine.values()), pa.int64())],
                                                 names=["lang", "gram", "n"])

    return words.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, key: str, limit: int) -> list:
    """(key, lang, n) of the ``limit`` most frequent keys; languages are few."""
    total = counts.groupBy(key).agg(F.sum("n").alias("all"))
    return counts.join(total.orderBy(F.desc("all"), key).limit(limit).select(key), key).select(key, "lang", "n").collect()


class Model:
    """Log frequencies of words and n-grams, at most ``WORDS`` + ``GRAMS`` rows of a number for each language."""

    def __init__(self, langs: list[str], word_n: dict[str, int], words: list, gram_n: dict[tuple[str, int], int], gram_rows: list):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        word_place, self.word_logs = _logs(words, place, np.array([word_n[lang] for lang in langs], float))
        # for each length, the places of the n-grams, and their logs with a row of zeros at the end
        self.grams = {n: _logs([r for r in gram_rows if len(r[0]) == n], place, np.array([gram_n.get((lang, n), 0) for lang in langs], float))
                      for n in range(1, LONGEST + 1)}
        # the table of scores: the words of the model, then others that were met; the last column tells whether a word says something
        self.known = word_place
        self.place = dict(word_place)
        self.scores = np.column_stack([self.word_logs[:-1], np.ones(len(word_place))])

    def apart(self, words: list[str]) -> np.ndarray:
        """The scores of words that the model does not know, by their n-grams, longest first."""
        out, left = np.zeros((len(words), len(self.langs) + 1)), np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            get, logs = self.grams[n][0].get, self.grams[n][1]
            cut = [grams(words[i], n) for i in left.tolist()]
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            found = np.fromiter((get(g, -1) for g in chain.from_iterable(cut)), np.int64, int(size.sum()))
            word = np.repeat(np.arange(len(left)), size)[found >= 0]
            found = found[found >= 0]
            times = np.bincount(word, minlength=len(left))
            hit = times > 0
            for k in range(len(self.langs)):
                out[left[hit], k] = np.bincount(word, logs[found, k], len(left))[hit] / times[hit]
            out[left[hit], -1] = 1
            left = left[~hit]
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """The rows of ``scores`` of these words; new words are added."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) - len(self.known) + len(new) > KEPT:
            self.place = dict(self.known)
            self.scores = self.scores[:len(self.known)]
            new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate([self.scores, self.apart(new)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Predictions and scores of texts given as words."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at, text = self.places(list(chain.from_iterable(texts))), np.repeat(np.arange(len(texts)), size)
        *sums, n = (np.bincount(text, self.scores[at, k], len(texts)) for k in range(len(self.langs) + 1))
        mean = np.stack(sums, 1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)  # the first of equal ones; languages are sorted
        share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), size.tolist())], np.where(size > 0, share, 0.0)


def _logs(rows: list, place: dict[str, int], total: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """The place of each key, and the logs of their frequencies, with a row of zeros at the end."""
    keys: dict[str, int] = {}
    at = np.fromiter((keys.setdefault(key, len(keys)) for key, _, _ in rows), np.int64, len(rows))
    counts = np.zeros((len(keys), len(place)))
    counts[at, [place[lang] for _, lang, _ in rows]] = [n for _, _, n in rows]
    logs = np.log(counts + SMOOTH) - np.log(total + SMOOTH * max(len(keys), 1))
    return keys, np.concatenate([logs, np.zeros((1, len(place)))])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows with a language. Languages are as many as the labels have."""
    words = staged(word_counts(docs, lang_col, text_col), "words")
    found = staged(gram_counts(words), "grams")
    word_n = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    length = F.length("gram")
    gram_n = {(r[0], r[1]): r[2] for r in found.groupBy("lang", length).agg(F.sum("n")).collect()}
    chosen = [r for n in range(1, LONGEST + 1) for r in _top(found.where(length == n), "gram", GRAMS // LONGEST)]
    return Model(sorted(word_n), word_n, _top(words, "word", WORDS), gram_n, chosen)


def predict(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for part in slices(whole, "text"):
                found, score = m.score(list(map(words_of, part.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out (CRC-32 of the id as text, modulo 4, is not 2; a null id
    is not held out), and predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    return predict(docs, docs.sparkSession.sparkContext.broadcast(model), id_col, text_col)
