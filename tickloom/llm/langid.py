"""Language identification by word-first backoff.

A known word gives the log frequencies it has in each language. A word that no language knows is judged by its
character n-grams (word ends marked): by those of four characters if any is known, else of three, two, one. The
vectors of all words of a text are added to the log shares of the languages; the score is the softmax of the best.

Word and n-gram counts are gathered from a bounded sample of labelled documents: about ``sample_rows`` rows and
``sample_chars`` characters at most. All their words and n-grams are kept, so the sample alone bounds the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import packed
from tickloom.session import materialized

SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 60_000_000
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words whose vector a Python worker remembers, and texts that are handled at a time.
REMEMBERED = 300_000
STEP = 256


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, length: int) -> list[str]:
    marked = f"^{word}$" if length > 1 else word
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n); the documents of a language count under the empty word."""
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found[lang, ""] += 1
            for word, n in Counter(words(text.as_py())).items():
                found[lang, word] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for length in LENGTHS:
                for gram in grams(word, length):
                    found[lang, gram, length] += n
        keys = list(found)
        cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(found.values()), pa.int64())], ["lang", "gram", "length", "n"])


class Entries:
    """Words or n-grams and their log frequencies, a row per entry and a column per language.

    The driver only keeps and sends the arrays; the lookup is built where it is used.
    """

    def __init__(self, table: pa.Table, langs: list[str]):
        """table: (lang, entry, n), each language and entry once."""
        coded = table["entry"].combine_chunks().dictionary_encode()
        self.names = coded.dictionary
        place = pc.index_in(table["lang"].combine_chunks(), pa.array(langs, pa.string()))
        logs = np.zeros((len(self.names), len(langs)))
        logs[coded.indices.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)] = table["n"].to_numpy()
        sums = logs.sum(0) + 0.5 * (len(self.names) + 1)
        logs += 0.5
        logs /= sums
        self.logs = np.log(logs, out=logs)
        self.unseen = np.log(0.5 / sums)
        self.rows: dict[str, int] | None = None

    def __len__(self) -> int:
        return len(self.names)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def get(self, entry: str) -> int | None:
        if self.rows is None:
            self.rows = {name: i for i, name in enumerate(self)}
        return self.rows.get(entry)


class Backoff:
    """The model: shares of the languages, Entries of the words and of the n-grams of each length."""

    def __init__(self, docs: dict[str, int], words_of: pa.Table, grams_of: dict[int, pa.Table]):
        self.langs = sorted(docs)
        total = sum(docs.values())
        self.prior = np.array([np.log(docs[x] / total) for x in self.langs])
        self.words = Entries(words_of, self.langs)
        self.grams = {length: Entries(grams_of[length], self.langs) for length in LENGTHS}
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.langs)))

    def word_vector(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is not None:
            return self.words.logs[row]
        for length in LENGTHS:
            found = [self.grams[length].get(g) for g in grams(word, length)]
            known = [x for x in found if x is not None]
            if known:
                missing = len(found) - len(known)
                return (self.grams[length].logs[known].sum(0) + missing * self.grams[length].unseen) / len(found)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words(t) if t else [] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        for word in sorted(set().union(*found).difference(self.rows)):
            row = self.rows[word] = len(self.rows)
            if row >= len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.logs[row] = self.word_vector(word)
        out, row_of = [], self.rows.__getitem__
        for own in found:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            logs = self.prior + self.logs[np.fromiter(map(row_of, own), np.int64, len(own))].sum(0)
            best = int(np.argmax(logs))
            out.append((self.langs[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Backoff:
    """The model of the labelled documents that are not held out; a hash of id and text picks a sample of about so many rows and characters."""
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n, chars = labelled.agg(F.count("*"), F.sum(F.length("text").cast("long"))).first()
    share = min(sample_rows / max(n, 1), sample_chars / max(chars or 0, 1))
    if share < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * share))
    counts = labelled.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialized(counts, "words")
    real = counts.filter("word <> ''")
    grams_of = materialized(real.mapInArrow(_gram_counts, "lang string, gram string, length int, n long").groupBy("lang", "gram", "length").agg(F.sum("n").alias("n")), "grams")
    docs_of = {r["lang"]: r["n"] for r in counts.filter("word = ''").collect()}
    # straight into arrays: rows as Python objects would take many times the memory
    grams_by = {size: grams_of.filter(F.col("length") == size).select("lang", F.col("gram").alias("entry"), "n").toArrow() for size in LENGTHS}
    return Backoff(docs_of, real.select("lang", F.col("word").alias("entry"), "n").toArrow(), grams_by)


def predictor(docs: DataFrame, model: Backoff):
    """A column function text -> struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            found = [x for at in range(0, len(array), STEP) for x in shared.value.predict(array[at : at + STEP].to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # else a filter on the prediction makes Spark work it out a second time
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()


def identify(docs: DataFrame, model: Backoff | None = None, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. The model is fitted on the table itself if none is given.

    * null text, or text without a letter: ``und`` with score 0; so is every text if there is nothing to learn from.
    * equal scores: the language that sorts first. Letters never seen: the commonest language.
    * null ids pass through and are learned from; repeated rows give repeated rows; an empty table gives an empty result.
    * ``lang``, ``source`` and the id are no inputs of a prediction; other columns are not looked at.
    """
    predict = predictor(docs, model or fit(docs, **bounds))
    found = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text")).alias("_found"))
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; a null label is filled with the prediction."""
    predict = predictor(docs, fit(docs))
    found = docs.select(packed(docs), predict(F.col("text")).alias("found")).filter(F.col("found.lang_pred") != UNKNOWN)
    return found.select(*[F.coalesce("row.lang", "found.lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])
