"""Language identification by word-first backoff (operator 5).

Method. From labelled training rows the model keeps, for each language, how often each word and each character n-gram
occurs. A text is scored word by word: a known word adds its log frequency in each language; an unseen word is spelled
with boundary marks and scored by the longest known n-gram at each of its positions, from ``n_max`` characters down to
one. The language with the largest sum wins; ties go to the first in sorted order. The score is its posterior with a
flat prior, from 0 to 1.

Words are runs of letters, of any script (Unicode's category L). Training rows are a sample bounded by ``max_docs_per_lang``
documents a language, chosen by a hash of the id so that every run and partitioning takes the same ones; whole texts are
counted, on the executors, and only the counts of the sample reach the driver. Words and n-grams count from ``min_count``
occurrences in the sample on, 1 unless given. Prediction reads the text alone, whole, and shuffles nothing.

Defined results: a null text, or one without a letter, gives ``und`` and score 0; with no usable training row every
text does; a null id counts as not held out; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, table

#: Runs of letters, and of a few signs that regular expressions take for letters, as the superscript two.
RUN = r"[^\W\d_]+"
UNKNOWN = "und"


def letters_of(run: str) -> list[str]:
    """The words of a run: itself, as a rule."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    return [w for run in re.findall(RUN, text.lower()) for w in letters_of(run)]


def spelled(word: str, n_max: int) -> Iterator[str]:
    """All n-grams of a word with its boundary marks."""
    w = f"<{word}>"
    for i in range(len(w)):
        for n in range(1, min(n_max, len(w) - i) + 1):
            yield w[i : i + n]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, langs: list[str], words: dict, grams: dict, n_max: int) -> None:
        """words, grams: string -> counts in the order of langs."""
        import numpy as np

        self.langs, self.n_max = langs, n_max

        def logs(counts):
            """The strings' numbers, and a row of log frequencies for each."""
            m = np.array(list(counts.values()), float).reshape(len(counts), len(langs)) + 0.1
            return {x: i for i, x in enumerate(counts)}, np.log(m / m.sum(0)) if len(m) else m

        self.words, self.word_logs = logs(words)
        self.grams, self.gram_logs = logs(grams)

    def word(self, word: str):
        """A known word's log frequencies, or those of its pieces; None if nothing is known."""
        i = self.words.get(word)
        return self.backoff(word) if i is None else self.word_logs[i]

    def backoff(self, word: str):
        """The mean over a word's positions of the longest known n-gram's log frequencies, or None."""
        w, hits = f"<{word}>", []
        for i in range(len(w)):
            for n in range(min(self.n_max, len(w) - i), 0, -1):
                if (hit := self.grams.get(w[i : i + n])) is not None:
                    hits.append(hit)
                    break
        return self.gram_logs[hits].sum(0) / len(hits) if hits else None


def train(df: DataFrame, max_docs_per_lang: int = 800, n_max: int = 4, min_count: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows whose text and language are given. The caller leaves held-out rows away."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], {}, {}, n_max)
    # a share of the hash space that holds the wanted number of documents of each language
    top = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(min(1.0, max_docs_per_lang / n[x]) * (1 << 30)))) for x in langs])
    sample = rows.where((F.xxhash64("id").bitwiseAND((1 << 30) - 1)) < top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in tally.items():
            grams: Counter = Counter()
            for w, k in words.items():
                for g in spelled(w, n_max):
                    grams[g] += k
            for kind, c in (("w", words), ("g", grams)):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c)), pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["kind", "lang", "item", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "kind string, lang string, item string, n long").groupBy("kind", "item").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)])
    total = sum((F.col(f"c{i}") for i in range(len(langs))), F.lit(0))
    pdf = counts.where(total >= min_count).toPandas().sort_values(["kind", "item"])  # bounded by the sample
    cols = [f"c{i}" for i in range(len(langs))]
    by = {k: dict(zip(g["item"], g[cols].to_numpy().tolist())) for k, g in pdf.groupby("kind")}
    return Model(langs, by.get("w", {}), by.get("g", {}), n_max)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", table_limit: int = 150_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, and the columns in carry, which pass by unread."""
    sent = Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m, find = sent.value, re.compile(RUN).findall
        k = len(m.langs)

        class Rows(dict):
            """run -> row of its words' score vector in ``matrix``, filled as runs come; signs: runs without a letter"""

            def __init__(self) -> None:
                super().__init__()
                self.matrix, self.signs = np.zeros((1024, max(k, 1))), set()

            def __missing__(self, run):
                words = letters_of(run)
                vs = [v for v in map(m.word, words) if v is not None] if k else []
                i = self[run] = len(self)
                if i >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[i] = sum(vs)
                if not words:
                    self.signs.add(run)
                return i

        known = Rows()
        for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
            pred, score = [], []
            if len(known) > table_limit:
                known = Rows()
            for text in b.column(1).to_pylist():
                runs = find(text.lower()) if text else []
                idx = [known[x] for x in runs]
                if not k or known.signs.issuperset(runs):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                s = known.matrix[idx].sum(0)
                best = int(np.argmax(s))
                pred.append(m.langs[best])
                score.append(round(float(1 / np.exp(s - s[best]).sum()), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *b.columns[2:]], ["doc_id", "lang_pred", "score", *carry])

    own = "".join(f", `{c}` {k}" for c, k in df.dtypes if c in carry)
    order = [c for c in df.columns if c in carry]
    carry = tuple(order)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in order]).mapInArrow(run, "doc_id long, lang_pred string, score double" + own)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
