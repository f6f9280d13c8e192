"""Language identification: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.quality import fold
from folioscope.llm.words import SLICE, mix, powers
from folioscope.runtime import drop, small_batches, written

#: Documents of each language, and of all together, that a model is fitted on, about: those whose id hashes low. It holds every word and n-gram of them.
MAX_TRAINING_ROWS, MAX_ROWS_TOGETHER = 1500, 20_000
#: Longest n-gram for a word that isn't known.
ORDER = 4
#: Share of a text's letters that words of its language must make up, for the text to be in it.
LEAST_KNOWN = 0.2
#: From this code point on, scripts write words without spaces: their characters are looked up instead.
_UNSPACED = 0x0E00
_STEP = 0xD6E8FEB86659FD93
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _pieces(text: str) -> list[str]:
    """The lower-case text in pieces of about SLICE characters, cut at white space, so a longer word stays whole."""
    text = text.lower()
    if len(text) < SLICE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE - 1)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut <= at:  # the word goes on: up to the next white space
                cut = min((x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0), default=len(text) - 1)
            end = cut + 1
        out.append(text[at:end])
        at = end
    return out


class _Words:
    """Words of some pieces: their hashes, their characters and the piece that each belongs to."""

    def __init__(self, pieces: list[str]):
        codes = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _is_letter()[codes]
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.starts, ends = edge[::2], edge[1::2]
        self.sizes = ends - self.starts
        self.codes = mix(codes.astype(np.uint64) + np.uint64(1))
        up, down = powers(max(map(len, pieces), default=0) + 1)
        at = np.cumsum([0] + [len(x) + 1 for x in pieces])
        self.bounds = np.searchsorted(self.starts, at)
        if len(self.starts):
            # Offsets count from the piece's start, which keeps them below SLICE.
            origin = np.repeat(at[:-1], np.diff(at))
            local = self.starts - origin[self.starts]
            sums = np.add.reduceat(np.where(letter, self.codes, np.uint64(0)) * up[np.arange(len(codes)) - origin], self.starts)
            self.hashes = mix(mix(sums * down[local]) + self.sizes.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def grams(self, order: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, position in `which`) of the n-grams of the words numbered `which`."""
        counts = np.maximum(self.sizes[which] - order + 1, 0)
        owner = np.repeat(np.arange(len(which)), counts)
        at = self.starts[which][owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        total = np.full(len(at), order, np.uint64)
        for j in range(order):
            total = (total + self.codes[at + j]) * np.uint64(_STEP)
        return mix(total), owner


@dataclass
class Model:
    """languages; per kind (0: words, n: n-grams of n characters) sorted keys, log frequencies and whether the language has the entry, one column a language."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    seen: list[np.ndarray] = field(default_factory=list)

    def _known(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[kind]
        if len(keys) == 0:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def log_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' log frequencies per text and language, whether the text has a letter)."""
        pieces = [_pieces(x) for x in texts]
        out, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        flat = [(i, p) for i, own in enumerate(pieces) for p in own]
        at = 0
        while at < len(flat):
            end, size = at, 0
            while end < len(flat) and (end == at or size + len(flat[end][1]) < SLICE):
                size += len(flat[end][1])
                end += 1
            words = _Words([p for _, p in flat[at:end]])
            scores = np.zeros((len(words.starts) + 1, len(self.languages)))
            known, place = self._known(0, words.hashes)
            scores[1:][known] = self.logs[0][place[known]]
            left = np.flatnonzero(~known)
            for order in range(ORDER, 0, -1):
                if len(left) == 0:
                    break
                grams, owner = words.grams(order, left)
                seen, place = self._known(order, grams)
                counts = np.bincount(owner[seen], minlength=len(left))
                found = counts > 0
                for j in range(len(self.languages)):
                    sums = np.bincount(owner[seen], self.logs[order][place[seen], j].astype(np.float64), len(left))
                    scores[1 + left[found], j] = sums[found] / counts[found]
                left = left[~found]
            for k, (i, _) in enumerate(flat[at:end]):
                a, b = words.bounds[k], words.bounds[k + 1]
                out[i] += scores[1 + a : 1 + b].sum(axis=0)  # of the piece alone, whatever the batch
                has[i] |= b > a
            at = end
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Per text its language (`und` without a letter, or where nothing has been learnt) and that language's share of the likelihoods."""
        logs, has = self.log_scores(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if h else "und" for k, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


    def known_share(self, texts: list[str], langs: list[str]) -> np.ndarray:
        """Per text the share of its letters in words that were learnt in its language; unlike a likelihood, it doesn't grow with length."""
        number = {x: k for k, x in enumerate(self.languages)}
        out = np.zeros(len(texts))
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            letters = known = 0.0
            for piece in _pieces(text) if lang in number else []:
                words = _Words([piece])
                found, at = self._known(0, words.hashes)
                share = np.zeros(len(words.starts))
                share[found] = self.seen[0][at[found], number[lang]]
                codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
                which = np.flatnonzero((share == 0) & (codes[words.starts] >= _UNSPACED))
                if len(which):
                    grams, owner = words.grams(1, which)
                    found, at = self._known(1, grams)
                    hits = np.zeros(len(grams))
                    hits[found] = self.seen[1][at[found], number[lang]]
                    share[which] = np.bincount(owner, hits, len(which)) / words.sizes[which]
                letters += words.sizes.sum()
                known += float((share * words.sizes).sum())
            out[i] = known / letters if letters else 0.0
        return out


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn from the rows with a text and a language for which `usable` holds, about max_rows of each language.

    A row is taken if the hash of its id falls below its language's rate, so a language
    with most of the rows costs no more than another, and no row moves. Counts are summed
    per partition in numpy and then by Spark; all entries of these rows come to the driver, which max_rows and
    MAX_ROWS_TOGETHER bound. Repeated rows count each time; a null id hashes as the empty text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(usable)
    rows = rows.filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(x["lang"] for x in sizes)
    if not languages:
        return Model([], [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1))
    rate = F.create_map(*[y for x in sizes for y in (F.lit(x["lang"]), F.lit(min(1.0, min(max_rows, MAX_ROWS_TOGETHER / len(languages)) / x["count"])))])
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(number[lang], []).extend(_pieces(text))
            for lang, pieces in by.items():
                step = 64
                for k in range(0, len(pieces), step):
                    words = _Words(pieces[k : k + step])
                    every = np.arange(len(words.starts))
                    for kind in range(ORDER + 1):
                        keys, counts = np.unique(words.hashes if kind == 0 else words.grams(kind, every)[0], return_counts=True)
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "lang", "key", "n"])

    counts = rows.filter(drawn).select("lang", "text").mapInArrow(count, "kind int, lang int, key long, n long")
    by_key = counts.groupBy("kind", "key").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages))], F.sum("n").alias("total"))
    keys, logs, had = [], [], []
    table = written(by_key, "language-counts")
    sums = {x["kind"]: x for x in table.groupBy("kind").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]).collect()}
    for kind in range(ORDER + 1):
        top = table.filter(F.col("kind") == kind).drop("kind", "total").toPandas()
        key = top["key"].to_numpy(np.int64).view(np.uint64) if len(top) else np.zeros(0, np.uint64)
        order = np.argsort(key)
        n = top.drop(columns="key").to_numpy(np.float64).reshape(len(key), len(languages))[order]
        total = np.array([sums[kind][f"n{k}"] if kind in sums else 0 for k in range(len(languages))], np.float64)
        keys.append(key[order])
        had.append(n > 0)
        logs.append(np.log((n + 0.5) / (total + 0.5 * max(1, len(key)))).astype(np.float32))
    drop(table)
    return Model(languages, keys, logs, had)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; a null or letterless text is `und` with score 0.

    Ties go to the language that sorts first. Repeated and null ids stay rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # The words and n-grams of the training rows, whose number is bounded, whatever the input.
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows whose text is in a learnt language with a score of `least` or more, and with least_known of its letters in words of it; columns stay as they are.

    The score alone only tells the learnt languages apart: it goes to 1 with length, whatever the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            langs, scores = shared.value.predict(texts)
            yield batch.filter(pa.array((np.array(langs) != "und") & (scores >= least) & (shared.value.known_share(texts, langs) >= least_known)))

    return docs.mapInArrow(run, docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt outside the fourth that is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, fold(F.col("id"), 4) != 2)
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
