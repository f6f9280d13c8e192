"""Byte-pair encoding by a backtracking encoder over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.chunks import WORDS, PieceEncoder, vocabulary_path
from folioscope.runtime import small_batches

#: Pairs that the compatibility table may hold; a full table starts afresh.
PAIRS = 1_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself if printable Latin-1, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class _Compatible(dict):
    """(left, right) tokens -> whether they stay side by side when their text is merged; filled when asked."""

    def __init__(self, merged: dict[tuple[int, int], int], parts: list[tuple[int, int]]):
        super().__init__()
        self.merged, self.parts = merged, parts

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) > PAIRS:
            self.clear()
        self[pair] = answer = self._stays(*pair)
        return answer

    def _stays(self, left: int, right: int) -> bool:
        # Tokens are numbered by merge order. Going back through the merges, latest first, no merge
        # across the border may have come before the one that is undone.
        bound = len(self.parts) + 1
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, left = left, self.parts[left][1]
                if left == bound:
                    bound, right = right + 1, self.parts[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.parts[right][0]
                if right + 1 == bound:
                    bound, left = left, self.parts[left][1]
                    if left == bound:
                        return True


class BacktrackingBpe:
    """Exact BPE of words. Tokens are numbered by merge order inside and mapped to the file's ids outside."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        to_byte = {c: chr(b) for b, c in enumerate(alphabet)}
        plain = {k: "".join(to_byte[c] for c in k) for k in model["vocab"] if all(c in to_byte for c in k)}
        number = {chr(b): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (number[plain[a]], number[plain[b]])
            if plain[a] + plain[b] in number:
                raise ValueError(f"two merges make {a + b}: not a vocabulary that this encoder can take")
            number[plain[a] + plain[b]] = self.merged[pair] = len(self.parts)
            self.parts.append(pair)
        self.number = number
        self.texts = list(number)
        self.ids = [0] * len(self.texts)
        for k, text in plain.items():
            if text in number:
                self.ids[number[text]] = model["vocab"][k]
        self.special = {}
        for x in spec["added_tokens"]:
            if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
                raise ValueError(f"special token {x['content']} has options that this encoder does not take")
            self.special[x["content"]] = x["id"]
        self.sizes = list(map(len, self.texts))
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.texts]
        self.compatible = _Compatible(self.merged, self.parts)
        self.matches = ahocorasick.Automaton()
        for text, k in number.items():
            self.matches.add_word(text, k)
        self.matches.make_automaton()
        self._offsets()

    def _offsets(self) -> None:
        """The offset table: where each id's bytes start in one array of all of them, and their count."""
        by_id = {i: t.encode("latin-1") for i, t in zip(self.ids, self.texts, strict=True)} | {i: c.encode() for c, i in self.special.items()}
        size = max(by_id) + 1
        lengths = np.zeros(size, np.int64)
        for i, x in by_id.items():
            lengths[i] = len(x)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def word(self, text: str) -> list[int]:
        """Tokens (by merge order) of one word, given as bytes in Latin-1."""
        whole = self.number.get(text)
        if whole is not None:
            return [whole]
        sizes, fits, shorter = self.sizes, self.compatible, self.shorter
        size = len(text)
        # The longest token that starts at each byte: the automaton reports matches by their ends, so the last one wins.
        longest = [0] * size
        for end, token in self.matches.iter(text):
            longest[end + 1 - sizes[token]] = token
        out: list[int] = []
        closed = bytearray(size + 1)
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + sizes[token]
            if not closed[end] and (last < 0 or fits[last, token]):
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            if token < 0:
                # No token fits here: this can't be a border. Go back and try a shorter token before it.
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        """Ids of short texts as little-endian unsigned 32-bit integers; each is cut by the pattern first."""
        out = []
        for piece in pieces:
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                words = [piece]
            elif body[:-1].isalpha() and body[-1] in ".,;:!?":
                words = [piece[:-1], piece[-1]]
            else:
                words = WORDS.findall(piece)
            ids = array("I")
            for w in words:
                ids.extend([self.ids[k] for k in self.word(w.encode().decode("latin-1"))])
            out.append(ids.tobytes())
        return out

    @cached_property
    def encoder(self) -> PieceEncoder:
        """One for each worker: what it has learnt serves the next task."""
        return PieceEncoder(self.encode_many, {c: i.to_bytes(4, "little") for c, i in self.special.items()})

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary raises IndexError."""
        if len(ids) == 0:
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BacktrackingBpe:
    """One table per worker and file."""
    return BacktrackingBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit integers. A null text is empty; rows stay as they are."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path).encoder
        for batch in batches:
            ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of (id, ids); null ids give the empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for batch in batches:
            texts = [table.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded in one pass, digested where it stands."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        encoder = table.encoder
        for batch in batches:
            ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            back = [sha(table.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
