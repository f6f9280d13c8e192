"""Splitting texts where byte-level BPE never merges, and a cache of the pieces' ids."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import regex

#: The published pattern that separates words before merges; the same for all byte-level vocabularies used here.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Entries that each of a worker's two caches may hold; a full cache starts afresh.
CACHED = 600_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of texts, from an encoder of short strings that is asked once for each distinct piece.

    The pattern always starts a word at a space between two characters that are no white
    space. So a text whose spaces all stand like that is cut at its spaces; any other text is
    cut by the pattern. Either way the concatenated ids of the pieces are the ids of the text.
    `encode_many` maps strings to their ids as bytes; `encode_spaced` does so for pieces that
    start after a space and end in no white space, by default each with the space before it.
    `special` are the strings that the vocabulary treats as one token wherever they stand,
    with their ids as bytes.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], special: dict[str, bytes], limit: int = CACHED, encode_spaced: Callable[[list[str]], list[bytes]] | None = None):
        self.encode_many, self.special, self.limit = encode_many, special, limit
        self.encode_spaced = encode_spaced or (lambda pieces: encode_many([" " + x for x in pieces]))
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {"": b""}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _learn(self, cache: dict[str, bytes], pieces: set[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        new = [x for x in pieces if x not in cache]
        if len(cache) + len(new) > self.limit:
            cache.clear()
            new = list(pieces)
        if new:
            cache.update(zip(new, encode(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        # What a text's pieces have in the cache is looked up once; only texts with an unknown piece are gone through again.
        rows: list[tuple[list[str], list[bytes | None]] | bytes] = []
        fresh: set[str] = set()
        plain: set[str] = {""}
        marked = {}  # first, as they learn for themselves
        for k, text in enumerate(texts):
            if self.at_special is not None and any(x in text for x in self.special):
                marked[k] = b"".join(self.special[x] if x in self.special else self.encode([x])[0] for x in self.at_special.split(text) if x)
        for k, text in enumerate(texts):
            if k in marked:
                rows.append(marked[k])
                continue
            parts = text.split(" ")
            found = list(map(self.spaced.get, parts))
            found[0] = None
            fresh.update([x for x, ids in zip(parts, found, strict=True) if ids is None][1:])
            plain.add(parts[0])
            rows.append((parts, found))
        odd = {x for x in fresh if not x or x[0].isspace() or x[-1].isspace()}
        cut: dict[int, list[str]] = {}
        for k, row in enumerate(rows):
            if isinstance(row, tuple) and len(row[0]) > 1 and (not row[0][0] or row[0][0][-1].isspace() or odd and not odd.isdisjoint(row[0])):
                cut[k] = WORDS.findall(texts[k])
                plain.update(cut[k])
        self._learn(self.spaced, fresh - odd, self.encode_spaced)
        self._learn(self.plain, plain, self.encode_many)
        out = []
        for k, row in enumerate(rows):
            if isinstance(row, bytes):
                out.append(row)
            elif k in cut:
                out.append(b"".join(map(self.plain.__getitem__, cut[k])))
            else:
                parts, found = row
                found[0] = self.plain[parts[0]]
                if not all(found):
                    found = [self.spaced[x] if ids is None else ids for x, ids in zip(parts, found, strict=True)]
                out.append(b"".join(found))
        return out


#: Characters of a text in which the library encodes many pieces at once.
JOINED = 4096


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """A PieceEncoder over the tokenizers library, one for each worker and file: what it has learnt serves the next task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {x.content: int(i).to_bytes(4, "little") for i, x in tokenizer.get_added_tokens_decoder().items()}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a byte-level token is a byte
    for token, i in vocabulary.items():
        sizes[i] = len(token)

    def encode_many(pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_spaced(pieces: list[str]) -> list[bytes]:
        # Words begin at the spaces between pieces, so many pieces can be one text; bytes tell where each ends.
        texts, size = [[]], 0
        for x in pieces:
            if size > JOINED:
                texts.append([])
                size = 0
            texts[-1].append(x)
            size += len(x) + 1
        found = tokenizer.encode_batch_fast([" " + " ".join(x) for x in texts], add_special_tokens=False)
        out: list[bytes] = []
        for own, encoded in zip(texts, found, strict=True):
            ids = np.array(encoded.ids, "<u4")
            ends = np.cumsum([len(x.encode()) + 1 for x in own])
            cuts = (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1) * 4
            data, begin = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(data[begin:end])
                begin = end
        return out

    return PieceEncoder(encode_many, special, encode_spaced=encode_spaced)
