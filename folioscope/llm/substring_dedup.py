"""Substring deduplication over a log-structured index of window hashes, whose matches are verified by the words."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.words import mix, paired_hashes
from folioscope.runtime import small_batches

#: Words of a window.
WINDOW = 13
#: Bytes of text of a block, and window hashes of a bucket, about.
BLOCK_BYTES, BUCKET_ENTRIES = 6 << 20, 1 << 20
#: Ranges of ids that blocks are dealt over at most; beyond, blocks share a range and entries carry ids.
MAX_RANGES = 1 << 16
#: Partitions that blocks or buckets are dealt over at most; beyond, a task takes several, one after another.
MAX_PARTS = 1 << 16
#: Bytes of text that count as one row where ids are cut into ranges.
_GRAIN = 4096
_Q1, _Q2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)
#: Owners of entries that are history, and of entries that no run has.
_HISTORY, _NOWHERE = -1, -2

RUN = "bucket long, turn long, block long, n long, gaps binary, low binary, check binary, docs binary"


def window_hashes(one: np.ndarray, two: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, 64-bit key, 16-bit check) of every window of `size` words that lies in one text; one, two: the words' two hashes."""
    n = len(one) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + size <= last)
    keys, checks = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        keys = (keys + one[k : k + n]) * _Q1
        checks = (checks + two[k : k + n]) * _Q2
    return at, mix(keys[at]), (mix(checks[at]) >> np.uint64(48)).astype(np.uint16)


def _same_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which windows a[at:at + WINDOW] and b[other:other + WINDOW] have the same words, given as their numbers."""
    out = np.ones(len(at), bool)
    for k in range(WINDOW):
        out &= a[at + k] == b[other + k]
    return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.view("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unplanes(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(gaps of the upper 24 bits, lower 40 bits) of ascending 64-bit keys: about six bytes each where they lie dense."""
    upper = (keys >> np.uint64(40)).astype(np.int64)
    gaps = np.diff(upper, prepend=0)
    # A gap of 255 or more is as many bytes 255 as it holds, then the rest.
    more = gaps // 255
    out = np.full(len(keys) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = (gaps % 255).astype(np.uint8)
    return out.tobytes(), _planes(keys & np.uint64((1 << 40) - 1), 5)


def unpack_sorted(gaps: bytes, low: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint8)
    upper = np.cumsum(steps, dtype=np.uint64)[steps < 255]
    return (upper << np.uint64(40)) | _unplanes(low, 5, n)


class RunIndex:
    """Immutable sorted runs of (key, check, owner); a batch is merge-joined with each, then becomes a run.

    Runs of like size are merged into one (compaction), which keeps the newest owner of an
    entry, so there are about log2 of the batches.
    """

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def owners(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The newest owner of each (key, check); _NOWHERE if no run holds it."""
        found = np.full(len(keys), _NOWHERE, np.int64)
        left = np.arange(len(keys))
        for old, old_checks, own in reversed(self.runs):
            at = _find(old, old_checks, keys[left], checks[left])
            found[left[at >= 0]] = own[at[at >= 0]]
            left = left[at < 0]
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray, owners: np.ndarray) -> None:
        """Append a run of ascending keys; compact while the last run is at least half the one before."""
        if len(keys) == 0:
            return
        self.runs.append((keys, checks, owners))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            joined, marks, own = (np.concatenate(x) for x in zip(*self.runs[-2:], strict=True))
            order = np.argsort(joined, kind="stable")
            joined, marks, own = joined[order], marks[order], own[order]
            newer = np.zeros(len(joined), bool)  # is the next entry the same one with a newer owner?
            newer[:-1] = (joined[1:] == joined[:-1]) & (marks[1:] == marks[:-1])
            self.runs[-2:] = [(joined[~newer], marks[~newer], own[~newer])]


def _find(old: np.ndarray, old_checks: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where (key, check) lies in a run of ascending keys, or -1."""
    found = np.full(len(keys), -1, np.int64)
    if len(old) == 0:
        return found
    at = np.searchsorted(old, keys)
    while True:
        inside = np.minimum(at, len(old) - 1)
        same = (at < len(old)) & (old[inside] == keys)
        hit = same & (old_checks[inside] == checks)
        found = np.where(hit & (found < 0), inside, found)
        same &= found < 0  # keys that are equal with another check lie side by side
        if not same.any():
            return found
        at = np.where(same, at + 1, len(old))


def _firsts(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, check and doc; which of them start a new (key, check)). Without docs, rows are in their order already."""
    order = np.argsort(keys, kind="stable") if docs is None else np.lexsort((docs, checks, keys))
    k, c = keys[order], checks[order]
    if docs is None and ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


class _Block:
    """The documents of a block in order of id, with the hashes of their windows."""

    def __init__(self, table: pa.Table):
        names = [_NO_ID if x is None else x for x in table.column("id").to_pylist()]
        order = np.argsort(np.array(names, np.int64), kind="stable")
        table = table.take(pa.array(order))
        self.names = table.column("id").to_pylist()
        self.ids = np.array([_NO_ID if x is None else x for x in self.names], np.int64)
        self.texts = [(x or "").encode() for x in table.column("text").to_pylist()]
        one, two, self.bounds = paired_hashes(self.texts)
        self.at, self.keys, self.checks = window_hashes(one, two, self.bounds)
        self.doc = np.searchsorted(self.bounds, self.at, side="right") - 1 if len(self.at) else self.at


def window_runs(docs: DataFrame, bits: int, id_bytes: int) -> DataFrame:
    """RUN rows: for each block and bucket one sorted run of the distinct window hashes of the block's documents.

    docs: turn (rank of the range of ids), block, id, text.
    id_bytes: width of the first document's id; 0 where a range is one block, as then `turn` alone tells which is earlier.
    A block's rows must lie in one partition.
    """

    def emit(table: pa.Table) -> pa.Table:
        block = _Block(table)
        order, new = _firsts(block.keys, block.checks)
        first = order[new]
        keys, checks = block.keys[first], block.checks[first]
        ids = block.ids[block.doc[first]] if id_bytes else np.zeros(len(first), np.int64)
        buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            gaps, low = pack_sorted(keys[a:b])
            rows.append((int(buckets[a]), gaps, low, checks[a:b].tobytes(), _planes(ids[a:b], id_bytes), int(b - a)))
        turn, name = table.column("turn")[0].as_py(), table.column("block")[0].as_py()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int64()), "turn": pa.array([turn] * len(rows), pa.int64()), "block": pa.array([name] * len(rows), pa.int64()), "n": pa.array(columns[5], pa.int64()),
                "gaps": pa.array(columns[1], pa.binary()), "low": pa.array(columns[2], pa.binary()), "check": pa.array(columns[3], pa.binary()), "docs": pa.array(columns[4], pa.binary()),
            }
        )

    return docs.groupBy("block").applyInArrow(emit, RUN)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    width = len(row["docs"]) // n
    return unpack_sorted(row["gaps"], row["low"], n), np.frombuffer(row["check"], np.uint16), _unplanes(row["docs"], width, n).view(np.int64)


HITS = "first long, n long, gaps binary, low binary, check binary, blocks binary"


def earlier_windows(runs: DataFrame) -> DataFrame:
    """HITS rows: windows of `blocks` (one for each window) that an earlier document in the block `first` seems to have, by their hashes.

    In each bucket, batches go in order of `turn`: a batch is merge-joined with the runs of
    all before it, then becomes a run itself. A window's owner is the last block before that has
    it, so a passage of many blocks asks each of them once, not its first for all. Runs with
    turn < 0 are history: they answer to no block, and what they own has first = -1 - block.
    """

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["turn"], r["block"]))
        index, k = RunIndex(), 0
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while k < len(rows):
            j = k
            while j < len(rows) and rows[j]["turn"] == rows[k]["turn"]:
                j += 1
            parts = [_unpacked(r) for r in rows[k:j]]
            keys, checks, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
            block = np.repeat(np.array([r["block"] for r in rows[k:j]], np.int64), [len(p[0]) for p in parts])
            order, new = _firsts(keys, checks, ids if j > k + 1 else None)
            keys, checks, ids, block = keys[order], checks[order], ids[order], block[order]
            first = np.flatnonzero(new)
            if rows[k]["turn"] >= 0:
                group = np.cumsum(new) - 1
                owner = index.owners(keys[first], checks[first])[group]
                inside = (owner == _NOWHERE) & (ids > ids[first][group])  # a range that blocks share
                owner[inside] = block[first][group][inside]
                mine = owner != _NOWHERE
                hits.append((np.where(owner == _HISTORY, -1 - block, owner)[mine], keys[mine], checks[mine], block[mine]))
                index.add(keys[first], checks[first], block[first])
            else:
                index.add(keys[first], checks[first], np.full(len(first), _HISTORY, np.int64))
            k = j
        out: list[tuple] = []
        if hits:
            owner, keys, checks, block = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((keys, owner))
            owner, keys, checks, block = owner[order], keys[order], checks[order], block[order]
            cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(0, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                gaps, low = pack_sorted(keys[a:b])
                out.append((int(owner[a]), int(b - a), gaps, low, checks[a:b].tobytes(), _planes(block[a:b], 5)))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("first", "n", "gaps", "low", "check", "blocks"), columns, kinds, strict=True)})

    return runs.groupBy("bucket").applyInArrow(merge, HITS)


WITNESS = "block long, id long, text binary, n long, gaps binary, low binary, check binary"


def witnesses(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """WITNESS rows: for the windows asked for, the words that the earlier document `id` has there, sent to the block that asks.

    Overlapping windows are sent as one stretch of words. What history owns has no words: its hashes are sent on.
    """

    def send(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and own.num_rows == 0:
            first = asked.column("first")[0].as_py()
            out = [(-1 - first, None, None, r["n"], r["gaps"], r["low"], r["check"]) for r in asked.to_pylist()]
        elif asked.num_rows:
            block = _Block(own)
            found = asked.to_pylist()
            keys = np.concatenate([unpack_sorted(r["gaps"], r["low"], r["n"]) for r in found])
            checks = np.concatenate([np.frombuffer(r["check"], np.uint16) for r in found])
            to = np.concatenate([_unplanes(r["blocks"], 5, r["n"]).view(np.int64) for r in found])
            order, new = _firsts(keys, checks)
            head = order[new]
            asked_for = np.zeros(1 << 22, bool)  # a first look by the upper bits
            asked_for[keys >> np.uint64(42)] = True
            mine = np.flatnonzero(asked_for[block.keys >> np.uint64(42)])
            which = _find(keys[head], checks[head], block.keys[mine], block.checks[mine])
            mine, which = mine[which >= 0][::-1], which[which >= 0][::-1]
            place = np.full(len(head), -1, np.int64)
            place[which] = mine  # the block's first window of each key: assigned last
            window = np.empty(len(keys), np.int64)
            window[order] = place[np.cumsum(new) - 1]
            to, window = to[window >= 0], window[window >= 0]
            order = np.lexsort((window, to))
            to, window = to[order], window[order]
            at = block.at[window]
            cuts = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (at[1:] - at[:-1] >= WINDOW), [True]))) if len(at) else np.zeros(0, np.int64)
            split: dict[int, list[bytes]] = {}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                doc = int(block.doc[window[a]])
                if doc not in split:
                    split[doc] = block.texts[doc].split()
                begin = int(block.bounds[doc])
                text = b" ".join(split[doc][at[a] - begin : at[b - 1] - begin + WINDOW])
                out.append((int(to[a]), int(block.ids[doc]), text, None, None, None, None))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "id", "text", "n", "gaps", "low", "check"), columns, kinds, strict=True)})

    return rows.groupBy("block").cogroup(hits.groupBy("first")).applyInArrow(send, WITNESS)


def compacted(runs: DataFrame) -> DataFrame:
    """All runs of a bucket as one run of history (turn -1), to be kept for the next batch of documents."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpacked(r) for r in rows]
        keys, checks = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order, new = _firsts(keys, checks)
        keys, checks = keys[order][new], checks[order][new]
        gaps, low = pack_sorted(keys)
        row = {"bucket": rows[0]["bucket"], "turn": -1, "block": -1, "n": len(keys), "gaps": gaps, "low": low, "check": checks.tobytes(), "docs": b""}
        return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

    return runs.groupBy("bucket").applyInArrow(merge, RUN)


class _Told:
    """Windows of the stretches of words that earlier documents have, by (key, check, id)."""

    def __init__(self, told: list[dict]):
        self.texts = [r["text"] for r in told]
        one, two, self.bounds = paired_hashes(self.texts)
        at, keys, checks = window_hashes(one, two, self.bounds)
        ids = np.array([r["id"] for r in told], np.int64)[np.searchsorted(self.bounds, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((ids, checks, keys))
        self.at, self.keys, self.checks, self.ids = at[order], keys[order], checks[order], ids[order]


def _removal(block: _Block, told: list[dict]) -> np.ndarray:
    """Per word of the block: is it covered by a window whose words an earlier document has?

    Windows with one hash are candidates, inside the block and with what other blocks told. Their words get
    numbers, equal exactly for equal bytes, and a window goes only if all 13 numbers agree.
    """
    removed = np.zeros(int(block.bounds[-1]) + 1, np.int32)
    if len(block.at) == 0:
        return removed[:-1] > 0
    order, new = _firsts(block.keys, block.checks)
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    at, ids = block.at[order], block.ids[block.doc[order]]
    more = np.flatnonzero(~new)
    theirs = _Told([r for r in told if r["text"] is not None])
    place = _find(theirs.keys, theirs.checks, block.keys[order], block.checks[order])
    left = np.flatnonzero(place >= 0)

    number: dict[bytes, int] = {}
    numbers = np.full(len(removed) - 1, -1, np.int32)
    covered = np.zeros(len(removed), np.int32)
    for used in (at[more], at[first[group[more]]], at[left]):
        np.add.at(covered, used, 1)
        np.add.at(covered, used + WINDOW, -1)
    covered = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    for doc in np.unique(np.searchsorted(block.bounds, covered, side="right") - 1).tolist():
        begin, end = block.bounds[doc], block.bounds[doc + 1]
        own, words = covered[np.searchsorted(covered, begin) : np.searchsorted(covered, end)], block.texts[doc].split()
        numbers[own] = [number.setdefault(words[k], len(number)) for k in (own - begin).tolist()]
    their_numbers = np.array([number.setdefault(x, len(number)) for text in theirs.texts for x in text.split()], np.int32)

    dup = np.zeros(len(at), bool)
    dup[more] = ids[more] > ids[first[group[more]]]
    differ = more[~_same_words(numbers, at[more], numbers, at[first[group[more]]])]
    for g in np.unique(group[differ]):  # two texts with one hash: told apart by their words
        least: dict[tuple, int] = {}
        for m in np.flatnonzero(group == g):
            dup[m] = ids[m] > least.setdefault(tuple(numbers[at[m] : at[m] + WINDOW].tolist()), ids[m])

    fresh = np.ones(len(theirs.at), bool)
    fresh[1:] = (theirs.keys[1:] != theirs.keys[:-1]) | (theirs.checks[1:] != theirs.checks[:-1]) | ~_same_words(their_numbers, theirs.at[1:], their_numbers, theirs.at[:-1])
    place = (np.cumsum(fresh) - 1)[place[left]]
    keys, checks, their_at, their_ids = theirs.keys[fresh], theirs.checks[fresh], theirs.at[fresh], theirs.ids[fresh]
    while len(left):
        hit = _same_words(numbers, at[left], their_numbers, their_at[place]) & (their_ids[place] < ids[left])
        dup[left[hit]] = True
        # Another text may have the same hash with the right words: it lies next.
        after = np.minimum(place + 1, len(keys) - 1)
        go = ~hit & (after > place) & (keys[after] == keys[place]) & (checks[after] == checks[place])
        left, place = left[go], after[go]

    history = RunIndex()
    history.runs = [(unpack_sorted(r["gaps"], r["low"], r["n"]), np.frombuffer(r["check"], np.uint16), np.zeros(r["n"], np.int64)) for r in told if r["text"] is None]
    if history.runs:
        # They come as one run per bucket, and buckets are ranges of keys: side by side they are one sorted run.
        history.runs.sort(key=lambda r: int(r[0][0]))
        history.runs = [tuple(np.concatenate(x) for x in zip(*history.runs, strict=True))]
        head = order[first]
        dup |= (history.owners(block.keys[head], block.checks[head]) != _NOWHERE)[group]
    at = at[dup]
    np.add.at(removed, at, 1)
    np.add.at(removed, at + WINDOW, -1)
    return np.cumsum(removed[:-1]) > 0


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int, int]:
    """(rows with turn, block, id, text; bits of a bucket number; bytes of an id in an entry; number of blocks).

    Ids are cut into ranges of about BLOCK_BYTES of text, at quantiles in which a row counts by
    its bytes. The cuts are found by a scan of ids and lengths and stand in the plan as two
    levels, so a row compares with about twice the root of their number. Where more than
    MAX_RANGES would be needed, a range is shared by several blocks. Rows with a null id are
    earlier than all others and not than each other: they share the first turn and are dealt over blocks by their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    size = rows.agg(*[F.coalesce(F.sum(F.when(x, length)), F.lit(0)).alias(n) for n, x in (("bytes", F.col("id").isNotNull()), ("nulls", F.col("id").isNull()))]).first()
    blocks = max(1, -(-size["bytes"] // BLOCK_BYTES))
    ranges = min(blocks, MAX_RANGES)
    share = -(-blocks // ranges)
    cuts: list[int] = []
    if ranges > 1:
        weighed = rows.filter("id is not null").select("id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(coalesce(octet_length(text), 0) div {_GRAIN} as int)"))))
        found = weighed.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges)).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    key = F.coalesce(F.col("id"), F.lit(_NO_ID))
    if cuts:
        above = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda x: x <= key))
        nested = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
        inner = F.when(above == 0, 0).otherwise((above - 1) * step + F.size(F.filter(F.element_at(nested, F.greatest(above, F.lit(1))), lambda x: x <= key)))
        turn = inner.cast("long") + 1
    else:
        turn = F.lit(1).cast("long")
    rows = rows.withColumn("turn", F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(turn))
    block = F.col("turn") if share == 1 else F.col("turn") * share + F.pmod(F.xxhash64(key), F.lit(share))
    beyond, spread = (ranges + 1) * share, max(1, -(-size["nulls"] // BLOCK_BYTES))
    rows = rows.withColumn("block", F.when(F.col("id").isNull(), F.lit(beyond) + F.pmod(F.xxhash64("text"), F.lit(spread))).otherwise(block))
    whole = size["bytes"] + size["nulls"]
    bits = max(0, min(23, (max(1, whole // 6) // BUCKET_ENTRIES).bit_length()))
    return rows.select("turn", "block", "id", "text"), bits, 0 if share == 1 else 8, blocks + spread - 1


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, runs): result has (id, n_words, n_removed, kept) per row; runs are what compacted() turns into the next batch's history.

    A word goes if a window of 13 words over it also starts in a row with a smaller id (or
    in `history`); windows are judged on the input. `kept` is the remaining words joined by
    one space, or with `digest` its SHA-256 as `kept_sha256`. Null texts have no words. A null
    id counts as smaller than any; rows with one id are not earlier than each other.
    Extra columns are ignored. A history must have been made with the same number of buckets.

    Hashes only find candidates: the earlier document's words are sent to the block that has
    the window and compared there before a word goes. A history holds no words; matches with it go by 80 bits.

    Texts are shuffled once, by block; blocks, window hashes and the words asked for meet again in the same
    partitions. A window of many documents has one entry per block, so a common passage
    weighs no more than the blocks it is in.
    """
    small_batches(docs.sparkSession)
    rows, bits, id_bytes, blocks = dealt(docs, id_col, text_col)
    parts = min(blocks, MAX_PARTS)
    rows = rows.repartition(parts, "block")
    runs = window_runs(rows, bits, id_bytes)
    every = runs if history is None else runs.unionByName(history)
    hits = earlier_windows(every.repartition(min(max(parts, 1 << bits), MAX_PARTS), "bucket"))
    told = witnesses(rows, hits.repartition(parts, "first"))
    last = "kept_sha256" if digest else "kept"

    def apply(own: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block(own)
        gone = _removal(block, found.select(["id", "text", "n", "gaps", "low", "check"]).to_pylist())
        names, counts, cut, kept = [], [], [], []
        for k, text in enumerate(block.texts):
            mine = gone[block.bounds[k] : block.bounds[k + 1]]
            words = text.split()
            n = int(np.count_nonzero(mine))
            left = b" ".join(compress(words, ~mine) if n else words)
            names.append(block.names[k])
            counts.append(len(words))
            cut.append(n)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
        return pa.table({"id": pa.array(names, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(cut, pa.int64()), last: pa.array(kept, pa.string())})

    result = rows.groupBy("block").cogroup(told.repartition(parts, "block").groupBy("block")).applyInArrow(apply, f"id long, n_words long, n_removed long, {last} string")
    return result, runs


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, digest=True)[0].withColumnRenamed("id", "doc_id")


#: The same in DuckDB, window by window as text; for small tables.
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS t FROM d, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)
), f AS (
  SELECT t, min(doc_id) AS first FROM w GROUP BY t
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM w JOIN f USING (t), range({WINDOW}) AS r(j) WHERE first < doc_id
), words AS (
  SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(i)
), kept AS (
  SELECT doc_id, count(*) AS n, count(g.i) AS cut, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS text FROM words w LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(cut, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
