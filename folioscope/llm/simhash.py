"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.components import connected_components
from folioscope.llm.words import mix
from folioscope.runtime import drop, settled, small_batches, written

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16
#: Bands of a document, and least values in each: two sets of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 20, 6
_tables: list[np.ndarray] = []
#: Bits of a shingle's value whose texts are counted, to put frequent shingles last in an order of all.
COUNT_BITS = 18
#: Room for the rounding of a share of a count; counts differ by 1.
_SLACK = 1e-6
#: Fingerprints of a task that emits their variants, about.
SPREAD_ROWS = 20_000


def text_fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: A-Z lowered, words split at ASCII white space, shingles of `size` words.

    A bit is 1 if it is set in over half of the shingles' XXH64 values, repeats included.
    Fewer words than `size` make one shingle of them all; no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, count, _CHUNK):
        values = [digest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row: fp is the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((text_fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(hashed, T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())]))


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links among distinct fingerprints `fp` at `radius` differing bits or fewer (radius 2 here).

    Each fingerprint emits itself and its 64 one-bit variants. Two fingerprints at distance 2
    share the variant midway, so shuffling on variants misses none. All fingerprints on one
    variant lie within 2 bits of each other and are at most 65; a star to their smallest
    keeps the classes without emitting pairs. Every star edge is verified by its bit count.
    """
    if radius != 2:
        raise ValueError("half the radius is one bit here: radius must be 2")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    # The rows grow 65-fold next: a table of few files would do that in few tasks.
    spread = distinct.repartition(min(1 << 16, -(-distinct.count() // SPREAD_ROWS) or 1), "fp")
    variants = spread.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    # A group holds 65 rows at most, whatever the input.
    members = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = members.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter(F.col("a") != F.col("b"))
    return stars.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id reachable over links of `radius` bits.

    Null and empty texts have fingerprint 0 and link as any other. Equal fingerprints meet
    in one row before links are sought, so a group of copies costs one row. Repeated ids
    stay as rows; a null id is no candidate for the smallest, and its rows keep the
    component of their fingerprint (null if no other id is in it). Extra columns are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(ball_links(classes.select("fp"), radius), "a", "b")
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = labelled.join(smallest, "root").select("fp", "component")
    return marked.join(by_fp, "fp").select("id", "fp", "component")


def _shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text, in order and with repeats; words and shingles are those of text_fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    count = max(1, len(words) - size + 1) if words else 0
    return np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(count)], np.uint64)


def _signature(values: np.ndarray) -> bytes:
    """A digest of the set of sorted distinct shingle values: equal for equal sets."""
    return xxhash.xxh3_128_digest(values.astype("<u8").tobytes())


def _bands(values: np.ndarray) -> list[int]:
    """BANDS numbers, each from the least of ROWS permutations of the values; none for no values."""
    if len(values) == 0:
        return []
    factor, term = _permutations()
    least = np.full(len(factor), np.uint64((1 << 64) - 1))
    for k in range(0, len(values), 2048):
        least = np.minimum(least, (values[k : k + 2048, None] * factor + term).min(axis=0))
    data = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(data[8 * ROWS * j : 8 * ROWS * (j + 1)], j) - (1 << 63) for j in range(BANDS)]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        k = np.arange(BANDS * ROWS, dtype=np.uint64)
        _tables.extend([mix(k + np.uint64(1)) | np.uint64(1), mix(k + np.uint64(1 << 40))])
    return _tables[0], _tables[1]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(id, sig, fp, bands) of every row: the digest of its set of shingles, its SimHash, and its band numbers."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, prints, bands = [], [], []
            for text in batch.column(1):
                every = _shingles(text.as_py(), size)
                ones = np.zeros(64, np.int64)
                for k in range(0, len(every), _CHUNK):
                    ones += np.unpackbits(every[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                prints.append(int(np.packbits(2 * ones > len(every), bitorder="little").view("<i8")[0]))
                distinct = np.unique(every)
                sigs.append(_signature(distinct))
                bands.append(_bands(distinct))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "sig", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "id long, sig binary, fp long, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes (c, fp, bands) worth a comparison, a < b.

    Two ways lead to a pair: fingerprints within 2 bits, by ball hashing, and a common band. A group of one
    fingerprint or band gives stars to its smallest and its largest class, not its pairs: links can be missing, and apart() finds them.
    """
    keys = classes.select("c", F.explode("bands").alias("key"))
    ends = keys.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    banded = keys.join(ends, "key").select("c", F.explode(F.array("low", "high")).alias("d"))
    prints = classes.groupBy("fp").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    alike = classes.join(prints.filter("low < high"), "fp").select("c", F.explode(F.array("low", "high")).alias("d"))
    links = ball_links(prints.select("fp"))
    one, two = prints.select(F.col("fp").alias("a"), F.col("low").alias("c")), prints.select(F.col("fp").alias("b"), F.col("low").alias("d"))
    near = links.join(one, "a").join(two, "b").select("c", "d")
    every = banded.union(alike).union(near).filter("c <> d")
    return every.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def _ranks(texts: DataFrame, size: int) -> np.ndarray:
    """For each number of COUNT_BITS bits, how many shingles of the texts begin with it. Any numbers give a right order; these give short groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                values = np.unique(_shingles(text.as_py(), size))
                np.add.at(found, (values >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(found)
        for k in range(0, len(at), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + _CHUNK].astype(np.int32)), pa.array(found[at[k : k + _CHUNK]])], names=["bits", "n"])

    table = texts.select("text").mapInArrow(count, "bits int, n long").groupBy("bits").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[table.column("bits").to_numpy()] = table.column("n").to_numpy()
    return out


def _cut(ranks: np.ndarray, share: float) -> int:
    """The largest count up to which the counts hold at most `share` of all; 0 if the least ones hold more."""
    values, times = np.unique(ranks[ranks > 0], return_counts=True)
    at = np.searchsorted(np.cumsum(values * times), share * ranks.sum(), side="right")
    return int(values[at - 1]) if at else 0


def prefixes(rows: DataFrame, ranks: np.ndarray, size: int, similarity: float) -> DataFrame:
    """(c, root, token, n, at, early): of each row (c, root, sig, text) the first shingles of its set of n, by one order for all rows, and their places in it.

    Two sets of the similarity have ceil(similarity * n) shingles or more in common, n being the size of either. So the first of
    those in the order stands among the first n - ceil(similarity * n) + 1 of both. These are given, and whatever is early:
    before one cut for all rows, about as far on. `early` is the number of the latter.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    cut = _cut(ranks, 1 - similarity)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[tuple[int, int, np.ndarray, int, int]] = []
            for c, root, sig, text in zip(*(batch.column(k) for k in ("c", "root", "sig", "text")), strict=True):
                values = np.unique(_shingles(text.as_py(), size))
                n = len(values)
                # A repeated id can bring another text than the class's.
                if n == 0 or _signature(values) != sig.as_py():
                    continue
                counts = shared.value[(values >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                early = int((counts <= cut).sum())
                some = values[np.lexsort((values, counts))[: max(early, n - int(np.ceil(similarity * n - _SLACK)) + 1)]].view(np.int64)
                own.append((c.as_py(), root.as_py(), some, n, early))
            if own:
                sizes = [len(x[2]) for x in own]
                each = [np.repeat(np.array([x[k] for x in own], t), sizes) for k, t in ((0, np.int64), (1, np.int64), (3, np.int32), (4, np.int32))]
                columns = [*each[:2], np.concatenate([x[2] for x in own]), each[2], np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]), each[3]]
                whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c", "root", "token", "n", "at", "early"])
                for k in range(0, whole.num_rows, _CHUNK):
                    yield whole.slice(k, _CHUNK)

    return rows.select("c", "root", "sig", "text").mapInArrow(first, "c long, root long, token long, n int, at int, early int")


def able(tokens: DataFrame, similarity: float) -> DataFrame:
    """(c, n): the classes that can reach the similarity with a class of another root; tokens are those of `prefixes` that several roots have.

    An early shingle of one set is in another set only if it is early there too. So those that no other root has are in no set of
    another root: a class can have no more in common with any than its size less their number, `own`. A pair of sizes n and m has
    (n + m) * similarity / (1 + similarity) in common or more. So the smaller set of a pair has few of them for its own size (`core`),
    and the larger few enough for the smallest such set that it has a shingle of.
    """
    share = similarity / (1 + similarity)
    classes = tokens.groupBy("c", "n", "early").agg(F.count_if(F.col("at") < F.col("early")).alias("met"))
    classes = classes.select("c", "n", (F.col("n") - F.col("early") + F.col("met")).alias("most"))
    core = classes.filter(F.col("most") >= 2 * share * F.col("n") - _SLACK).select("c")
    least = tokens.join(core, "c", "left_semi").groupBy("token").agg(F.min("n").alias("m"))
    smallest = tokens.join(least, "token").groupBy("c").agg(F.min("m").alias("m"))
    needed = (F.col("n") + F.greatest(F.col("m"), F.col("n") * similarity)) * share
    return classes.join(smallest, "c").filter(F.col("most") >= needed - _SLACK).select("c", "n")


def whole_sets(rows: DataFrame, size: int) -> DataFrame:
    """(c, root, token): every shingle of the set of each row (c, root, sig, text)."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, root, sig, text in zip(*(batch.column(k) for k in ("c", "root", "sig", "text")), strict=True):
                values = np.unique(_shingles(text.as_py(), size))
                if _signature(values) != sig.as_py():  # as in prefixes
                    continue
                for k in range(0, len(values), _CHUNK):
                    some = values[k : k + _CHUNK].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x.as_py(), np.int64)) for x in (c, root)] + [pa.array(some)], names=["c", "root", "token"])

    return rows.select("c", "root", "sig", "text").mapInArrow(every, "c long, root long, token long")


def rarest(sets: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(c, root, token, n, at): as `prefixes`, but in the order of the true number of rows of sets (c, root, token); sizes are (c, n).

    Shingles of one root come first and are not given, as no pair is sought at them.
    """
    token = Window.partitionBy("token")
    counted = sets.withColumn("low", F.min("root").over(token)).withColumn("high", F.max("root").over(token)).withColumn("rows", F.count("*").over(token))
    shared = counted.filter("low < high").select("c", "root", "token", "rows")
    last = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("rows"), F.desc("token")))
    placed = shared.withColumn("last", last).join(sizes, "c").withColumn("at", F.col("n") - F.col("last"))
    return placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - _SLACK)).select("c", "root", "token", "n", F.col("at").cast("int").alias("at"))


def apart(tokens: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of classes of tokens (c, root, token, n, at) with different roots that can reach the similarity, a < b.

    A pair is sought at the first shingle that both have in the order. From there on the smaller rest bounds what they have in common.
    Of a shingle's rows, those of the root that has most need no pair among themselves, so a large group of copies costs its rows, not their pairs.
    """
    sizes = tokens.groupBy("token", "root").agg(F.count("*").alias("rows"))
    most = sizes.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", "rows").alias("main")).filter("roots > 1").select("token", "main")
    shared = tokens.join(most, "token")
    one = shared.filter("root <> main").select("token", F.col("c").alias("d"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("at").alias("place"))
    both = one.join(shared, "token").filter("root <> other and (root = main or c < d)")
    most_common = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
    can = both.filter(most_common * (1 + similarity) >= (F.col("n") + F.col("m")) * similarity - _SLACK)
    return can.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def similar(pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) of rows (a, b, sig_a, sig_b, text_a, text_b) whose sets of shingles have a Jaccard similarity of at least `similarity`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("b").to_pylist()
            kept_b: dict[int, np.ndarray] = {}  # a star's centre is read once a batch
            good = []
            for a, b, sig_a, sig_b, text_a, text_b in zip(*(batch.column(n) for n in ("a", "b", "sig_a", "sig_b", "text_a", "text_b")), strict=True):
                one = np.unique(_shingles(text_a.as_py(), size))
                number = b.as_py()
                if number not in kept_b:
                    kept_b[number] = np.unique(_shingles(text_b.as_py(), size))
                two = kept_b[number]
                # A repeated id can bring another text than the class's.
                right = _signature(one) == sig_a.as_py() and _signature(two) == sig_b.as_py()
                if not right and _signature(two) != sig_b.as_py():
                    del kept_b[number]
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(right and both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(names, pa.int64())], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of every row with an id: component is the smallest id that links of `similarity` or more reach.

    Similarity is that of Jaccard on the sets of `size`-word shingles, and every link is verified on whole texts. At this
    similarity two fingerprints differ by 10 of 64 bits or more as a rule, and the variants within half of that are too many to
    emit; so ball hashing finds the pairs within 2 bits, and bands of least values (BANDS of ROWS) find others:
    99.8 % of pairs at 0.8 share a band. A group of these gives stars, not pairs, and a star can fail where two of its ends are
    alike; so an exact search follows: classes that these links leave apart are paired by the first shingles of their
    sets (`prefixes`, `apart`), which no pair of the similarity can miss, and verified in the same way. Rows with one set of
    shingles, texts without a word among them, are one class before any pair is sought, so a group of copies costs one row. A row with a null id is in no group. An id with several texts is in the
    groups of all of them, with a row for each. Extra columns are ignored; an empty table gives an empty one.
    """
    marked = written(sketches(docs, id_col, text_col, size), "sketches")
    grouped = marked.filter("id is not null").groupBy("sig").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = written(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    pairs = written(candidates(classes), "pairs")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs
        for end in "ab":
            own = classes.select(F.col("c").alias(end), F.col("least").alias("id"), F.col("sig").alias(f"sig_{end}"))
            asked = asked.join(own, end).join(texts.withColumnRenamed("text", f"text_{end}"), "id").drop("id")
        return settled(similar(asked, size, similarity), "links", pairs)

    links = verified(pairs)
    roots = connected_components(links, "a", "b")
    drop(links)
    placed = classes.select(F.col("least").alias("id"), "c", "sig").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    tokens = prefixes(texts.join(placed, "id"), _ranks(texts, size), size, similarity)
    # Most shingles are those of one text or one root.
    token = Window.partitionBy("token")
    several = tokens.withColumn("low", F.min("root").over(token)).withColumn("high", F.max("root").over(token)).filter("low < high").drop("low", "high")
    several = written(several, "prefixes")
    left = settled(able(several, similarity), "able", several)
    first = rarest(whole_sets(texts.join(placed.join(left, "c"), "id"), size), left, similarity)
    first = settled(first, "prefixes", left)
    more = verified(settled(apart(first, similarity), "pairs", first))
    roots = connected_components(more.union(roots.filter("node <> root").select("node", "root")), "a", "b")
    drop(more)
    labelled = classes.join(roots, classes["c"] == roots["node"], "left").select("sig", "least", F.coalesce("root", "c").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    by_sig = labelled.join(smallest, "root").select("sig", "component")
    return settled(marked.filter("id is not null").join(by_sig, "sig").select("id", "component"), "near", marked, classes)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose id is the smallest of a group of near copies; all columns stay.

    Rows with a null id have no name by which a copy could replace them: they stay. Repeated rows with such an id all stay.
    """
    found = near_copies(docs, id_col, text_col, size, similarity)
    first = found.filter(F.col("id") == F.col("component")).select(F.col("id").alias("__keep")).distinct()
    named = docs.join(first, docs[id_col].cast("long") == first["__keep"], "left_semi")
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, XXH64 with seed 42, 2 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
