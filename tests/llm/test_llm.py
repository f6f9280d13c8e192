"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import ann, bpe, chunks, exact_dedup, html_extract, language, mixing, quality, simhash, substring_dedup, token_store
from folioscope.llm.components import connected_components
from folioscope.llm.words import word_hashes
from folioscope.runtime import scratch_path, written

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, block long"


def _docs(spark, texts, ids=None):
    """Documents with two columns whose names clash with ones used inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], ("a", "a", "b")[k % 3], 0, "x", 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def _texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "的", "x", "y", "zeta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(25))
    out = [b + " " + passage if k % 4 == 0 else b for k, b in enumerate(base)]
    return [*out, None, "", "  \t ", out[0], out[0].replace(" ", "\n"), out[5] + " tail", "long " * 9000]


# Words and pieces.


def test_word_hashes_know_words():
    texts = [(t or "").encode() for t in _texts()] + [b"w" * 5000 + b" y", b"z" * 1_100_000 + b" a b", b"q " * 600_000]
    hashes, shapes, bounds = word_hashes(texts, shapes=True)
    seen = {}
    for i, t in enumerate(texts):
        own = t.split()
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and len(shapes) == len(hashes)


def _weird(n=400):
    rng = random.Random(5)
    letters = "aàbßc 0९١٣ \n\t.,'sxé漢字\U0001f600  !?—-_$\x1c\x85ıİ½²ⅷ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a<|endoftext|> b<|endoftext|>", " lead", "tail \n", "x \n y", "a" * 700, "don't we'll  GO", ""]


@pytest.mark.parametrize("which", ["own", "library", "small cache"])
def test_encoders_equal_the_library(which):
    from tokenizers import Tokenizer

    path = chunks.vocabulary_path()
    texts = _weird() + [t or "" for t in _texts()]
    expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    table = bpe.vocabulary(path)
    encoder = {"own": table.encoder, "library": chunks.library_encoder(path), "small cache": chunks.PieceEncoder(table.encode_many, {}, limit=5)}[which]
    if which == "small cache":
        texts, expected = texts[:300], expected[:300]
    got = []
    for k in range(0, len(texts), 50):
        got += [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[k : k + 50])]
    assert got == expected


def test_decoding_is_a_round_trip():
    from tokenizers import Tokenizer

    path = chunks.vocabulary_path()
    library, table = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert table.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    docs = _docs(spark, _texts())
    encoded = bpe.encode(docs)
    back = {r.id: r.text for r in bpe.decode(encoded).collect()}
    assert back == {k: t or "" for k, t in enumerate(_texts())}
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    ids = {r.id: bytes(r.ids) for r in encoded.collect()}
    for k, r in rows.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[k]) // 4, hashlib.sha256(ids[k]).hexdigest(), hashlib.sha256(back[k].encode()).hexdigest())
    assert bpe.digests(docs.limit(0)).count() == 0


# Token store.


def test_elias_fano_select():
    rng = random.Random(1)
    for n in (0, 1, 5, 255, 256, 257, 3000):
        values = np.cumsum([rng.choice([0, 1, 3, 900]) for _ in range(n)]) if n else np.zeros(0, np.int64)
        index = token_store.EliasFano.of(values)
        assert (index.select(0, n) == values).all()
        assert all(index.get(k) == values[k] for k in range(0, n, 29))
        assert (index.select(n // 3, n // 2) == values[n // 3 : n // 2]).all()


def test_token_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 500)
    texts = _texts()
    ids = [5 * k for k in range(len(texts))]
    ids[3], ids[7] = ids[2], None  # a repeated and a null id
    path = scratch_path(spark, "test")
    token_store.write_store(_docs(spark, texts, ids), path)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x))
    encode = chunks.library_encoder(chunks.vocabulary_path()).encode
    expected = Counter((i, e + (2).to_bytes(4, "little")) for i, e in zip(ids, encode([t or "" for t in texts]), strict=True))
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == expected
    crc = token_store.read_store(spark, path, digest=True)
    assert Counter((r.doc_id, r.ids_crc32) for r in crc.collect()) == Counter((i, zlib.crc32(x)) for i, x in expected.elements())
    empty = scratch_path(spark, "test")
    token_store.write_store(_docs(spark, []), empty)
    assert token_store.read_store(spark, empty).count() == 0


# Substring deduplication.


def _removal(rows, history=()):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key, rank = tuple(w[k : k + 13]), -1 if i is None else i
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if first[key] < (-1 if i is None else i) or key in history:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,ranges", [(8 << 20, 1 << 16), (2000, 1 << 16), (2000, 3)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, block, ranges):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "MAX_RANGES", ranges)
    monkeypatch.setattr(substring_dedup, "BUCKET_ENTRIES", 500)
    texts = _texts()
    ids = list(range(len(texts)))
    random.Random(9).shuffle(ids)
    ids[4], ids[8] = ids[0], None  # rows with one id aren't earlier than each other
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(_docs(spark, texts, ids))[0].collect()), key=str)
    assert got == _removal(list(zip(ids, texts, strict=True)))


def test_substring_dedup_in_batches(spark):
    texts = _texts()
    one, two = texts[:30], texts[30:]
    _, runs = substring_dedup.deduplicate(_docs(spark, one))
    history = substring_dedup.compacted(runs)
    seen = {tuple(w[k : k + 13]) for t in one for w in [(t or "").encode().split()] for k in range(len(w) - 12)}
    ids = list(range(30, len(texts)))
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(_docs(spark, two, ids), history=history)[0].collect()), key=str)
    assert got == _removal(list(zip(ids, two, strict=True)), seen)
    assert substring_dedup.deduplicate(_docs(spark, []))[0].count() == 0


def test_run_index_knows_the_newest_owner():
    index = substring_dedup.RunIndex()
    keys = np.array([1, 5, 5, 9], np.uint64)
    index.add(keys, np.array([1, 1, 2, 3], np.uint16), np.array([10, 10, 10, 10]))
    index.add(np.array([5, 7], np.uint64), np.array([4, 1], np.uint16), np.array([11, 11]))
    index.add(np.array([5, 9], np.uint64), np.array([2, 3], np.uint16), np.array([12, 12]))
    asked = np.array([1, 1, 5, 5, 5, 7, 9, 10], np.uint64)
    checks = np.array([1, 2, 2, 4, 9, 1, 3, 0], np.uint16)
    assert index.owners(asked, checks).tolist() == [10, -2, 12, 11, -2, 11, 12, -2]
    gaps, low = substring_dedup.pack_sorted(np.array([0, 3, 1 << 63, (1 << 64) - 1], np.uint64))
    assert substring_dedup.unpack_sorted(gaps, low, 4).tolist() == [0, 3, 1 << 63, (1 << 64) - 1]


def _thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_made_to_collide_stay(spark):
    tail = " one two three four five six seven eight nine ten eleven twelve"
    texts = []
    for n in (1024, 2048, 4096):
        word = _thue_morse(n)
        texts += [word + tail, word.translate(str.maketrans("ab", "ba")) + tail]
    got = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(_docs(spark, texts))[0].collect()}
    assert got == {k: (13, 0) for k in range(6)}


def test_hits_are_compared_word_by_word(monkeypatch):
    """With hashes that nearly all windows share, the words alone decide: inside a block and against the words sent by another."""
    real = substring_dedup.window_hashes

    def coarse(one, two, bounds):
        at, keys, checks = real(one, two, bounds)
        return at, keys % np.uint64(3), checks * np.uint16(0)

    monkeypatch.setattr(substring_dedup, "window_hashes", coarse)
    texts = _texts()[:64]
    table = lambda own: pa.table({"id": pa.array([i for i, _ in own], pa.int64()), "text": pa.array([t for _, t in own], pa.string())})
    every = list(enumerate(texts))
    expected = {i: n for i, _, n, _ in _removal(every)}
    for cut in (0, 30):
        block = substring_dedup._Block(table(every[cut:]))
        told = [{"id": i, "text": (t or "").encode()} for i, t in every[:cut]]
        gone = substring_dedup._removal(block, told)
        got = {i: int(gone[a:b].sum()) for i, a, b in zip(block.ids.tolist(), block.bounds[:-1], block.bounds[1:], strict=True)}
        assert got == {i: expected[i] for i in got} and sum(got.values()) > 0


def test_null_and_repeated_ids_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 800)
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"{passage} n{k}" * (1 + k % 3)) for k in range(30)] + [(k, f"own{k} {passage}") for k in range(10)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, turn string")
    assert substring_dedup.dealt(docs)[0].filter("id is null").select("block").distinct().count() > 1
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs)[0].collect()), key=str)
    assert got == _removal(rows)


# Pages.

PAGE = '<html><head><title>T x</title><style>p{a}</style><script>var t="</p>words words words";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>More</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is cheap</div><article><h1>Title</h1><p>Para&nbsp;one\n &amp; two <a href=x>link</a> words.<p><b>Second para<br><aside>see also</aside><p>Last.</p><section class="comments"><p>First! great</p></section></article><form><input></form><footer>&copy; 2020 someone</footer></body></html>'
TEXT = "Title\nPara one & two link words.\nSecond para\nLast."


def test_extraction(spark):
    rows = [(k, f"u{k}", PAGE) for k in range(30)] + [(30, None, None), (31, "e", ""), (32, "n", "no markup at all"), (None, "x", PAGE), (33, "s", "<p>only <script>unclosed"), (34, "l", "<p>" + "word " * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html_extract.train(pages)
    got = html_extract.extract(pages, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == TEXT and by[0].n_chars == len(TEXT) and by[None].text == TEXT
    assert by[30].text == by[31].text == "" and by[32].text == "no markup at all" and by[33].text == "only"
    assert by[34].n_chars == 5 * 30_000 - 1
    assert html_extract.Model().extract(PAGE.replace("article", "div")) in (TEXT, TEXT.removesuffix("\nLast."))
    clashing = html_extract.extract(pages.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1)).union(pages.selectExpr("*", "'y'", "2")), model).collect()
    assert Counter((r.page_id, r.text) for r in clashing) == Counter({(r.page_id, r.text): 2 * n for r, n in Counter(got).items()})
    nothing = html_extract.train(pages.limit(0))
    assert nothing.weights == html_extract.Model().weights and html_extract.extract(pages.limit(0), nothing).count() == 0


def test_wrappers_and_sections_with_boilerplate_names_keep_the_article():
    body = "<h1>A title of five words</h1><p>" + "word " * 30 + "</p><section id='related-work'><p>Earlier work on it</p></section><p>The last words of the article itself.</p><div class='comments'><p>First!</p></div>"
    text = "A title of five words\n" + " ".join(["word"] * 30) + "\nEarlier work on it\nThe last words of the article itself."
    menu = "<div class='menu'><p>Home More</p></div>"
    for page in (f"<div class='site no-sidebar'>{menu}<article>{body}</article>{menu}</div>", f"<div class='content-sidebar-wrap'><div id='page-search'><main>{body}</main></div>{menu}</div>", f"<div class='login'><div itemprop='articleBody'>{body}</div></div>"):
        assert html_extract.Model().extract(page) == text
    assert html_extract.Model().extract(f"<nav><article>{body}</article></nav>") == ""
    assert html_extract.Model().extract("<div id='comments'><article class='comment'>First!</article></div>") == ""


def test_names_of_two_minds_keep_their_section():
    for name in ("side effects", "notice period", "related-work"):
        page = f"<nav>Home</nav><article><h1>Title</h1><p>One two.</p><section class='{name}'><p>Three four.</p></section><div class='ad box-3'>Buy</div><p>Five.</p></article><footer>x</footer>"
        assert html_extract.Model().extract(page) == "Title\nOne two.\nThree four.\nFive."


def test_weights_come_from_labelled_pages():
    """A name that no list has is left out inside an article once labelled pages have it outside only; other unknown names stay."""
    labelled = "<div class='zorp'>Buy one thing now</div><article><h1>A title</h1><div class='lead'>Words of a lead</div><p>And a text</p></article><div class='zorp'>Buy another</div>"
    found = {}
    for _ in range(30):
        for (kind, inside), n in html_extract.counts(labelled).items():
            found.setdefault(kind, [0, 0])[0 if inside else 1] += n
    learnt = html_extract.weighted(found)
    page = "<article><p>One two three.</p><div class='zorp'>Buy a third</div><div class='other'>Four five.</div></article>"
    assert learnt.extract(page) == "One two three.\nFour five."
    assert html_extract.Model().extract(page) == "One two three.\nBuy a third\nFour five."
    assert learnt.weights["name lead"] > 2 > -2 > learnt.weights["name zorp"]


def test_pages_without_an_article(spark):
    """The scan alone finds the content where nothing names it: the pages of the table with article turned into div, by weights learnt from others."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.train(pages)
    for r in pages.collect():
        assert model.extract(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == model.extract(r.html) != ""


def test_region_is_the_best_run(spark):
    rng = random.Random(4)
    rows = [[rng.choice([-3, -1, -0.1, 0, 1, 2.5]) for _ in range(14)] for _ in range(200)]
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    model = html_extract.Model()
    rows += [model.scores(html_extract.items(x.replace("article", "div")))[0] for x in pages]
    for scores in rows:
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        best = max(0.0, float((sums[None, :] - np.minimum.accumulate(sums)[None, :]).max()))
        a, b = html_extract.region(scores)
        assert sum(scores[a:b]) == pytest.approx(best)


# Exact duplicates.


@pytest.mark.parametrize("size", [7, 16384])
def test_exact_groups(spark, size):
    texts = _texts()[:-1] + ["long " * 300, "long " * 300, "long " * 299]
    ids = list(range(len(texts)))[::-1]
    ids[2], ids[6] = ids[1], None
    got = exact_dedup.exact_groups(_docs(spark, texts, ids), size=size).collect()
    norm = ["".join(x if x not in " \t\n\v\f\r" else " " for x in t or "") for t in texts]
    norm = [__import__("re").sub("[\\x20\\x09-\\x0D]+", " ", t or "") for t in texts]
    group = {}
    for i, t in zip(ids, norm, strict=True):
        group.setdefault(t, []).append(i)
    least = {t: min((x for x in g if x is not None), default=None) for t, g in group.items()}
    expected = Counter((i, least[t], len(group[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm, strict=True))
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(group)


def test_exact_kept(spark):
    docs = _docs(spark, ["a b", "a  b", "c", None, ""], [4, 2, 9, 7, 8])
    assert sorted(r.doc_id for r in exact_dedup.kept(docs).collect()) == [2, 7, 9]
    assert exact_dedup.kept(docs).columns == docs.columns
    assert exact_dedup.kept(docs.limit(0)).count() == 0


def test_blocks_that_share_a_digest_are_told_apart(spark, monkeypatch):
    """With one digest for all blocks, rows join on the blocks themselves and the groups stay the same."""
    docs = _docs(spark, [*_texts()[:20], *_texts()[:5], "long " * 30])
    rows = lambda: Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, size=7).collect())
    expected = rows()
    monkeypatch.setattr(exact_dedup, "_digest", lambda block: [F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")])
    assert rows() == expected


def test_the_two_hashes_of_a_block_are_independent(spark):
    one, two = spark.range(1).select(*exact_dedup._digest(F.lit("some block"))).first()
    assert two != spark.range(1).select(F.xxhash64(F.lit("some block"), F.lit(7))).first()[0] and one != two


# Near duplicates.


def _fingerprint(text):
    words = (text or "").encode().lower().split() if (text or "").isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_simhash_components(spark):
    texts = _texts()
    ids = [3 * k for k in range(len(texts))]
    random.Random(3).shuffle(ids)
    ids[5] = None
    got = simhash.near_duplicates(_docs(spark, texts, ids)).collect()
    prints = [_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    least = {r: min((ids[k] for k in range(len(texts)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    expected = Counter((ids[k], prints[k] - (1 << 64) if prints[k] >> 63 else prints[k], least[root[k]]) for k in range(len(texts)))
    assert Counter((r.id, r.fp, r.component) for r in got) == expected
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_ball_links_are_complete(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    for x in signed:
        for y in signed:
            if x != y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                assert roots[x] == roots[y]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(7, 7), (3000, 3001), (3001, 3000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)} | {3000: 3000, 3001: 3000}


# Models.


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, quality.fold(F.col("id"), 4) != 2)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(quality.fold(F.col("doc_id"), 4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    odd = _docs(spark, [None, "", "123 !?", "the of and thth", "the " * 300_000, "中文字"])
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred == got[4].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id for r in language.kept(odd, model).collect()) == [3, 4]
    nothing = language.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_language_drops_texts_in_no_learnt_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, F.lit(True))
    rng = random.Random(6)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    strange = [finnish, polish, finnish * 50, *(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40)) for _ in range(40))]
    own = [r.text for r in docs.limit(50).collect()]
    assert (model.predict(strange)[1] >= 0.5).sum() > 30
    assert sorted(r.doc_id for r in language.kept(_docs(spark, strange + own), model).collect() if r.doc_id < len(strange)) == []
    assert language.kept(docs, model).count() == language.kept(docs, model, least_known=0.0).count()


def test_unspaced_scripts_are_known_by_character(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("天地玄黄宇宙洪荒", "zh"), ("some plain words", "en")] * 3)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert model.known_share(["黄天宇地", "plain words", "other stuff", ""], ["zh", "en", "en", "und"]).tolist() == [1, 1, 0, 0]


def test_every_language_is_learnt(spark):
    docs = spark.createDataFrame([(k, chr(0x4E00 + k) * 3, f"l{k:03}") for k in range(260)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert model.predict([chr(0x4E00 + k) * 3 for k in range(260)])[0] == [f"l{k:03}" for k in range(260)]


def test_language_backs_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("aaba abab", "x"), ("zzyz yzyz", "y")] * 5)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert model.predict(["ababab", "zyzyzy", "a", "y"])[0] == ["x", "y", "x", "y"]


def test_scores_do_not_depend_on_the_batch(spark):
    texts = [t or "" for t in _texts()[:-1]] * 3
    data = [t.encode() for t in texts]
    model = quality.Model(np.random.default_rng(1).standard_normal(1 << 12).astype(np.float32), 0.1)
    assert model.scores(data).tolist() == [float(model.scores([x])[0]) for x in data]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoken = language.train(docs, F.lit(True))
    assert spoken.log_scores(texts)[0].tolist() == [spoken.log_scores([x])[0][0].tolist() for x in texts]


def test_language_equals_a_plain_version(spark):
    """Backoff word by word in plain Python, over every document and odd texts, a word above a slice included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text.lower()) for r in docs.collect() if r.lang and r.text]
    model = language.train(docs, F.lit(True), max_rows=10**9)
    langs = sorted({x for x, _ in rows})
    split = lambda t: "".join(c if c.isalpha() else " " for c in t).split(" ")
    tables = [{x: Counter() for x in langs} for _ in range(5)]
    for lang, text in rows:
        for w in filter(None, split(text)):
            tables[0][lang][w] += 1
            for n in range(1, 5):
                tables[n][lang].update(w[k : k + n] for k in range(len(w) - n + 1))
    sizes = [len(set().union(*(t[x] for x in langs))) for t in tables]
    sums = [{x: sum(t[x].values()) for x in langs} for t in tables]

    def logs(kind, entry):
        return [np.log((tables[kind][x][entry] + 0.5) / (sums[kind][x] + 0.5 * sizes[kind])) for x in langs] if any(entry in tables[kind][x] for x in langs) else None

    def plain(text):
        total = np.zeros(len(langs))
        for w in filter(None, split(text.lower())):
            found = [logs(0, w)]
            for n in (4, 3, 2, 1):
                if any(x is not None for x in found):
                    break
                found = [logs(n, w[k : k + n]) for k in range(len(w) - n + 1)]
            found = [x for x in found if x is not None]
            total += np.mean(found, axis=0) if found else 0
        return total

    texts = [t for _, t in rows[:60]] + ["", "123", "unheardof wörd theth", "中文", "ab" * 600_000 + " the of"]
    got, _ = model.log_scores(texts)
    for t, g in zip(texts, got, strict=True):
        assert g == pytest.approx(plain(t), rel=1e-4, abs=1e-6)


def test_quality_fit_equals_a_plain_version():
    """Follow-the-regularised-leader, feature by feature, on few cases; repeated and tied rows included."""
    texts = [b"good words here", b"bad bad words", b"good good", b"", b"bad words", b"good words here"]
    labels = [1, 0, 1, 0, 0, 1]
    numbers, bounds = quality.features(texts, 10)
    cases = [Counter(numbers[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    packed = [(np.array([sorted(c), [c[k] for k in sorted(c)]], "<i4").tobytes(), y) for c, y in zip(cases, labels, strict=True)]
    model = quality.fit(packed, bits=10, epochs=2)
    z, n = Counter(), Counter()
    w = lambda k: 0.0 if abs(z[k]) <= 0.02 else -(z[k] - np.sign(z[k]) * 0.02) / ((1 + n[k] ** 0.5) / 0.5 + 0.5)
    for _ in range(2):
        for c, y in zip(cases, labels, strict=True):
            x = {k: v / max(1, sum(c.values())) ** 0.5 for k, v in c.items()} | {"bias": 1.0}
            now = {k: w(k) for k in x}
            p = 1 / (1 + np.exp(-sum(now[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.5 * now[k]
                n[k] += g * g
    for text, c, score in zip(texts, cases, model.scores(texts), strict=True):
        plain = w("bias") + sum(w(k) * v for k, v in c.items()) / max(1, sum(c.values())) ** 0.5
        assert score == pytest.approx(1 / (1 + np.exp(-plain)), rel=1e-5)


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, quality.fold(F.col("doc_id"), 5) != 0)
    rows = quality.score(docs, model).join(labels, "doc_id").filter(quality.fold(F.col("doc_id"), 5) == 0).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    odd = quality.score(_docs(spark, [None, "", "x", "word " * 200_000]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert quality.train(docs, labels.limit(0), F.lit(True)).scores([b"a b"])[0] == 0.5


# Vectors.


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 8))
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    rows += [(1500 + k, vectors[40].tolist(), "x") for k in range(60)]  # a hot vector
    rows += [(2000, None, "x"), (2001, [0.0] * 8, "x"), (2002, [float("nan")] * 8, "x"), (2003, [None] + [1.0] * 7, "x"), (2004, [1.0], "x"), (2005, [float("inf")] + [1.0] * 7, "x"), (20, vectors[20].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = {}
    for r in ann.search(table, table.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    every = {k: np.array(v) for k, v, _ in rows[:1560]}
    ids, matrix = np.array(list(every)), np.array(list(every.values()))
    assert set(got) == {k for k in every if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = np.zeros(len(matrix))
        for j in range(8):
            scores += matrix[:, j] * every[q][j]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        hits += len(set(order) & {x for _, x, _ in found})
        assert [x for x, _, _ in found] == list(range(1, 21))
        assert [(-s, x) for _, x, s in found] == sorted((-s, x) for _, x, s in found)
        assert all(s == scores[np.flatnonzero(ids == x)[0]] for _, x, s in found)
    assert hits / (20 * len(got)) > 0.9
    few = ann.search(table.filter("vec_id < 5"), table.filter("vec_id < 5")).collect()
    assert len(few) == 20 and ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_prunes_most_candidates(spark):
    """50,000 vectors without clusters, whose spectrum falls as that of embeddings does: recall against brute force, and the share of vectors that a query is compared with."""
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((50_000, 64)) / np.sqrt(1 + np.arange(64) / 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    columns = {"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 64).cast(pa.list_(pa.float32()))}
    table = spark.createDataFrame(pa.table(columns))
    got, compared = {}, {}
    for r in ann.search(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        compared[r.query_id] = r.compared
    queries = np.arange(0, 50_000, 100)
    scores = vectors[queries].astype(np.float64) @ vectors.astype(np.float64).T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    recall = np.mean([len(got[q] & set(b.tolist())) / 20 for q, b in zip(queries.tolist(), best, strict=True)])
    share = np.mean([compared[q] for q in queries.tolist()]) / 50_000
    print(f"recall {recall:.3f}, share compared {share:.3f}")
    assert recall >= 0.9 and share < 0.2 and all(len(x) == 20 for x in got.values())


def test_a_walk_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    sample = rng.standard_normal((3000, 6))
    lists = ann.Centroids.fit(sample, 1200, float(np.sqrt((sample * sample).sum(axis=1).max())))
    queries = ann.flat(rng.standard_normal((200, 6)), lists.top)
    near, value = lists.walk(queries, 40)  # an eighth of the graph is more
    every = ann._squares(queries, lists.centres)
    best = np.argsort(every, axis=1)[:, :40]
    assert np.mean([len(set(a) & set(b)) / 40 for a, b in zip(near.tolist(), best.tolist(), strict=True)]) > 0.99
    assert (np.diff(value, axis=1) >= 0).all()
    sizes = np.ones(len(lists.centres), np.int64)
    assert all(len(x) == 300 for x in lists.within(queries, 0.0, sizes, 300))


# Mixing.


def _raked(cells, names, targets, share, rounds):
    """The fit under the bound in plain Python: cell -> weight."""
    most = {c: t / share for c, t in cells.items()}
    fit = {c: min(float(t), most[c]) for c, t in cells.items()}
    for _ in range(rounds):
        for k, name in enumerate(names):
            for value in {c[k] for c in cells}:
                own, aim = [c for c in cells if c[k] == value], targets[name][value]
                free = [c for c in own if fit[c] < most[c]]
                factor = (aim - sum(most[c] for c in own if c not in free)) / max(1e-300, sum(fit[c] for c in free))
                fit |= {c: min(most[c], fit[c] * factor) for c in free} if aim >= sum(fit[c] for c in own) else {c: fit[c] * aim / sum(fit[x] for x in own) for c in own}
    return fit


def _met(cells, k, aims, share):
    """Targets of a marginal of which none is above what its value can give; what is cut goes to the others in proportion."""
    most = {v: sum(t for c, t in cells.items() if c[k] == v) / share for v in aims}
    whole, full = sum(aims.values()), set()
    while True:
        left = whole - sum(most[v] for v in full)
        rest = sum(aims[v] for v in aims if v not in full)
        out = {v: most[v] if v in full else left * aims[v] / rest for v in aims}
        if not (over := {v for v in aims if out[v] > most[v] * (1 + 1e-12)}):
            return out
        full |= over


SIZES = {("a", "en", "long"): 9000, ("a", "en", "short"): 300, ("a", "de", "long"): 900, ("b", "en", "long"): 400, ("b", "de", "short"): 60, ("b", "de", "long"): 3000, ("c", "de", "short"): 40, ("c", "en", "long"): 10}


@pytest.mark.parametrize("given", [{}, {"source": {"a": 0.5, "b": 0.45, "c": 0.05}, "lang": {"de": 0.6}}])
def test_expected_sample_has_the_marginals(spark, given):
    """All three marginals of the expected sample, under targets from temperatures and under given ones, against a plain fit."""
    docs = spark.createDataFrame([(*k, n) for k, n in SIZES.items()], "source string, lang string, topic string, tokens long")
    cells = mixing.probabilities(docs, given=given, rounds=60).collect()
    names, whole = list(mixing.TEMPERATURES), sum(SIZES.values())
    aims = {}
    for k, name in enumerate(names):
        power = {}
        for c, n in SIZES.items():
            power[c[k]] = power.get(c[k], 0) + n
        power = {v: n ** mixing.TEMPERATURES[name] for v, n in power.items()}
        own = given.get(name, {})
        rest, free = 1 - sum(own.values()), sum(p for v, p in power.items() if v not in own)
        raw = {v: whole * (own[v] if v in own else rest * p / free) for v, p in power.items()}
        assert {r[name]: r[f"target_{name}"] for r in cells} == pytest.approx(raw)
        aims[name] = _met(SIZES, k, raw, mixing.SHARE)
    plain = _raked(SIZES, names, aims, mixing.SHARE, 60)
    for r in cells:
        key = tuple(r[n] for n in names)
        assert r.keep_prob == pytest.approx(min(1, mixing.SHARE * plain[key] / SIZES[key]), rel=1e-4)
    for k, name in enumerate(names):
        for v, aim in aims[name].items():
            assert sum(r.keep_prob * r.tokens for r in cells if r[name] == v) == pytest.approx(mixing.SHARE * aim, rel=0.005)
    worst = mixing.deviations(spark.createDataFrame(cells), names).collect()
    assert {r.marginal for r in worst} == set(names) and all(r.off < 0.01 for r in worst)


def test_targets_are_checked():
    for given in ({"colour": {"red": 1.0}}, {"lang": {"en": 0.7, "de": 0.4}}, {"lang": {"en": -0.1}}):
        with pytest.raises(ValueError):
            mixing.checked(given, mixing.TEMPERATURES)


def test_mixed_rows_and_sql(spark):
    """Null marginals, cells without tokens, repeated and null ids: every row has a probability, and SQL gives the same rows."""
    import duckdb

    docs = _docs(spark, ["w " * (5 * k) for k in range(60)] + [None, "", "", "a b"], [*range(60), 7, None, 61, 61])
    rows = mixing.op9_rows(docs).collect()
    assert len(rows) == 64 and all(0 <= r.keep_prob <= 1 for r in rows)
    documents = docs.toPandas()  # noqa: F841  read by name
    found = duckdb.sql(mixing.op9_sql()).fetchall()
    names = ["doc_id", "source", "lang", "topic", "n_tokens", "keep_prob", "kept"]
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter((None if d is None or d != d else int(d), *x) for d, *x in found)
    assert mixing.kept(docs).columns == docs.columns and mixing.kept(docs.limit(0)).count() == 0


# Pipeline and queries.


def _near(rows, size=5, similarity=0.8):
    """id -> smallest id that links of the similarity reach, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                old, new = sorted((root[rows[a][0]], root[rows[b][0]]), reverse=True)
                root = {i: new if x == old else x for i, x in root.items()}
    return root


def test_near_copies_equal_brute_force(spark):
    """Near copies at many similarities, copies, short and empty texts, clashing columns; null and repeated ids."""
    rng = random.Random(12)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 30, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 20])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += [None, "", " ", "one", "One"]
    ids = rng.sample(range(1000), len(rows))
    docs = _docs(spark, [*rows, "null id", "two", rows[3]], [*ids, None, ids[0], ids[3]])
    got = Counter((r.id, r.component) for r in simhash.near_copies(docs).collect())
    least = _near(list(zip(ids, rows, strict=True)))
    assert got == Counter(least.items()) + Counter([(ids[0], ids[0]), (ids[3], least[ids[3]])])
    assert any(v != k for k, v in least.items())
    stay = sorted(str(r.doc_id) for r in simhash.kept(docs).collect())
    again = [i for i in (ids[0], ids[3]) if i == ids[0] or least[i] == i]
    first = {i for i in ids if least[i] == i} | {ids[0]}
    assert stay == sorted([*map(str, first), *map(str, again), "None"])
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.kept(docs).columns == docs.columns


def test_near_copies_miss_no_pair_at_the_threshold(spark):
    """Pairs of 40 common shingles and 5 of their own on each side: 0.8, where two of 1000 pairs share no band."""
    texts = []
    for g in range(1500):
        base = " ".join(f"g{g}w{k}" for k in range(44))
        texts += [base + "".join(f" g{g}{side}{k}" for k in range(5)) for side in "ab"]
    docs = _docs(spark, texts)
    got = {r.id: r.component for r in simhash.near_copies(docs).collect()}
    assert [i for i in range(len(texts)) if got[i] != i - i % 2] == []


def test_apart_pairs_all_but_one_root(spark):
    """Every pair of sets that reaches the similarity and has two roots, against all pairs; none within a root."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.choice([6, 20, 60]))]
        texts += [" ".join([*base, *(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3])))]) for _ in range(6)]
    sets = [set(simhash._shingles(t, 5).tolist()) for t in texts]
    rows = [(k, k % 3, simhash._signature(np.array(sorted(s), np.uint64)), t) for k, (s, t) in enumerate(zip(sets, texts, strict=True))]
    table = spark.createDataFrame(rows, "c long, root long, sig binary, text string")
    ranks = simhash._ranks(table, 5)
    assert ranks.sum() == sum(map(len, sets))
    got = {(r.a, r.b) for r in simhash.apart(simhash.prefixes(table, ranks, 5, 0.8), 0.8).collect()}
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if a % 3 != b % 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike and alike <= got and all(a % 3 != b % 3 for a, b in got)


def test_no_pair_is_lost_in_the_second_order(spark, monkeypatch):
    """Classes that cannot reach the similarity go, and pairs are sought at the rarest shingles: against all pairs, with exact and with coarse counts."""
    for bits in (18, 7, 2):
        monkeypatch.setattr(simhash, "COUNT_BITS", bits)
        rng = random.Random(bits)
        texts = []
        for _ in range(30):
            base = [f"v{rng.randrange(90)}" for _ in range(rng.choice([3, 6, 20, 60, 200]))]
            for _ in range(5):
                own = [w if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for w in base]
                texts.append(" ".join([*own, *(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 1, 3, len(base) // 5])))]))
        texts += [" ".join(f"s{g}w{k}" for k in range(200)) for g in range(40)]
        texts = list(dict.fromkeys(texts))
        sets = [set(simhash._shingles(t, 5).tolist()) for t in texts]
        rows = [(k, k % 7, simhash._signature(np.array(sorted(s), np.uint64)), t) for k, (s, t) in enumerate(zip(sets, texts, strict=True))]
        table = spark.createDataFrame(rows, "c long, root long, sig binary, text string")
        tokens = simhash.prefixes(table, simhash._ranks(table, 5), 5, 0.8)
        roots = tokens.groupBy("token").agg(F.count_distinct("root").alias("roots")).filter("roots > 1")
        left = simhash.able(tokens.join(roots, "token", "left_semi"), 0.8)
        found = {r.c: r.n for r in left.collect()}
        first = simhash.rarest(simhash.whole_sets(table.join(left, "c"), 5), left, 0.8)
        got = {(r.a, r.b) for r in simhash.apart(first, 0.8).collect()}
        alike = {(a, b) for b in range(len(sets)) for a in range(b) if a % 7 != b % 7 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert len(alike) > 20 and alike <= got and {x for p in alike for x in p} <= set(found)
        assert all(n == len(sets[c]) for c, n in found.items()) and not any(texts[c].startswith("s") for c in found)


def test_a_shared_passage_gives_no_pairs(spark, monkeypatch):
    """Texts that share a passage but little else are not paired, also when a count stands for as many shingles as in a large table."""
    monkeypatch.setattr(simhash, "COUNT_BITS", 2)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [" ".join(f"t{g}w{k}" for k in range(70)) + " " + passage for g in range(100)]
    texts += [t + " more" for t in texts[:5]]
    sought, apart = [], simhash.apart
    monkeypatch.setattr(simhash, "apart", lambda *x: sought.append(apart(*x)) or sought[-1])
    monkeypatch.setattr(simhash, "settled", lambda df, name, *used: written(df, name))
    got = {r.id: r.component for r in simhash.near_copies(_docs(spark, texts)).collect()}
    assert got == {i: i if i < 100 else i - 100 for i in range(105)}
    assert sought[0].count() <= 5


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, F.lit(True))
    rows = docs.collect()
    named, scores = model.predict([r.text or "" for r in rows])
    rows = [r for r, n, s in zip(rows, named, scores, strict=True) if n != "und" and s >= 0.5]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(__import__("re").sub("[\\x20\\x09-\\x0D]+", " ", r.text or ""), r)
    rows = list(first.values())
    least = _near([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    left = spark.createDataFrame(rows, docs.schema)
    drawn = {r.doc_id for r in mixing.mixed(left).filter("__kept").collect()}
    assert {r.doc_id for r in out} == drawn
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "bpe"]


def test_stages_take_odd_tables(spark):
    for texts in ([], [None, "", "the the of and", "the the of and"]):
        docs = _docs(spark, texts)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
