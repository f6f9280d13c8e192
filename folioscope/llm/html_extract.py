"""Main text of web pages: the maximum-scoring run of words (positive) and tags (negative)."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.runtime import small_batches

#: Pages that weights are learnt from at most: those with the smallest hash of their id.
MAX_TRAINING_PAGES = 500
#: Pages that a listed name counts as seen, all outside the content (strong ones and weak ones), and a content element as its own.
STRONG, WEAK = 20, 1
#: Weight of a name that no labelled page has, where the element has other names.
UNSEEN = 1.5
#: From this weight on a container is the content.
CONTENT_FROM = 2.0

# Elements by their role in HTML.
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|audio|video|textarea|select|button"
CONTENT = {"article", "main"}
BOILERPLATE = {"nav", "aside", "footer", "form", "dialog", "menu", "head", "title"}
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set("article aside body details dialog div figure footer form head header main menu nav section table title".split())
#: Names of classes and ids before any page is seen: what labelling takes for no content inside an article, and where weights start from.
STRONG_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "popup", "modal", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "social", "comment", "comments", "replies", "disqus", "newsletter", "subscribe", "signup", "footer", "masthead", "topbar", "toolbar", "pagination"}
WEAK_NAMES = {"consent", "notice", "notices", "side", "related", "recommended", "login", "search"}
#: Names that say nothing.
PLAIN_NAMES = {"area", "block", "box", "col", "container", "content", "group", "inner", "item", "items", "list", "page", "row", "section", "site", "widget", "widgets", "wrap", "wrapper"}
_NAME = re.compile(r"[^\W\d_]+")

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<text>[^<]+|<)""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(?P<key>class|id|role|itemprop)\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+))""", re.IGNORECASE)
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


@dataclass
class Item:
    """A tag, or the text between two tags, with what a weight can belong to."""

    name: str  # of the tag; of a text the link or block that it is in
    words: int = 0  # 0 for a tag
    text: str = ""
    breaks: bool = False
    around: tuple[tuple[str, tuple[str, ...]], ...] = ()  # open containers, outermost first: element and its names
    named: bool = False  # inside an element that names itself the content


def _names(rest: str) -> tuple[str, ...]:
    """Names in class, id, role and itemprop, each once, without those that say nothing."""
    if "=" not in rest:
        return ()
    marks = " ".join(a["a"] or a["b"] or a["c"] or "" for a in _ATTRIBUTE.finditer(rest)).lower()
    return tuple(x for x in dict.fromkeys(_NAME.findall(marks)) if x not in PLAIN_NAMES)


def items(page: str) -> list[Item]:
    """The page as a row of tags and texts; scripts, styles and markup comments are left out."""
    out: list[Item] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    kinds: list[str] = []
    around: tuple = ()
    named = False
    block, links = "", 0
    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            n = len(html.unescape(text).split())
            out.append(Item("a" if links else block, n, text, False, around, named))
            continue
        if m["name"] is None:
            continue  # a script, style or comment breaks no block
        name, closing = m["name"].lower(), bool(m["close"])
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCKS and name != "br":
            block, links = "" if closing else name, 0
        if name in CONTAINERS and not closing and not m["rest"].endswith("/"):
            names = _names(m["rest"]) if name != "body" else ()
            stack.append((name, names))
            kinds.append(name)
            around = tuple(stack)
            named = named or name in CONTENT or "articlebody" in names
        out.append(Item(name, 0, "", name in BLOCKS, around, named))
        if closing and name in CONTAINERS:
            for k in range(len(kinds) - 1, -1, -1):
                if kinds[k] == name:
                    del stack[k:], kinds[k:]
                    around = tuple(stack)
                    named = any(x in CONTENT or "articlebody" in names for x, names in stack)
                    break
                if kinds[k] in CONTENT | {"body"} and name not in CONTENT | {"body"}:
                    break  # a stray end tag doesn't close the article
    return out


def _odds(inside: float, outside: float) -> float:
    return math.log((inside + 0.5) / (outside + 0.5))


def start_counts() -> dict[str, list[float]]:
    """(pages inside, pages outside) of each kind before any page is seen."""
    out = {f"element {x}": [0.0, STRONG] for x in BOILERPLATE} | {f"element {x}": [STRONG, 0.0] for x in CONTENT} | {"name articlebody": [STRONG, 0.0]}
    out |= {f"name {x}": [0.0, STRONG] for x in STRONG_NAMES} | {f"name {x}": [0.0, WEAK] for x in WEAK_NAMES}
    return out | {"text p": [2.0, 0.0], "text a": [0.0, 1.0]}


@dataclass
class Model:
    """Log odds of each kind (element, name of a class or id, tag, text of a tag) to lie in the content; kinds that weren't seen have none."""

    weights: dict[str, float] = field(default_factory=lambda: {k: _odds(*x) for k, x in start_counts().items()})
    containers: dict = field(default_factory=dict, repr=False)

    def container(self, element: str, names: tuple[str, ...], inside: bool) -> float:
        """Weight of a container: of its names, if it has some that are known, and of its element. A header within the content holds its title."""
        known = [self.weights.get(f"name {x}") for x in names]
        own = 0.0
        if any(x is not None for x in known):
            own = sum(max(-3.7, min(3.7, UNSEEN if x is None else x)) for x in known) / len(known)
        if element == "header" and not inside:
            return -3.0
        plain = self.weights.get(f"element {element}", 0.0)
        # Only what is a role in itself counts beside names: a div is what its names say.
        if abs(plain) < CONTENT_FROM or element not in CONTENT | BOILERPLATE and names:
            return own
        return plain + min(0.0, own) if plain > 0 else min(plain, own)

    def standing(self, around: tuple) -> tuple[float, bool]:
        """(least weight of the containers from the innermost content outwards-in, whether there is a content) of a text's containers."""
        known = self.containers.get(around)
        if known is None:
            if not around:
                return 0.0, False
            least, inside = self.standing(around[:-1])
            value = self.container(*around[-1], inside)
            # The names of a wrapper say little about the article inside it; a menu or a footer has none.
            if value >= CONTENT_FROM and (inside or not any(x in BOILERPLATE for x, _ in around)):
                known = (least, True) if inside else (0.0, True)
            else:
                known = (min(least, value), inside)
            if len(self.containers) > 100_000:
                self.containers.clear()
            self.containers[around] = known
        return known

    def scores(self, page: list[Item]) -> tuple[list[float], list[bool]]:
        """(score, whether it is left out by itself) of each item. Words of content are 1 each, others 0 to -1; a tag is below 0.

        Where the page has a content container, words outside it count against a run. Elsewhere a word counts by
        the tag that it is in. What is no content inside the content counts 0: it is left out and doesn't part it.
        """
        where = [self.standing(x.around) for x in page]
        has = any(inside and least >= 0 and x.words for x, (least, inside) in zip(page, where, strict=True))
        scores, out = [], []
        for x, (least, inside) in zip(page, where, strict=True):
            dropped = least < 0
            if not x.text:
                value = 0.0 if inside else max(-1.0, min(-0.01, self.weights.get(f"tag {x.name}", -0.1)))
            elif inside:
                value = 0.0 if dropped else x.words
            elif dropped or has:
                value = -x.words
            else:
                value = x.words * max(-1.0, min(1.0, self.weights.get(f"text {x.name}", 0.3)))
            scores.append(value)
            out.append(dropped)
        return scores, out

    def extract(self, page: str) -> str:
        """The blocks of the best region, joined by a line end; elements inside it whose weight is below 0 are left out."""
        parts = items(page)
        scores, dropped = self.scores(parts)
        begin, end = region(scores)
        blocks, now = [], []
        for k in range(begin, end):
            item = parts[k]
            if item.breaks:
                blocks.append(now)
                now = []
            elif item.text and not dropped[k]:
                now.append(item.text)
        blocks.append(now)
        lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
        return "\n".join(x for x in lines if x)


def region(scores: list[float]) -> tuple[int, int]:
    """The first of the shortest contiguous runs with the largest sum, by one scan; empty if no sum is above 0."""
    best, best_sum, start, total = (0, 0), 0.0, 0, 0.0
    for k, value in enumerate(scores):
        if total <= 0:
            start, total = k, 0.0
        total += value
        if total > best_sum:
            best, best_sum = (start, k + 1), total
    return best


def counts(page: str) -> Counter:
    """(kind, inside the content or not) of a page that labels its content itself, once a page; nothing of any other page.

    Inside the content an element counts as outside if all its names are listed ones.
    """
    parts = items(page)
    out: set[tuple[str, bool]] = set()
    if any(x.named for x in parts):
        listed = STRONG_NAMES | WEAK_NAMES
        for x in parts:
            own = x.named and not any(e in BOILERPLATE or names and listed.issuperset(names) for e, names in x.around)
            if not x.text:
                out.add((f"tag {x.name}", own))
            elif x.words:
                # The innermost container answers for the text: its names, or else its element.
                element, names = x.around[-1] if x.around else ("", ())
                out |= {(f"name {y}", own) for y in names} if names else {(f"element {element}", own)} if element else set()
                if not names or x.name != element:
                    out.add((f"text {x.name}", own))
    return Counter(out)


def weighted(found: dict[str, tuple[int, int]]) -> Model:
    """Log odds of the pages that have a kind inside and outside the content, added to what is known before."""
    total = start_counts()
    for kind, (inside, outside) in found.items():
        now = total.setdefault(kind, [0.0, 0.0])
        now[0] += inside
        now[1] += outside
    return Model({k: _odds(*x) for k, x in total.items()})


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_TRAINING_PAGES) -> Model:
    """Learn from at most max_pages pages which mark their content by an article, a main element or itemprop=articleBody.

    The sample has the smallest hashes of the ids; of rows with one id all count. Null ids aren't learnt from. Without a
    labelled page the start counts hold. The kinds of the sample's pages, each with two numbers, come to the driver.
    """
    small_batches(pages.sparkSession)
    # max_pages rows of one number.
    chosen = pages.select(F.col(id_col).alias("__id")).filter("__id is not null").orderBy(F.xxhash64("__id"), "__id").limit(max_pages)
    rows = pages.join(F.broadcast(chosen), pages[id_col] == chosen["__id"], "left_semi").select(F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(counts(x or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    summed = rows.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind")
    by = summed.agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    return weighted({x["kind"]: (x["i"], x["o"]) for x in by.collect()})


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null and empty pages have the empty text.

    Rows are judged each by itself: repeated and null ids stay rows. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
