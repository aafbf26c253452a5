"""Evaluation items that leak into a corpus, whole or for the larger part.

Items and documents are compared as word sequences, without case, punctuation, markup or escapes. An item is split
into more pieces than the errors it may have, which at half of its words are the words themselves. A document that
holds as many of them as are left by the errors, and in order, is measured against the item with Myers' bit-parallel
edit distance over words: each stretch of it, and the passages around exact pieces put together.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize

#: Words of an exact piece; share of an item that must be held; words of context at a passage; greatest gap within one.
PIECE, HELD, CONTEXT, GAP = 3, 0.5, 3, 12
#: Share of an item's own words that must be held; texts, and share of all texts, from which on a pair of words is stock.
OWN, MANY, MANY_SHARE = 1 / 3, 6, 0.025
#: Items searched for in one pass over the corpus (the driver reads and sends the items of one pass at a time; by hash, so about as many).
ITEMS_PER_PASS = 20_000
_ESCAPE = re.compile(r"\\+(?:u[0-9a-fA-F]{4}|[nrtbf\"'/\\])|<[^<>\n]{1,80}>|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")


def _plain(m: re.Match) -> str:
    t = m.group()
    if t[0] == "&":
        return html.unescape(t)
    if t[0] == "\\" and "u" in t[:-4]:
        return chr(int(t[-4:], 16))
    return " "


def words(text: str | None) -> list[str]:
    """Words in lower case; escapes, tags and marks are no words, Chinese and Japanese characters are single ones."""
    if not text:
        return []
    if "\\" in text or "<" in text or "&" in text:
        text = _ESCAPE.sub(_plain, text)
    return _WORD.findall(text.lower())


def distance(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between the pattern and any stretch of the text (Myers' bit-parallel algorithm)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        vert = eq | down
        horiz = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horiz | up) & full
        minus = up & horiz
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(vert | plus) & full
        down = plus & vert
    return best


def in_order(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Most words of a pattern (as masks of their places) that a text holds in order (bit-parallel longest common subsequence)."""
    rest = full = (1 << m) - 1
    for w in text:
        if hit := rest & masks.get(w, 0):
            rest = rest + hit | rest - hit
    return m - (rest & full).bit_count()


class ItemIndex:
    """Items by the numbers of their words.

    Half of the words may be wrong, so the pieces of an item, more than its errors, are its single words: whatever lies
    within the distance holds ``need`` of them, each as often as it is matched, and in order. That is counted over the
    whole text first, and drops nothing that the distance accepts. Besides, a match must hold a share of the item's own
    words, those that are not part of phrases of many items: stock sentences alone are no leak.
    """

    def __init__(self, items: list[tuple[list[int], list[str]]], stock: set[tuple[str, str, int]]) -> None:
        self.number: dict[str, int] = {}
        self.items = [(item_ids, [self.number.setdefault(w, len(self.number) + 1) for w in ws]) for item_ids, ws in items]
        sizes = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        # three words are the least that tells an item from a chance hit
        self.need = np.maximum(sizes - (sizes * (1 - HELD)).astype(np.int64), np.minimum(sizes, PIECE))
        self.own = [own_words(ws, stock) for _, ws in items]
        self.least = np.array([math.ceil(len(o) * OWN) for o in self.own], dtype=np.int64)
        flat = sorted((w, i, n) for i, o in enumerate(self.own) for w, n in Counter(self.items[i][1][p] for p in o).items())
        word, self.holder, self.times = (np.array([x[k] for x in flat], dtype=np.int64) for k in range(3))
        self.bags = [np.unique(ids, return_counts=True) for _, ids in self.items]
        self.first = np.searchsorted(word, np.arange(len(self.number) + 2))

    def enough(self, ids: np.ndarray) -> np.ndarray:
        """Items of which the text holds enough own words and enough words, in whatever order."""
        u, c = np.unique(ids[ids > 0], return_counts=True)
        n = self.first[u + 1] - self.first[u]
        at = np.repeat(self.first[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
        held = np.bincount(self.holder[at], np.minimum(self.times[at], np.repeat(c, n)), minlength=len(self.items))
        likely = np.nonzero(held >= self.least)[0]
        if not len(likely):
            return likely
        n = np.bincount(ids, minlength=len(self.number) + 1)
        return np.array([i for i in likely.tolist() if np.minimum(n[self.bags[i][0]], self.bags[i][1]).sum() >= self.need[i]], dtype=np.int64)

    def found(self, text: str) -> list[int]:
        """Ids of the items that the text holds for the larger part."""
        ws = words(text)
        if not ws or not self.items:
            return []
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))
        return [item_id for i in self.enough(ids).tolist() if self._holds(ids, i) for item_id in self.items[i][0]]

    def _holds(self, ids: np.ndarray, i: int) -> bool:
        pattern, need = self.items[i][1], int(self.need[i])
        m, errors = len(pattern), len(pattern) - need
        masks, own = _masks(pattern, range(m)), _masks(pattern, self.own[i])
        mine = np.zeros(len(self.number) + 1, dtype=bool)
        mine[pattern] = True
        at = np.nonzero(mine[ids])[0]
        listed = ids[at].tolist()

        def held(some: list[int]) -> bool:
            return in_order(own, len(self.own[i]), [w for w in some if w in own]) >= self.least[i] and in_order(masks, m, some) >= need

        if not held(listed):
            return False
        # one passage: a stretch within the distance has at most m + errors words, so it lies in one of these windows whole
        reach = m + errors
        for start in range(0, len(ids), reach):
            a, b = np.searchsorted(at, (start, start + 2 * reach)).tolist()
            if b - a >= need and held(listed[a:b]) and distance(pattern, ids[start : start + 2 * reach].tolist()) <= errors:
                return True
        # a few passages: around exact pieces, or else around words that follow each other nearly as in the item
        text = ids.tolist()
        pieces = {tuple(pattern[p : p + PIECE]) for p in range(m)}
        exact = [p for p in at.tolist() if tuple(text[p : p + PIECE]) in pieces]
        near = {(w, v) for p, w in enumerate(pattern) for v in pattern[p + 1 : p + 1 + PIECE]}
        close = [p for p in at.tolist() if any((text[p], v) in near for v in text[p + 1 : p + 1 + PIECE])]
        for hits in (exact, close):
            some = _passages(text, hits) if hits else []
            if held(some) and distance(pattern, some) <= errors:
                return True
        return False


def _masks(pattern: list[int], places: Iterable[int]) -> dict[int, int]:
    """The places of each word in a pattern, numbered as they are given, as bits."""
    masks: dict[int, int] = {}
    for k, p in enumerate(places):
        masks[pattern[p]] = masks.get(pattern[p], 0) | 1 << k
    return masks


def _pairs(ws: list[str]) -> Iterator[tuple[tuple[str, str, int], int]]:
    """Pairs of near words with their spacing, and the place of the first."""
    return (((ws[p], ws[p + d], d), p) for d in range(1, PIECE + 1) for p in range(len(ws) - d))


def own_words(ws: list[str], stock: set[tuple[str, str, int]]) -> list[int]:
    """Places of a text's own words: those in no stock pair. A text with hardly any keeps all of its words."""
    common = {q for pair, p in _pairs(ws) if pair in stock for q in (p, p + pair[2])}
    own = [p for p in range(len(ws)) if p not in common]
    return own if len(own) >= 2 * PIECE else list(range(len(ws)))


def _passages(text: list[int], hits: list[int]) -> list[int]:
    """The words around the hits, one passage after another."""
    out: list[int] = []
    start, end = hits[0], hits[0] + PIECE
    for p in [*hits[1:], None]:
        if p is not None and p - end <= GAP:
            end = p + PIECE
            continue
        out += text[max(0, start - CONTEXT) : end + CONTEXT]
        if p is not None:
            start, end = p, p + PIECE
    return out


def item_texts(items: DataFrame) -> DataFrame:
    """(words, item_ids): the different word sequences of the items, each with all items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = pa.array([words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), split], names=["item_id", "words"])

    kept = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    split = kept.mapInArrow(run, "item_id long, words array<string>").where("size(words) > 0")
    return split.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def stock_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, d): pairs of words that stand d words apart in many of all the texts.

    Each is in a fixed share of the texts, so there are never more than a text's pairs divided by that share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ws in b.column("words").to_pylist():
                found = list({pair for pair, _ in _pairs(ws)})
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["a", "b", "d"])

    many = max(MANY, MANY_SHARE * texts.count())
    return texts.select("words").mapInArrow(run, "a string, b string, d int").groupBy("a", "b", "d").count().where(F.col("count") >= many).drop("count")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document that holds at least half of an item's words in the item's order.

    Phrases that many items have are stock sentences: a third of the item's other words must be held too.

    The documents are read once per ``ITEMS_PER_PASS`` items and never shuffled. Null and empty texts on either side
    match nothing; repeated rows give a pair once; items of equal words are
    searched for once and found together; texts are searched whole.
    """
    texts = materialize(item_texts(items), "items")
    stock = {(r.a, r.b, r.d) for r in stock_pairs(texts).toLocalIterator()}
    n_passes = max(1, -(-texts.count() // ITEMS_PER_PASS))
    if n_passes > 1:
        texts = materialize(texts.withColumn("pass", F.pmod(F.xxhash64("words"), F.lit(n_passes))), "passes")
    found = None
    for number in range(n_passes):
        part = texts.where(F.col("pass") == number) if n_passes > 1 else texts
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted((r.item_ids, r.words) for r in part.toLocalIterator()), stock))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                pairs = [(d, i) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i in index.value.found(t)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        read = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
        got = read.mapInArrow(run, "doc_id long, item_id long")
        if n_passes > 1:
            got = materialize(got, "pairs")
            index.destroy()
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def leaks_per_item(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, item_id, documents): every item with the number of documents that hold it, 0 if none does."""
    n = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("suite", "item_id").distinct().join(n, "item_id", "left").select("suite", "item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
