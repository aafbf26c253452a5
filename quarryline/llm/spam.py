"""Pages made of repeated keywords, links or tags instead of sentences.

Word and neighbour counts of the whole corpus give every pair of neighbouring words its pointwise mutual information
(PMI). Within a document, pairs that go together and come back again and again are stuffing; long runs of words that
hardly ever stand side by side are word salad, and stuffing too if most of its words are keywords that come back, in
whatever order; lines of links and tags are told by their form. A document counts when more than half of it is such
material.

The counts are exact. Frequent words and pairs, of which there can be only so many, are known to every task; they give
each PMI an interval, and a text whose verdict the intervals leave open is judged again with its own rare pairs joined
to the counts. So the verdicts are those of the exact counts, at any size of corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize

#: A word (pair) is frequent if it makes up more than one part in so many of all words (pairs), so there are never more of them.
FREQUENT_WORDS, FREQUENT_PAIRS = 1 << 18, 1 << 20
#: Repetition (probability that two pairs of a text are the same) of sentences and of lists; share of a text that counts.
REPEATED, REPEATED_LIST, SHARE = 0.015, 0.012, 0.5
#: Times that a collocation or a keyword must come back, and its least PMI; salad: mean PMI of the text, of a line, pairs of a line.
LEAST_TIMES, COLLOCATION_PMI, MIXED_PMI, SALAD_PMI, SALAD_PAIRS = 4, 1.0, 1.5, 0.25, 12
_LINK = re.compile(r"<a\s[^>]*>(.*?)</a>|\[([^\]\n]{1,120})\]\((?:https?://|www\.|/)[^)\n]*\)|(?:https?://|www\.)[^\s<>\"')\]]+", re.S | re.I)
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?![\w])|[^\s\w]+|\w+")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"(?<=[.?!。！？])(?:\s+|(?=[㐀-鿿]))")


def _labels(line: str) -> str | None:
    """The line with every link as its label, or null where it has no link."""
    if "http" not in line and "www." not in line and "](" not in line and "<a " not in line.lower():
        return None
    got, n = _LINK.subn(lambda m: f" | {m.group(1) or m.group(2) or ''} | ", line)
    return got if n else None


def _tag_line(line: str) -> bool:
    """A line of hashtags, or of ten and more short phrases of plain words with marks between them."""
    if "#" in line and sum(len(w) + 1 for w in line.split() if w[0] == "#" and len(w) > 2 and w[1].isalpha()) * 2 > len(line):
        return True
    for mark in "|•;":
        if line.count(mark) >= 9:
            items = [i.split() for i in line.split(":", 1)[-1].split(mark) if i.strip()]
            plain = [i for i in items if len(i) <= 6 and all(w.isalpha() for w in i)]
            return len(plain) >= 10 and len(plain) * 10 > len(items) * 9 and sum(map(len, plain)) > len(plain) * 1.5
    return False


class _Codes(dict):
    """Codes of what stands between blanks: a hash for each word, -1 for anything else; forgets all when it grows too large.

    Texts are mostly made of few different pieces, so nearly all of them are looked up and not taken apart.
    """

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 1 << 20:
            self.clear()
        end = {"\0": (-2,), "\1": (-3,)}.get(piece)
        got = self[piece] = end or tuple(xxhash.xxh64_intdigest(t) >> 2 if t.isalpha() else -1 for t in _TOKEN.findall(piece))
        return got


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Keys of neighbouring words: negative, where those of words are not."""
    x = hashes[:-1] * 0x1E3779B97F4A7C15 + hashes[1:] * 0x2545F4914F6CDD1D
    return (x ^ (x >> 29)) | np.int64(-1 << 63)


def _hashed(texts: list[str], codes: _Codes) -> np.ndarray:
    """Codes of the words of some texts in order; -1 stands for marks and the ends of a link, -2 for the end of a text, -3 of a line."""
    parts = []
    for t in texts:
        if "http" in t or "www." in t or "](" in t or "<a " in t or "<A " in t:
            t = _LINK.sub(lambda m: f" . {m.group(1) or m.group(2) or ''} . ", t)
        parts.append(t.replace("\0", " . ").replace("\1", " . ") if "\0" in t or "\1" in t else t)
    pieces = " \0 ".join([*parts, ""]).lower().replace("\n", " \1 ").split()
    return np.fromiter(chain.from_iterable(map(codes.__getitem__, pieces)), dtype=np.int64)


def come_back(texts: list[str], codes: _Codes) -> np.ndarray:
    """For each text, whether it can be stuffing: any two words stand side by side often enough, in either order, or a
    line long enough to be salad has mostly words that come back often enough."""
    raw = _hashed(texts, codes)
    out = np.zeros(len(texts), dtype=bool)
    text = np.cumsum(raw == -2)
    at = np.nonzero((raw[1:] >= 0) & (raw[:-1] >= 0))[0]
    a, b = raw[at], raw[at + 1]
    _, first, n = np.unique(np.minimum(a, b) * 3 + np.maximum(a, b) + text[at] * 0x2545F4914F6CDD1D, return_index=True, return_counts=True)
    out[text[at[first[n >= LEAST_TIMES]]]] = True
    word = np.nonzero(raw >= 0)[0]
    _, which, n = np.unique(raw[word] + text[word] * 0x2545F4914F6CDD1D, return_inverse=True, return_counts=True)
    line = np.cumsum(raw <= -2)
    words, back = np.bincount(line[word]), np.bincount(line[word], weights=n[which] >= LEAST_TIMES)
    lines = np.nonzero((words > SALAD_PAIRS) & (back > SHARE * words))[0]
    out[text[word[np.searchsorted(line[word], lines)]]] = True
    return out


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = codes >= 0
    joined = word.copy()
    joined[1:] &= word[:-1]
    joined[:1] = False
    return codes[word], joined[word]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(key, n): counts of all words (keys from 0) and neighbouring pairs (keys below 0) of the corpus, by 64-bit hashes.

    Every task sums up its own texts, a few million words at a time, before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, kept, size = _Codes(), [], 0

        def summed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for b in batches:
            raw = _hashed(b.column("text").to_pylist(), codes)
            kept += [raw[raw >= 0], _pairs(raw)[(raw[1:] >= 0) & (raw[:-1] >= 0)]]
            size += 2 * len(raw)
            if size > 1 << 22:
                yield summed()
                kept, size = [], 0
        yield summed()

    return docs.select("text").where("text is not null").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Counts:
    """Exact counts of some words and pairs, and bounds for all others."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, n_words: int, n_pairs: int) -> None:
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        self.n_words, self.n_pairs = max(1, n_words), max(1, n_pairs)
        #: what is not listed occurs less often than this, and once at least
        self.rare_word, self.rare_pair = rare_below(n_words, n_pairs)

    def between(self, keys: np.ndarray, rare: int, more: "Counts | None") -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest counts of the keys."""
        least, most = np.ones(len(keys)), np.full(len(keys), float(max(1, rare - 1)))
        for known in (self, more):
            if known is not None and len(known.keys):
                at = np.minimum(np.searchsorted(known.keys, keys), len(known.keys) - 1)
                hit = known.keys[at] == keys
                least[hit] = most[hit] = known.n[at[hit]]
        return least, most

    def out_of(self, keys: np.ndarray, *bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds of counts without those counted here."""
        own = self.between(keys, 1, None)[0]
        return tuple(np.maximum(n - own, 0) for n in bounds)

    def pmi(self, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, more: "Counts | None" = None, less: "Counts | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest PMI of pairs of words, each pair's own occurrence left out of its count.

        The count is set against the one expected of independent words, with one more on both sides: what was never
        seen elsewhere gets 0 or less, in a corpus of any size. All occurrences counted in ``less`` can be left out too.
        """
        (a0, a1), (b0, b1), (p0, p1) = self.between(a, self.rare_word, more), self.between(b, self.rare_word, more), self.between(pairs, self.rare_pair, more)
        per = self.n_pairs / self.n_words**2
        if less is not None:
            (a0, a1), (b0, b1), (p0, p1) = (less.out_of(keys, *n) for keys, n in ((a, (a0, a1)), (b, (b0, b1)), (pairs, (p0, p1))))
            p0, p1 = p0 + 1, np.minimum(p1, np.minimum(a1, b1)) + 1
        else:
            p1 = np.minimum(p1, np.minimum(a1, b1))
        return np.log(p0 / (a1 * b1 * per + 1)), np.log(np.maximum(p0, p1) / (a0 * b0 * per + 1))

    def keywords(self, words: np.ndarray, more: "Counts | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a text surely are, and which may be, its keywords: they come back, and their PMI with the text is high."""
        each, which, own = np.unique(words, return_inverse=True, return_counts=True)
        at = np.nonzero(own >= LEAST_TIMES)[0]
        most_of_all = own[at] / len(words) * self.n_words / np.exp(COLLOCATION_PMI)
        sure, may = np.zeros(len(each), dtype=bool), np.zeros(len(each), dtype=bool)
        least, most = (np.maximum(n, own[at]) for n in self.between(each[at], self.rare_word, more))
        sure[at], may[at] = most <= most_of_all, least <= most_of_all
        return sure[which], may[which]


def rare_below(n_words: int, n_pairs: int) -> tuple[int, int]:
    """Counts from which on a word and a pair are frequent."""
    return -(-n_words // FREQUENT_WORDS), -(-n_pairs // FREQUENT_PAIRS)


def listed_form(text: str) -> bool:
    """Whether lines with links, or lines with tags, are more than half of a text: others can be neither a list of links nor of tags."""
    links = "http" in text or "www." in text or "](" in text or "<a " in text.lower()
    if links and 2 * sum(len(x) for x in text.split("\n") if "http" in x or "www." in x or "](" in x or "<a " in x.lower()) > len(text):
        return True
    tags = "#" in text or any(text.count(m) >= 9 for m in "|•;")
    return tags and 2 * sum(len(x) for x in text.split("\n") if "#" in x or any(x.count(m) >= 9 for m in "|•;")) > len(text)


class Text:
    """A text taken apart once, to be judged by any counts."""

    def __init__(self, text: str, codes: _Codes, salad: bool) -> None:
        self.size = max(1, len(text))
        self.salad_asked = salad
        self.links = self.tags = self.listed = 0
        self._take_apart(text, codes)

    def _take_apart(self, text: str, codes: _Codes) -> None:
        found: list[int] = []  # codes
        lists: list[tuple[int, int]] = []  # their places in lines of links and in pieces that are no sentences
        lines: list[tuple[int, int, int]] = []  # places of other lines, and their length
        look = codes.__getitem__
        for line in text.split("\n"):
            if not line:
                continue
            first = len(found)
            label = _labels(line)
            if label is not None and len(_WORDS.findall(_LINK.sub(" ", line))) <= 6:
                self.links += len(line)
                self.listed += len(line)
                found.extend(chain.from_iterable(map(look, label.lower().split())))
                found.append(-1)
                lists.append((first, len(found)))
            elif _tag_line(line):
                self.tags += len(line)
            else:
                for s in _SENTENCE_END.split(line if label is None else label):
                    at = len(found)
                    found.extend(chain.from_iterable(map(look, s.lower().split())))
                    found.append(-1)
                    if not (s.rstrip()[-1:] in ".?!。！？" and (len(s) > 24 or s.count(" ") > 3)):
                        self.listed += len(s)
                        lists.append((at, len(found)))
                lines.append((first, len(found), len(line)))
        raw = np.array(found, dtype=np.int64)
        h, joined = _words(raw)
        self.hashes, self.joined = h, joined
        inside = np.zeros(len(raw), dtype=bool)
        for a, b in lists:
            inside[a:b] = True
        self.parts = [np.ones(len(h), dtype=bool), inside[raw >= 0]]
        place = np.cumsum(raw >= 0)  # words up to a code
        self.lines = [(np.arange(int(place[a - 1]) if a else 0, int(place[b - 1])), n) for a, b, n in lines]

    def own(self, of: np.ndarray) -> tuple[np.ndarray, Counts]:
        """Places of neighbours among some words, and the counts of these words and neighbours."""
        some = np.nonzero(self.joined[1:] & of[1:] & of[:-1])[0]
        keys, n = np.unique(np.concatenate([self.hashes[of], _pairs(self.hashes)[some]]), return_counts=True)
        return some, Counts(keys, n, int(of.sum()), len(some))

    def pmi(self, counts: Counts, more: Counts | None = None, less: Counts | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest PMI of all neighbouring words."""
        return counts.pmi(self.hashes[:-1], self.hashes[1:], _pairs(self.hashes), more, less)

    def repetition(self, of: np.ndarray, together: np.ndarray) -> float:
        """Probability that two pairs of the words ``of``, taken at random, are one collocation (in either order) that comes back often."""
        n = int(of.sum())
        if n < 2:
            return 0.0
        some = together & of[1:] & of[:-1]
        low, high = np.minimum(self.hashes[:-1], self.hashes[1:])[some], np.maximum(self.hashes[:-1], self.hashes[1:])[some]
        _, c = np.unique(low * 3 + high, return_counts=True)
        c = c[c >= LEAST_TIMES]
        return float((c * (c - 1)).sum()) / (n * (n - 1))

    def kind(self, pmi: np.ndarray, keyword: np.ndarray, elsewhere: Callable[[], np.ndarray]) -> str | None:
        """links, tags, keywords, mixed (keywords in any order), salad, or None.

        It is given by the PMI of all neighbouring words, by which words are keywords, and by the PMI without the text's own counts.
        """
        if self.links > SHARE * self.size:
            return "links"
        if self.tags > SHARE * self.size:
            return "tags"
        if len(self.hashes) < 2:
            return None
        joined = self.joined[1:]
        together = joined & (pmi >= COLLOCATION_PMI)
        if self.repetition(self.parts[0], together) > REPEATED or (self.listed > SHARE * self.size and self.repetition(self.parts[1], together) > REPEATED_LIST):
            return "keywords"
        salad_asked = self.salad_asked and joined.any() and pmi[joined].mean() < MIXED_PMI
        if salad_asked or keyword.sum() > SHARE * SALAD_PAIRS:
            # lines whose neighbours hardly ever stand side by side anywhere, and lines of keywords
            salad = mixed = stuffed = 0
            of = np.zeros(len(self.hashes), dtype=bool)
            for words, length in self.lines:
                own = pmi[words[:-1]][joined[words[:-1]]]
                if len(own) < SALAD_PAIRS:
                    continue
                keywords = keyword[words].mean() > SHARE
                if own.mean() < SALAD_PMI:
                    salad += length
                    mixed += length * bool(keywords)
                if keywords:
                    stuffed += length
                    of[words] = True
            if SHARE * self.size < stuffed != mixed:
                # keywords that come back raise each other's PMI; side by side they stand here no more than by chance, and seldom elsewhere
                some, own = self.own(of)
                if self.pmi(own)[0][some].mean() < 0 and elsewhere()[some].mean() < MIXED_PMI:
                    mixed = stuffed
            if mixed > SHARE * self.size:
                return "mixed"
            if salad_asked and salad > SHARE * self.size:
                return "salad"
        return None

    def judged(self, counts: Counts, more: Counts | None = None, often: bool = True) -> tuple[str | None, bool]:
        """The kind, and whether it is certain: it is if the least and the greatest PMI give the same.

        More PMI can only make keywords of a text and only spare it from being salad, so all PMI between give it too. What
        asks for the single keywords is certain only if these are; there are none to ask for where nothing comes back (``often``).
        """
        if len(self.hashes) < 2:
            return self.kind(np.zeros(0), np.zeros(0, dtype=bool), lambda: np.zeros(0)), True
        low, high = self.pmi(counts, more)
        sure, may = counts.keywords(self.hashes, more) if often else (np.zeros(len(self.hashes), dtype=bool),) * 2
        kinds = [self.kind(p, sure, lambda k=k: self.pmi(counts, more, self.own(np.ones(len(self.hashes), dtype=bool))[1])[k]) for k, p in enumerate((low, high))]
        return kinds[0], kinds[0] == kinds[1] and (kinds[0] in ("links", "tags", "keywords") or bool((sure == may).all()))

    def keys(self) -> np.ndarray:
        """Keys of all words and pairs."""
        return np.unique(np.concatenate([self.hashes, _pairs(self.hashes)[self.joined[1:]]]))


def spam_pages(docs: DataFrame, salad: bool = True) -> DataFrame:
    """(doc_id, kind): the documents of which more than half is links, tags, stuffed keywords, keywords mixed at random,
    or (``salad``) other word salad, in which hardly any word comes back.

    The corpus is read twice, once for its counts and once to be judged; only texts that the frequent words and pairs
    leave open are shuffled, by their rare keys. Null and empty texts are never spam; repeated rows give one; a document
    that is there several times with differing texts may get several kinds.
    """
    spark = docs.sparkSession
    counts = materialize(corpus_counts(docs), "counts")
    total = counts.agg(F.sum(F.when(F.col("key") >= 0, F.col("n"))).alias("w"), F.sum(F.when(F.col("key") < 0, F.col("n"))).alias("p")).first()
    n_words, n_pairs = total.w or 0, total.p or 0
    least = F.when(F.col("key") >= 0, rare_below(n_words, n_pairs)[0]).otherwise(rare_below(n_words, n_pairs)[1])
    # at most FREQUENT_WORDS + FREQUENT_PAIRS rows, as each is more than its part of all
    listed = counts.where(F.col("n") >= least).toArrow()
    sent = spark.sparkContext.broadcast(Counts(listed.column("key").to_numpy(), listed.column("n").to_numpy(), n_words, n_pairs))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            ids, kinds, texts, keys = [], [], [], []
            every = b.column("text").to_pylist()
            # what can be none of the kinds needs not be taken apart
            for d, t, often in zip(b.column("doc_id").to_pylist(), every, come_back(every, codes).tolist(), strict=True):
                if not (salad or often or listed_form(t)):
                    continue
                text = Text(t, codes, salad)
                kind, sure = text.judged(sent.value, often=often)
                if kind or not sure:
                    ids.append(d)
                    kinds.append(kind if sure else None)
                    texts.append(None if sure else t)
                    keys.append(None if sure else text.keys())
            made = [pa.array(x, t) for x, t in ((ids, pa.int64()), (kinds, pa.string()), (texts, pa.string()), (keys, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "kind", "text", "keys"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            ids, kinds = [], []
            for d, t, known in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "known")), strict=True):
                more = Counts(np.array([k["key"] for k in known], dtype=np.int64), np.array([k["n"] for k in known], dtype=np.int64), n_words, n_pairs)
                kind, _ = Text(t, codes, salad).judged(sent.value, more)
                if kind:
                    ids.append(d)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null and text != ''")
    judged = materialize(texts.mapInArrow(first, "doc_id long, kind string, text string, keys array<long>"), "judged")
    sure = judged.where("kind is not null").select("doc_id", "kind")
    still = judged.where("text is not null").dropDuplicates(["doc_id", "text"]).withColumn("row", F.xxhash64("doc_id", "text"))
    # the frequent keys are known, so no key of these is hot
    rare = still.select("row", F.explode("keys").alias("key")).join(counts.where(F.col("n") < least), "key")
    known = rare.groupBy("row").agg(F.collect_list(F.struct("key", "n")).alias("known"))
    found = still.select("row", "doc_id", "text").join(known, "row", "left").select("doc_id", "text", F.coalesce("known", F.array().cast("array<struct<key:long,n:long>>")).alias("known"))
    return sure.unionByName(found.mapInArrow(again, "doc_id long, kind string")).distinct()
