"""Filling containers of fixed token capacity with whole documents, balanced by attention cost.

Each scan task counts tokens and packs what it read, a block of rows at a time, so no text is shuffled. The sequences
that a block leaves half empty are taken apart and their pieces, now only a few numbers each, are packed once more
across all blocks.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quarryline.common import materialize

#: Capacity in tokens; rows of a block; a sequence under this fill is packed again; the tokenizer's vocabulary.
CAPACITY, BLOCK_ROWS, REPACK_BELOW = 2048, 1 << 16, 0.97
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, piece int, n_tokens int, container long, cost double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("container", pa.int64()), ("cost", pa.float64())])


@lru_cache(maxsize=2)
def encoding(vocabulary: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, read once in a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cost_of(n: int | np.ndarray, capacity: int = CAPACITY) -> float | np.ndarray:
    """Estimated cost of a document of n tokens: linear layers plus attention within the document."""
    return n + n * n / capacity


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of every item, largest items first.

    As many sequences are open as the items need at least. An item goes to the sequence with the lowest cost of those
    with room for it; if none has room, a further one is opened. Equal items keep their order.
    """
    order = np.argsort(-sizes, kind="stable")
    place = np.zeros(len(sizes), dtype=np.int64)
    need = max(1, -(-int(sizes.sum()) // capacity))
    # sequences by room left: a heap of (cost, number) each, and the lowest cost of each room
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    rooms[capacity] = [(0.0, k) for k in range(need)]
    lowest = np.full(capacity + 1, np.inf)
    lowest[capacity] = 0.0
    opened = need
    for i in order:
        n = int(sizes[i])
        if not n:  # takes no room anywhere: spread evenly
            place[i] = i % opened
            continue
        room = n + int(np.argmin(lowest[n:]))
        if lowest[room] == np.inf:
            heapq.heappush(rooms[capacity], (0.0, opened))
            opened += 1
            room = capacity
        cost, k = heapq.heappop(rooms[room])
        lowest[room] = rooms[room][0][0] if rooms[room] else np.inf
        place[i] = k
        cost, room = cost + cost_of(n, capacity), room - n
        heapq.heappush(rooms[room], (cost, k))
        lowest[room] = rooms[room][0][0]
    return place


def _batch(doc: np.ndarray, piece: np.ndarray, size: np.ndarray, container: np.ndarray, capacity: int) -> pa.RecordBatch:
    cost = cost_of(size.astype(np.float64), capacity)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, piece, size, container, cost), _ARROW.types, strict=True)], schema=_ARROW)


def _pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """Every document's pieces with a first container; those longer than the capacity are cut at its multiples."""

    def block(ids: list[int], counts: list[int], number: int) -> pa.RecordBatch:
        n = np.asarray(counts, dtype=np.int64)
        whole = np.maximum(1, -(-n // capacity))
        doc = np.repeat(np.asarray(ids, dtype=np.int64), whole)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        size = np.minimum(np.repeat(n, whole) - piece * capacity, capacity)
        return _batch(doc, piece, size, pack(size, capacity) + number, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        first, ids, counts = TaskContext.get().partitionId() << 38, [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            counts += [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            if len(ids) >= BLOCK_ROWS:
                yield block(ids, counts, first)
                first, ids, counts = first + (1 << 20), [], []
        if ids:
            yield block(ids, counts, first)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, SCHEMA)


def _packed_again(pieces: DataFrame, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=_ARROW) for b in batches], schema=_ARROW).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        if got.num_rows:
            first = (1 << 62) | (TaskContext.get().partitionId() << 32)
            doc, piece, size = (got.column(c).to_numpy() for c in ("doc_id", "piece", "n_tokens"))
            yield _batch(doc, piece, size, pack(size.astype(np.int64), capacity) + first, capacity)

    return pieces.select(*_ARROW.names).mapInArrow(run, SCHEMA)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, repack_below: float = REPACK_BELOW) -> DataFrame:
    """(doc_id, piece, n_tokens, container, cost): every document in one container, or in several if longer than one.

    Null and empty texts have no tokens and are spread over the containers; an empty table gives no rows. Repeated rows are
    items of their own. Containers are as numbered by task and block; texts are counted whole.
    """
    first = materialize(_pieces(docs, capacity, vocabulary), "packed")
    fill = first.groupBy("container").agg(F.sum("n_tokens").alias("fill")).where(F.col("fill") < repack_below * capacity)
    loose = materialize(first.join(fill.select("container"), "container", "left_semi"), "loose")
    # blocks of bounded size again: the rest of a block is a small share of it
    tasks = max(1, -(-loose.count() // BLOCK_ROWS))
    again = _packed_again(loose.repartition(tasks, "container"), capacity)
    return first.join(fill.select("container"), "container", "left_anti").select(*_ARROW.names).unionByName(again)


def fill_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, fewest possible, tokens, share of used space, mean and greatest cost of a container."""
    each = pieces.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.sum("cost").alias("cost"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / capacity).alias("fewest"), F.sum("n").alias("n_tokens"),
        (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("used"), F.max("n").alias("fullest"), F.avg("cost").alias("mean_cost"),
        F.max("cost").alias("max_cost"),
    )
