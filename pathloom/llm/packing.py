"""Documents into containers of fixed capacity by a grouping genetic algorithm.

Solutions are sets of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that then hold duplicates and best-fits
the displaced documents. Blocks of documents evolve on several islands, which
exchange their elites; weak bins of all blocks are packed once more together.
"""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CAPACITY, BLOCK, ISLANDS, ROUNDS = 2048, 2000, 3, 2
POPULATION, GENERATIONS, ELITES = 8, 12, 2
#: Bins filled less than this share are opened for the last round.
WEAK = 0.97


def token_counts(documents: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null texts have 0 tokens. The vocabulary is read on the driver and shipped."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encoding = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [0 if t is None else len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    rows = documents.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id long, n_tokens long")


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes, capacity: int) -> None:
    """Add ``items`` to the fullest bins they fit in, opening bins where there is none."""
    order = sorted((load, b) for b, load in enumerate(loads))
    for item in items:
        at = bisect_left(order, (capacity - sizes[item], len(bins) + 1)) - 1
        if at >= 0:
            load, b = order.pop(at)
        else:
            load, b = 0, len(bins)
            bins.append([])
            loads.append(0)
        bins[b].append(item)
        loads[b] = int(load + sizes[item])
        insort(order, (loads[b], b))


class Island:
    """One population over one block of documents."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes.tolist(), capacity, random.Random(seed)
        self.bound = max(1, -(-sum(self.sizes) // capacity)) if len(sizes) else 0

    def fresh(self, noise: float) -> list[list[int]]:
        key = {i: s * (1 + noise * self.rng.random()) for i, s in enumerate(self.sizes)}
        bins, loads = [], []
        best_fit(bins, loads, sorted(key, key=lambda i: -key[i]), self.sizes, self.capacity)
        return bins

    def load(self, b: list[int]) -> int:
        return sum(self.sizes[i] for i in b)

    def fitness(self, bins: list[list[int]]) -> float:
        """Fewer bins first, then uneven fill, which leaves room that can still be used."""
        return -len(bins) + sum((self.load(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def cross(self, giver: list[list[int]], taker: list[list[int]]) -> list[list[int]]:
        full = sorted(giver, key=lambda b: -self.load(b))
        full = full[: max(1, len(full) // 2)]
        start = self.rng.randrange(len(full))
        injected = [list(b) for b in full[start: start + 1 + self.rng.randrange(max(1, len(full) // 2))]]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in taker:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        weakest = min(range(len(kept)), key=lambda k: self.load(kept[k]), default=None)
        if weakest is not None and self.rng.random() < 0.5:  # mutation: open the emptiest bin
            displaced += kept.pop(weakest)
        bins = injected + kept
        best_fit(bins, [self.load(b) for b in bins], sorted(displaced, key=lambda i: -self.sizes[i]), self.sizes, self.capacity)
        return bins

    def evolve(self, elites: list[list[list[int]]], generations: int) -> list[list[list[int]]]:
        people = elites + [self.fresh(0.0)] + [self.fresh(0.3) for _ in range(POPULATION - len(elites) - 1)]
        people.sort(key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(people[0]) <= self.bound:
                break
            a, b = sorted(self.rng.sample(range(len(people)), 2))
            for child in (self.cross(people[a], people[b]), self.cross(people[b], people[a])):
                people.append(child)
            people.sort(key=self.fitness, reverse=True)
            del people[POPULATION:]
        return people[:ELITES]


def _encode(bins: list[list[int]], n: int) -> bytes:
    where = np.zeros(n, np.int32)
    for b, members in enumerate(bins):
        where[members] = b
    return where.tobytes()


def _decode(blob: bytes) -> list[list[int]]:
    where = np.frombuffer(blob, np.int32)
    bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, b in enumerate(where.tolist()):
        bins[b].append(i)
    return bins


_ITEM = "block long, doc_id long, piece int, size int, copy int"


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "piece", "size", "copy"], na_position="first", kind="stable").reset_index(drop=True)


def _round(capacity: int, generations: int, number: int):
    def run(key, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        items = _ordered(items)
        home = Island(items["size"].to_numpy(), capacity, hash((block, island, number)))
        best = home.evolve([_decode(b) for b in elites["solution"]] if len(items) else [], generations)
        return pd.DataFrame([(block, island, len(s), home.fitness(s), _encode(s, len(items))) for s in best], columns=["block", "island", "bins", "fitness", "solution"])

    return run


_STATE = "block long, island int, bins int, fitness double, solution binary"


def _pack_blocks(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """Items (block, doc_id, piece, size, copy) with their bin and its load."""
    spark = items.sparkSession
    spread = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = spark.createDataFrame([], _STATE)
    for number in range(ROUNDS):
        if number:  # each island also receives the elites of its neighbour
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
            state = state.unionByName(moved)
        state = spread.groupBy("block", "island").cogroup(state.groupBy("block", "island")).applyInPandas(_round(capacity, GENERATIONS, number), _STATE)
        state = materialize(state, "elites")
    # One row per block: bins, then fitness, then island decide.
    best = state.groupBy("block").agg(F.max_by("solution", F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("solution"))

    def place(key, rows: pd.DataFrame, winner: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(rows)
        rows["bin"] = np.frombuffer(winner["solution"].iloc[0], np.int32) if len(rows) else []
        rows["load"] = rows.groupby("bin")["size"].transform("sum").astype("int64")
        return rows[["block", "doc_id", "piece", "size", "copy", "bin", "load"]]

    placed = items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, _ITEM + ", bin int, load long")
    return placed.withColumn("level", F.lit(level))


def _blocked(items: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` items by hash; repeated rows are told apart by ``copy``."""
    blocks = max(1, round(items.count() / BLOCK))
    return items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(blocks)))


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, doc_id, piece, n_tokens) for ``sizes`` (doc_id, n_tokens).

    No document is split unless it alone exceeds the capacity; then its full
    pieces take a container each and the rest is packed like a document. Every
    row is placed exactly once: empty documents too (with 0 tokens), repeated
    rows each, and null ids. An empty table gives no containers.
    """
    counted = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    numbered = counted.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))  # repeated rows, without a window over them
    numbered = numbered.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).drop("copies")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1).cast("int")
    pieces = numbered.select("doc_id", "copy", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = materialize(pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"), "copy"), "pieces")
    full = F.col("size") == capacity
    first = materialize(_pack_blocks(_blocked(pieces.where(~full)).select("block", "doc_id", "piece", "size", "copy"), capacity, 1), "packed")
    weak = F.col("load") < WEAK * capacity
    again = materialize(_blocked(first.where(weak).select("doc_id", "piece", "size", "copy")).select("block", "doc_id", "piece", "size", "copy"), "weak")
    second = _pack_blocks(again, capacity, 2)
    alone = pieces.where(full).select(F.concat(F.lit("f-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), "piece", F.lit("-"), "copy").alias("container"), "doc_id", "piece", "size")
    named = F.concat_ws("-", F.col("level").cast("string"), F.col("block").cast("string"), F.col("bin").cast("string")).alias("container")
    mixed = first.where(~weak).select(named, "doc_id", "piece", "size").unionByName(second.select(named, "doc_id", "piece", "size"))
    return mixed.unionByName(alone).withColumn("n_tokens", F.col("size").cast("long")).drop("size")


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers of all documents, measured in tokens of a public tokenizer."""
    return pack_documents(materialize(token_counts(documents, vocabulary=vocabulary), "tokens"), capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of space used."""
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("n_tokens"), F.ceil(F.coalesce(F.sum("load"), F.lit(0)) / capacity).alias("least_containers"),
        (F.sum("load") / (F.count("*") * capacity)).alias("used"), F.max("load").alias("fullest"))


def laws(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: documents, documents whose tokens are not all there once, containers over ``capacity``, documents split although they fit."""
    counts = materialize(token_counts(documents, vocabulary=vocabulary), "tokens")
    packed = materialize(pack_documents(counts, capacity), "laws")
    want = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.count("*").alias("rows"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))).alias("most"))
    have = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("pieces"))
    both = want.join(have, want["doc_id"].eqNullSafe(have["doc_id"]), "full")
    lost, split = F.coalesce(F.col("want") != F.col("have"), F.lit(True)), F.coalesce(F.col("pieces") != F.col("most"), F.lit(True))
    per_doc = both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_documents"), F.count_if(lost).alias("n_wrong_tokens"), F.count_if(split).alias("n_split"))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("load")).agg(F.count_if(F.col("load") > capacity).alias("n_overfull"))
    return per_doc.crossJoin(over).select("n_documents", "n_wrong_tokens", "n_overfull", "n_split")  # two single rows
