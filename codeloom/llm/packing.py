"""Packing texts into containers of fixed size by lexical retrieval.

1. Documents are dealt to shards by their words: centres of weighted word counts, fitted on a bounded sample, give each
   document a cell; a cell of more than SHARD documents is cut by the rarest word that a document shares with
   another, so that versions of one text stay together.  Every document is in one shard and in its index.
2. In each shard a BM25 inverted index over all tokens, with document frequencies of the whole corpus, gives the
   neighbours of a seed document for all its tokens.  Those not used yet fill the seed's container, best first, and
   what room is left takes the largest unused piece that fits.
A text longer than a container is cut into full containers and a rest, which is packed like any other text.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tokens import document_frequencies, token_table, tokenizer_path, vocabulary
from codeloom.session import pin

SHARD = 2_000
SHARDS_PER_TASK = 4
K1, B = 1.2, 0.75
#: Tokens of more than one in DENSE documents of a shard are scored as rows of a matrix.
DENSE = 16
#: Bound of the sample that the centres are fitted on, how many there are at most, hashed features and rounds of the fit.
SAMPLE, CENTRES, FEATURES, ROUNDS = 4_000, 256, 512, 10
#: Container sizes at most; more are refused.
MOST_SIZES = 1_000
#: ``placed_by`` says why a piece lies where it does: whole (it fills its container), seed, neighbour (retrieved), fit (by length).
PLACED = "container_name string, container_id string, place int, doc_id long, piece int, first_token int, n_tokens int, placed_by string"


def rarity(frequencies: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - frequencies + 0.5) / (frequencies + 0.5))


def features(ids: bytes, counts: bytes, idf: np.ndarray) -> np.ndarray:
    """Damped counts times the rarity of the tokens, hashed and normed."""
    own = np.frombuffer(ids, dtype=np.uint32)
    bucket = (own.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(FEATURES)
    row = np.bincount(bucket.astype(np.int64), weights=np.log1p(np.frombuffer(counts, dtype=np.uint32)) * idf[own], minlength=FEATURES)
    return (row / (np.linalg.norm(row) or 1.0)).astype(np.float32)


def fit_centres(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of unit rows: each starts at the row farthest from all before it, then come rounds of means."""
    if not len(x):
        return np.zeros((1, FEATURES), dtype=np.float32)
    picked, near = [0], x @ x[0]
    while len(picked) < min(n, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centres = x[picked].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        for k in np.unique(own):
            mean = x[own == k].mean(axis=0)
            centres[k] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


def dealt(vectors: DataFrame, frequencies: Broadcast, total: int) -> DataFrame:
    """(doc_id, shard) of each document.

    The sample is about SAMPLE rows, chosen by hash, whatever the corpus; there is one centre per SHARD documents, CENTRES at
    most.  What is broadcast are the centres and one number per token of the vocabulary.
    """
    share = F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, total))))
    sample = vectors.where(F.pmod(F.xxhash64("doc_id", F.lit("centres")), F.lit(1 << 30)) < share).select("doc_id", "ids", "counts").toPandas().sort_values("doc_id")
    idf = rarity(frequencies.value, total)
    x = np.array([features(a, b, idf) for a, b in zip(sample["ids"], sample["counts"])], dtype=np.float32).reshape(-1, FEATURES)
    centres = vectors.sparkSession.sparkContext.broadcast(fit_centres(x, min(CENTRES, max(1, round(total / SHARD)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = rarity(frequencies.value, total)
        shared = np.where(frequencies.value > 1, idf, 0.0)
        for batch in batches:
            rows = np.array([features(a, b, idf) for a, b in zip(batch["ids"], batch["counts"])], dtype=np.float32).reshape(-1, FEATURES)
            owns = [np.frombuffer(a, dtype=np.uint32) for a in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "cell": (rows @ centres.value.T).argmax(axis=1).astype(np.int64), "rarest": [int(own[shared[own].argmax()]) for own in owns]})

    placed = pin(vectors.select("doc_id", "ids", "counts").mapInPandas(run, "doc_id long, cell long, rarest long"), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).alias("parts"))  # one row per centre
    first = F.coalesce(F.sum("parts").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(parts.select("cell", "parts", first.alias("first")))
    return placed.join(sizes, "cell").select("doc_id", (F.col("first") + F.pmod(F.xxhash64("rarest"), F.col("parts"))).cast("int").alias("shard"))


class Index:
    """A BM25 inverted index over one shard."""

    def __init__(self, ids: list[bytes], counts: list[bytes], frequencies: np.ndarray, n_documents: int, mean_length: float):
        terms = [np.frombuffer(x, dtype=np.uint32) for x in ids]
        self.sizes = np.array([len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.zeros(0, dtype=np.uint32)
        tf = np.frombuffer(b"".join(counts), dtype=np.uint32).astype(np.float64)
        owner = np.repeat(np.arange(len(terms)), self.sizes)
        length = np.bincount(owner, weights=tf, minlength=len(terms))
        idf = np.log1p((n_documents - frequencies[flat] + 0.5) / (frequencies[flat] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean_length, 1.0)))
        order = np.argsort(flat, kind="stable")
        self.terms, starts = np.unique(flat[order], return_index=True)
        self.bounds = np.append(starts, len(flat))
        self.owner, self.weight = owner[order], weight[order].astype(np.float32)
        at = np.empty(len(flat), dtype=np.int64)
        at[order] = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds))
        # a token of no other document of the shard leads to no neighbour
        df = np.diff(self.bounds)
        several = df > 1
        self.queries = [q[several[q]] for q in np.split(at, np.cumsum(self.sizes)[:-1])] if len(terms) else []
        # tokens of very many documents are held as rows of weights, which are summed by one product
        common = np.flatnonzero(df * DENSE > len(terms))
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(terms)), dtype=np.float32)
        for k, t in enumerate(common):
            own = slice(self.bounds[t], self.bounds[t + 1])
            self.dense[k, self.owner[own]] = self.weight[own]
        self.known: dict[int, np.ndarray] = {}
        self.base: np.ndarray | None = None

    def _from_common(self) -> np.ndarray:
        """What the common tokens give, of all documents of the shard for all, by one product."""
        asked = np.zeros((len(self.queries), len(self.dense)), dtype=np.float32)
        for document, query in enumerate(self.queries):
            row = self.row[query]
            asked[document, row[row >= 0]] = 1.0
        return asked @ self.dense

    def scores(self, document: int) -> np.ndarray:
        """BM25 of all documents of the shard for all tokens of one; kept, as each container size asks again."""
        if self.base is None:
            self.base = self._from_common()
        if document not in self.known:
            query = self.queries[document]
            self.known[document] = self.base[document] + self._of_rare(query[self.row[query] < 0])
        return self.known[document]

    def _of_rare(self, rare: np.ndarray) -> np.ndarray:
        begin = self.bounds[rare]
        lengths = self.bounds[rare + 1] - begin
        at = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=len(self.sizes)).astype(np.float32)

    def of_terms(self, asked: np.ndarray) -> np.ndarray:
        """BM25 of all documents for the terms at these places of ``terms``."""
        out = np.zeros(len(self.sizes), dtype=np.float32)
        if not len(asked):
            return out
        row = self.row[asked]
        if len(self.dense):
            wanted = np.zeros(len(self.dense), dtype=np.float32)
            wanted[row[row >= 0]] = 1.0
            out += wanted @ self.dense
        return out + self._of_rare(asked[row < 0])


def pack(lengths: np.ndarray, capacity: int, index: Index) -> list[list[tuple[int, int, int, int, str]]]:
    """Containers as lists of (document, piece, first token, tokens, placed by); every token of every document is placed once."""
    containers: list[list[tuple[int, int, int, int, str]]] = []
    rest = lengths % capacity
    pieces = lengths // capacity
    for document in np.flatnonzero(pieces):
        containers += [[(int(document), p, p * capacity, capacity, "whole")] for p in range(int(pieces[document]))]
    unused = rest > 0
    free = sorted((int(rest[d]), int(d)) for d in np.flatnonzero(unused))

    def use(document: int, why: str) -> tuple[int, int, int, int, str]:
        unused[document] = False
        del free[bisect_right(free, (int(rest[document]), document)) - 1]
        return document, int(pieces[document]), int(pieces[document]) * capacity, int(rest[document]), why

    for seed in np.lexsort((np.arange(len(rest)), -rest)):
        if not unused[seed]:
            continue
        own = [use(int(seed), "seed")]
        room = capacity - own[0][3]
        if free and free[0][0] <= room:
            scores = index.scores(int(seed))
            fitting = np.flatnonzero(unused & (rest <= room) & (scores > 0))
            for document in fitting[np.argsort(-scores[fitting], kind="stable")]:
                if rest[document] <= room:
                    own.append(use(int(document), "neighbour"))
                    room -= own[-1][3]
                    if not free or free[0][0] > room:
                        break
            while free and free[0][0] <= room:
                own.append(use(free[bisect_right(free, (room, len(rest))) - 1][1], "fit"))
                room -= own[-1][3]
        if len(own) > 1 and room and free:  # the last piece may give way to one that leaves less room
            last = own[-1]
            best = bisect_right(free, (room + last[3], len(rest))) - 1
            if best >= 0 and free[best][0] > last[3] + capacity // 100:
                own[-1] = use(free[best][1], "fit")
                unused[last[0]] = True
                insort(free, (last[3], last[0]))
        containers.append(own)
    return containers


def packed(documents: DataFrame, sizes: DataFrame, path: str | None = None) -> DataFrame:
    """Where each text lies: rows of PLACED for every container size, each token of each text once per size.

    ``place`` numbers the pieces in a container from 0.  Texts without tokens lie nowhere.  Sizes that are null
    or under one token are left out; of repeated names the greatest size counts.  ``sizes`` is a small dimension.
    """
    spark = documents.sparkSession
    path = path or tokenizer_path()
    usable = sizes.where("capacity_tokens >= 1 and container_name is not null").groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    if usable.count() > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} container sizes")
    capacities = [(r["container_name"], r["capacity_tokens"]) for r in usable.orderBy("container_name").collect()]
    vectors = pin(token_table(documents, path).where("n_tokens > 0").dropDuplicates(["doc_id"]), "vectors")
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    total, mean = counted["n"], counted["mean"] or 0.0
    frequencies = spark.sparkContext.broadcast(document_frequencies(vectors, vocabulary(path)))  # one number per token of the vocabulary
    shards = dealt(vectors, frequencies, total)

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("doc_id", ignore_index=True)
        index = Index(list(own["ids"]), list(own["counts"]), frequencies.value, total, mean)
        lengths, ids = own["n_tokens"].to_numpy().astype(np.int64), own["doc_id"].to_numpy()
        rows = [
            (name, f"{name}-{key[0]}-{number}", place, int(ids[document]), piece, first, n, why)
            for name, capacity in capacities
            for number, container in enumerate(pack(lengths, capacity, index))
            for place, (document, piece, first, n, why) in enumerate(container)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])

    tasks = max(1, -(-total // (SHARD * SHARDS_PER_TASK)))  # so that a task's share doesn't grow with the corpus
    return vectors.select("doc_id", "n_tokens", "ids", "counts").join(shards, "doc_id").repartition(tasks, "shard").groupBy("shard").applyInPandas(run, PLACED)


def neighbour_recall(documents: DataFrame, path: str | None = None, best: int = 10, every: int = 50) -> tuple[float, float]:
    """How many of the ``best`` neighbours by BM25 over all rows lie in a document's shard, and how many would by chance.

    The queries are all documents whose id is divisible by ``every``; they go to the driver, the index doesn't: each
    batch of documents is scored against all queries and keeps the best of each.  A test, no part of packing.
    """
    path = path or tokenizer_path()
    vectors = pin(token_table(documents, path).where("n_tokens > 0").dropDuplicates(["doc_id"]), "vectors")
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    total, mean = counted["n"], counted["mean"] or 0.0
    frequencies = vectors.sparkSession.sparkContext.broadcast(document_frequencies(vectors, vocabulary(path)))
    shards = pin(dealt(vectors, frequencies, total), "shards")
    asked = vectors.where(F.col("doc_id") % every == 0).select("doc_id", "ids").toPandas()
    queries = {int(d): np.frombuffer(i, dtype=np.uint32) for d, i in zip(asked["doc_id"], asked["ids"])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            index = Index(list(batch["ids"]), list(batch["counts"]), frequencies.value, total, mean)
            ids = batch["doc_id"].to_numpy()
            for query, terms in queries.items():
                at = np.searchsorted(index.terms, terms)
                asked = at[(at < len(index.terms)) & (index.terms[np.minimum(at, len(index.terms) - 1)] == terms)]
                scores = np.where(ids == query, 0.0, index.of_terms(asked))
                top = np.argsort(-scores, kind="stable")[:best]
                yield pd.DataFrame({"query": query, "doc_id": ids[top], "score": scores[top]})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    found = vectors.select("doc_id", "ids", "counts").mapInPandas(run, "query long, doc_id long, score double").where("score > 0")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    own = shards.select(F.col("doc_id").alias("query"), F.col("shard").alias("own"))
    hit = top.join(shards, "doc_id").join(own, "query").agg(F.avg((F.col("shard") == F.col("own")).cast("int"))).first()[0]
    chance = shards.groupBy("shard").count().agg((F.sum(F.col("count") * F.col("count")) / (F.sum("count") * F.sum("count")))).first()[0]
    return float(hit or 0.0), float(chance or 0.0)


def fill(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per container size: containers, pieces, texts cut, tokens, the share of the room used, and of the pieces added
    to a seed those that retrieval placed."""
    each = placed.groupBy("container_name", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("cut"), F.count_if(F.col("placed_by") == "neighbour").alias("near"), F.count_if(F.col("placed_by") == "fit").alias("fit"))
    total = each.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("cut").alias("n_cuts"), F.sum("tokens").alias("n_tokens"), F.round(F.sum("near") / F.greatest(F.sum("near") + F.sum("fit"), F.lit(1)), 6).alias("neighbour_share"))
    room = sizes.where("capacity_tokens >= 1").groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return total.join(room, "container_name").withColumn("fill_rate", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
