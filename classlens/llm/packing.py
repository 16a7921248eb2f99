"""Packing of documents into sequences of fixed length, neighbours by BM25 side by side.

Token ids are written once, with a shingle minimum, and dealt by content: documents go by the heaviest of their terms that many documents share,
then by that minimum, so that topics and near copies of the whole corpus meet; groups larger than a fraction of a
shard are split, copies by row. Each task then cuts its rows into shards of a bounded number of tokens. A shard builds an inverted index of its documents' token ids with BM25 weights; document frequencies and
the mean length are those of the whole corpus (one number per vocabulary entry, so bounded whatever the corpus). A
seed document opens a window; the unused documents that share a term with it follow by their BM25 score over all of its
terms until the window is full. The last one is cut there and its rest is the next seed, so only the last window of a shard has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.llm.tokens import default_ranks, default_tokenizer, encoder
from classlens.sources.workdir import stage

LENGTH = 2048
END = 1
#: Tokens of a shard: its index takes about twenty times as many bytes.
SHARD_TOKENS = 3_000_000
#: A document is dealt by its heaviest term that at least so many documents hold.
SHARED = 100
#: Groups that are dealt as one have up to this part of a shard's tokens, or so many windows if these are more.
UNITS = 16
WINDOWS = 4
#: Shards that a task gets on average; each task leaves one partly filled.
SHARDS = 2
SHINGLE = 5
K1, B = 1.2, 0.75
#: Neighbours that are sorted first.
HEAD = 32
#: A shard's index is cut down when fewer of its documents are unused.
KEPT = 0.8
#: Characters encoded, and ids looked at, at a time; work arrays are about twenty times as large.
CHARS = 10 << 20
IDS = 1 << 16


def _runs(sizes: list[int], bound: int):
    """Stretches of rows of about so much in all, at least one row each."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= bound:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _encode(path: str, ranks: str | None, end: int):
    def encode(batches):
        tokens = encoder(path, ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _runs([len(t or "") + 1 for t in texts], CHARS):
                blobs = tokens.encode_all(texts[a:b], end)
                parts = list(_parts(blobs, tokens.kind))
                columns = [batch.column("key").slice(a, b - a), pa.array(np.concatenate([sizes for _, sizes in parts]))]
                columns += [pa.array(blobs, pa.binary()), pa.array(np.concatenate([_least(*part) for part in parts]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "ids", "least"])

    return encode


def _parts(blobs: list[bytes], kind: np.dtype):
    """``(ids, sizes)`` of stretches of rows, the ids of their rows one after another."""
    sizes = [len(x) // kind.itemsize for x in blobs]
    for a, b in _runs(sizes, IDS):
        yield np.frombuffer(b"".join(blobs[a:b]), kind), np.array(sizes[a:b])


def _terms(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of the distinct ids of rows that stand one after another."""
    wide = np.uint32 if len(sizes) <= 1 << 16 and flat.dtype.itemsize == 2 else np.uint64
    shift = wide(16 if wide is np.uint32 else 32)
    pairs = np.repeat(np.arange(len(sizes), dtype=wide) << shift, sizes)
    pairs |= flat
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    tf = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    return (pairs >> shift).astype(np.int64), (pairs & ((wide(1) << shift) - wide(1))).astype(np.int64), tf


def _frequencies(kind: np.dtype):
    def frequencies(batches):
        """Documents that hold each token id, of one task."""
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in _parts(batch.column("ids").to_pylist(), kind):
                own = np.bincount(_terms(*part)[1], minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    return frequencies


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, hashed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The smallest hash of each row's runs of ids, shorter ones for short rows."""
    x = np.zeros(len(flat), np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    left = np.repeat(sizes, sizes) - place
    least = np.zeros(len(sizes), np.uint64)
    for run in range(1, SHINGLE + 1):
        end = len(flat) - run + 1
        x = _mixed(x[:end] * np.uint64(31) + flat[run - 1 :] + np.uint64(1))
        mine = sizes == run if run < SHINGLE else sizes >= run
        if mine.any():
            whole = np.full(len(flat), np.iinfo(np.uint64).max)
            whole[:end] = np.where(left[:end] >= run, x, whole[:end])
            least[mine] = np.minimum.reduceat(whole, first)[mine]
    return (least >> np.uint64(1)).astype(np.int64)


def _topics(flat: np.ndarray, sizes: np.ndarray, df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The heaviest of the terms of each row that many documents hold, -1 if there is none."""
    row, term, tf = _terms(flat, sizes)
    weight = np.where(df[term] >= SHARED, idf[term] * tf / (tf + K1), -1)
    count = np.bincount(row)
    best = np.maximum.reduceat(weight, np.cumsum(count) - count)
    at = np.flatnonzero(weight == np.repeat(best, count))
    return np.where(best >= 0, term[at[np.searchsorted(row[at], np.arange(len(sizes)))]], -1)


def _contents(kind: np.dtype, df: np.ndarray, idf: np.ndarray, kept: list[str]):
    def contents(batches):
        """The kept columns with the topic that a row's ids lead to."""
        for batch in batches:
            topics = [_topics(*part, df, idf) for part in _parts(batch.column("ids").to_pylist(), kind)]
            topics.append(np.zeros(0, np.int64))
            columns = [*(batch.column(c) for c in kept), pa.array(np.concatenate(topics))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "topic"])

    return contents


def _dealt(placed: DataFrame, groups: DataFrame, total: int, shard_tokens: int, length: int) -> DataFrame:
    """Rows of one topic or of one least shingle together, in tasks of some shards, as far as they fit into a unit.

    ``groups`` has ``(topic, least, tokens)``.
    """
    unit = max(shard_tokens // UNITS, WINDOWS * length)
    tasks = max(1, total // (SHARDS * shard_tokens))
    parts = F.ceil(F.col("tokens") / unit).cast("bigint")
    # At most as many rows as there are units in the corpus.
    copies = F.broadcast(groups.where(F.col("tokens") > unit).select("topic", "least", parts.alias("copies")))
    topics = groups.groupBy("topic").agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > unit)
    topics = F.broadcast(topics.select("topic", parts.alias("parts")))
    both = placed.join(topics, "topic", "left").join(copies, ["topic", "least"], "left")
    row = F.xxhash64(F.lit(1), "key", "ids")
    part = F.pmod(F.xxhash64("least"), F.coalesce("parts", F.lit(1)))
    copy = F.pmod(row, F.coalesce("copies", F.lit(1)))
    both = both.select("key", "ids", F.xxhash64("topic", part, copy).alias("unit"), "least", row.alias("row"))
    return both.repartition(tasks, "unit").sortWithinPartitions("unit", "least", "row").select("key", "ids")


class _Index:
    """Inverted index of a shard: postings by term, with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.idf = docs, idf
        self.n = np.array([len(d) for d in docs])
        wide = np.uint32 if len(docs) <= 1 << 16 and len(idf) <= 1 << 16 else np.uint64
        shift = wide(16 if wide is np.uint32 else 32)
        of = np.repeat(np.arange(len(docs), dtype=wide), self.n)
        pairs = np.concatenate(docs).astype(wide)
        pairs <<= shift
        pairs |= of
        pairs, tf = np.unique(pairs, return_counts=True)
        term, self.doc = (pairs >> shift).astype(np.int64), (pairs & ((wide(1) << shift) - wide(1))).astype(np.int64)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.n[self.doc] / mean))
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        self.held = len(docs)
        self.found = np.empty(0, np.int64), np.empty(0)

    def keep(self, unused: np.ndarray) -> None:
        """Drop the postings of the other documents, which no later seed can take."""
        left = unused[self.doc]
        self.first = np.concatenate([[0], np.cumsum(left)])[self.first]
        self.doc, self.weight, self.held = self.doc[left], self.weight[left], int(unused.sum())

    def terms(self, seed: int) -> np.ndarray:
        """The seed's terms, each once."""
        return np.unique(self.docs[seed]).astype(np.int64)

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term, best first, ties by order."""
        return np.array(list(self.best(seed, unused)), np.int64)

    def best(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The ranked documents one by one."""
        terms = self.terms(seed)
        first, end = self.first[terms], self.first[terms + 1]
        spans, size = [slice(a, b) for a, b in zip(first.tolist(), end.tolist())], int((end - first).sum())
        if size > len(self.found[0]):
            self.found = np.empty(2 * size, np.int64), np.empty(2 * size)
        doc, weight = (x[:size] for x in self.found)
        np.concatenate([self.doc[s] for s in spans], out=doc)
        np.concatenate([self.weight[s] for s in spans], out=weight)
        score = np.bincount(doc, weight, len(self.docs))
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        score = score[found]
        if len(found) > HEAD:
            # The best are usually enough; ties with the last of them are among them.
            head = score >= np.partition(score, len(score) - HEAD)[len(score) - HEAD]
            yield from found[head][np.argsort(-score[head], kind="stable")].tolist()
            found, score = found[~head], score[~head]
        yield from found[np.argsort(-score, kind="stable")].tolist()


def _order(docs: list[np.ndarray], index: _Index, length: int):
    """Documents in packing order: a seed, its neighbours until the window is full, the one that is cut, and so on."""
    unused = np.ones(len(docs), bool)
    fill, following = 0, 0
    seed = None
    while True:
        if seed is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            seed = following
            unused[seed] = False
            yield seed
            fill = (fill + len(docs[seed])) % length
        room, last = length - fill if fill else 0, None
        if room:
            if unused.sum() < KEPT * index.held:
                index.keep(unused)
            for d in index.best(seed, unused):
                unused[d] = False
                yield d
                room -= len(docs[d])
                if room <= 0:
                    last = d
                    break
            fill = (length - room) % length
        seed = last if room < 0 else None


def _pack(length: int, kind: np.dtype, idf: np.ndarray, mean: float, shard_tokens: int):
    def shards(batches):
        keys, docs, size = [], [], 0
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                keys.append(key)
                docs.append(np.frombuffer(ids, kind))
                size += len(docs[-1])
                if size >= shard_tokens:
                    yield keys, docs
                    keys, docs, size = [], [], 0
        if docs:
            yield keys, docs

    def pack(batches):
        sequence = TaskContext.get().partitionId() << 32
        schema = None
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("key", first.schema.field("key").type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
            + [(c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset")]
        )
        for keys, docs in shards(_chain(first, batches)):
            rows, place = [], 0
            for d in _order(docs, _Index(docs, idf, mean), length):
                start = 0
                while start < len(docs[d]):
                    take = min(len(docs[d]) - start, length - place % length)
                    ids = docs[d][start : start + take].astype("<u4").tobytes()
                    rows.append((keys[d], start, take, ids, len(docs[d]), sequence + place // length, place % length))
                    start, place = start + take, place + take
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            sequence += -(-place // length)

    return pack


def _chain(first, rest):
    yield first
    yield from rest


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    tokenizer: str | None = None,
    ranks: str | None = None,
    end: int = END,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of ``length``.

    Returns ``(key, start, length, ids, doc_tokens, sequence_id, offset)`` per piece; ``ids`` are little-endian unsigned
    32-bit numbers. A document is its ids and ``end``; a null or empty text is ``end`` alone. Repeated rows and rows of
    one key are documents of their own. Longer documents fill windows of their own first. Other columns are ignored.
    Empty in, empty out. ``tokenizer`` and ``ranks`` name files that all executors have; ``ranks`` may stay unset
    for a tokenizer of one's own.
    """
    kind = docs.schema[key].dataType.simpleString()
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer(), default_ranks()
    width = encoder(tokenizer, ranks).kind
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    encoded = rows.mapInArrow(_encode(tokenizer, ranks, end), f"key {kind}, n long, ids binary, least long")
    tokens = stage(encoded, "tokens")
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = tokens.select("ids").mapInArrow(_frequencies(width), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.collect()  # a row per vocabulary entry at most
    df = np.zeros(max((r["term"] for r in found), default=0) + 1)
    for r in found:
        df[r["term"]] = r["n"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    # The ids are staged once; their topics are found twice, for the sizes of the groups and for the rows.
    small = tokens.mapInArrow(_contents(width, df, idf, ["n", "least"]), "n long, least long, topic long")
    groups = stage(small.groupBy("topic", "least").agg(F.sum("n").alias("tokens")), "groups")
    columns = f"key {kind}, ids binary, least long, topic long"
    placed = tokens.mapInArrow(_contents(width, df, idf, ["key", "ids", "least"]), columns)
    out = _dealt(placed, groups, total or 0, shard_tokens, length).mapInArrow(
        _pack(length, width, idf, (total or 0) / max(n, 1), shard_tokens),
        f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return out.withColumnRenamed("key", key)


def pieces(docs: DataFrame) -> DataFrame:
    """The packed pieces with the checksum of their ids instead of the ids."""
    crc = F.crc32("ids").alias("ids_crc32")
    return pack(docs).select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
