"""Removal of word sequences that occur earlier in the corpus, by fixed-block anchors.

Any window of ``window`` words holds a whole block of ``window // 2`` words that starts at a multiple of the block
length in its document. So the non-overlapping blocks of every document are indexed by hash, every rolling window
of block length is probed, and only windows around a hit are extended to the full length and compared by 96-bit
hash. Consecutive windows join up to maximal exact repeats. All hashes live in hash parts (see ``batches``): the
index is never in one place, and a hash that is everywhere is sent once per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.llm.batches import BATCH_BYTES, batch_count, dealt, in_order
from classlens.llm.grams import Words, as_bytes, in_sorted

_SHIFT = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part number above 32 bits of the hash; a false match only adds a window that is compared in full."""
    return (((hashes >> _SHIFT) % np.uint64(parts)) << _SHIFT) | (hashes & _LOW)


def _split(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys."""
    return np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << _SHIFT)


class _Blocks:
    """Anchor hashes of a batch: all rolling keys, and the distinct keys with their kind."""

    def __init__(self, words: Words, block: int, parts: int):
        self.valid = words.within(block)
        self.keys = _keys(words.hashes(block), parts)
        own = self.keys[self.valid]
        self.distinct, counts = np.unique(own, return_counts=True)
        aligned = np.unique(self.keys[self.valid & (words.place() % block == 0)])
        self.indexed = in_sorted(self.distinct, aligned)
        self.repeated = counts > 1


def _send(parts: int, block: int):
    def send(key, table):
        b = _Blocks(Words(as_bytes(in_order(table).column("text"))), block, parts)
        cuts = _split(b.distinct, parts)
        rows = {"part": [], "batch": [], "index": [], "known": [], "probes": []}
        for p in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[p], cuts[p + 1])
            low = (b.distinct[at] & _LOW).astype(np.uint32)
            indexed, repeated = b.indexed[at], b.repeated[at]
            rows["part"].append(int(p))
            rows["batch"].append(key[0].as_py())
            rows["index"].append(low[indexed & ~repeated].tobytes())
            rows["known"].append(low[indexed & repeated].tobytes())
            rows["probes"].append(low[~indexed].tobytes())
        return pa.table(rows, schema=_SENT)

    return send


_SENT = pa.schema(
    [("part", pa.int32()), ("batch", pa.int32()), ("index", pa.binary()), ("known", pa.binary()), ("probes", pa.binary())]
)
_HITS = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("hits", pa.binary())])


def _answer(key, table):
    """Of the keys of each batch, those that some batch has indexed and that occur elsewhere too."""
    blobs = {c: [np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("index", "known", "probes")}
    every = np.concatenate([x for c in blobs.values() for x in c])
    indexed = np.unique(np.concatenate(blobs["index"] + blobs["known"]))
    distinct, counts = np.unique(every, return_counts=True)
    wanted = distinct[(counts > 1) & in_sorted(distinct, indexed)]
    rows = {"batch": [], "part": [], "hits": []}
    for i, batch in enumerate(table.column("batch").to_pylist()):
        hits = [x[in_sorted(x, wanted)] for x in (blobs["index"][i], blobs["probes"][i])]
        if len(hits[0]) + len(hits[1]):
            rows["batch"].append(batch)
            rows["part"].append(key[0].as_py())
            rows["hits"].append(np.concatenate(hits).tobytes())
    return pa.table(rows, schema=_HITS)


_FULL = np.dtype([("h", "<u8"), ("g", "<u4"), ("at", "<u4")])
_WINDOWS = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("own", pa.bool_()), ("blob", pa.binary())])
_REPEATS = pa.schema([("batch", pa.int32()), ("own", pa.bool_()), ("blob", pa.binary())])


def _runs(marks: np.ndarray) -> bytes:
    """(start, end) of the runs of marked positions."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges.astype(np.uint32).tobytes()


def _extend(parts: int, block: int, window: int):
    def extend(key, docs, hits):
        rows = {"part": [], "batch": [], "own": [], "blob": []}
        if docs.num_rows == 0:
            return pa.table(rows, schema=_WINDOWS)
        words = Words(as_bytes(in_order(docs).column("text")))
        b = _Blocks(words, block, parts)
        known = [b.distinct[b.indexed & b.repeated]]
        for p, blob in zip(hits.column("part").to_pylist(), hits.column("hits").to_pylist()):
            known.append(np.frombuffer(blob, np.uint32).astype(np.uint64) | (np.uint64(p) << _SHIFT))
        hit = in_sorted(b.keys, np.sort(np.concatenate(known))) & b.valid
        upto = np.concatenate([[0], np.cumsum(hit)])
        reach = window - block + 1
        start = np.arange(words.n)
        near = upto[np.minimum(start + reach, words.n)] > upto[start]
        at = np.flatnonzero(near & words.within(window))
        if len(at):
            full = np.empty(len(at), _FULL)
            full["h"], full["at"] = words.hashes(window)[at], at
            full["g"] = (words.hashes(window, 1)[at] & _LOW).astype(np.uint32)
            full = full[np.lexsort((full["at"], full["g"], full["h"]))]
            again = np.concatenate([[False], (full["h"][1:] == full["h"][:-1]) & (full["g"][1:] == full["g"][:-1])])
            marks = np.zeros(words.n, bool)
            marks[full["at"][again]] = True
            batch = key[0].as_py()
            rows["part"].append(batch % parts)
            rows["batch"].append(batch)
            rows["own"].append(True)
            rows["blob"].append(_runs(marks))
            full = full[~again]
            to = (full["h"] >> _SHIFT) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            full, cuts = full[order], np.searchsorted(to[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                rows["part"].append(int(p))
                rows["batch"].append(batch)
                rows["own"].append(False)
                rows["blob"].append(full[cuts[p] : cuts[p + 1]].tobytes())
        return pa.table(rows, schema=_WINDOWS)

    return extend


def _first(key, table):
    """Of each window's batches all but the first are told where it repeats; runs found inside a batch pass through."""
    rows = {"batch": [], "own": [], "blob": []}
    own = table.column("own").to_pylist()
    batches, blobs = table.column("batch").to_pylist(), table.column("blob").to_pylist()
    for batch, mine, blob in zip(batches, own, blobs):
        if mine:
            rows["batch"].append(batch)
            rows["own"].append(True)
            rows["blob"].append(blob)
    sent = [(b, np.frombuffer(x, _FULL)) for b, mine, x in zip(batches, own, blobs) if not mine]
    if sent:
        full = np.concatenate([x for _, x in sent])
        of = np.repeat(np.array([b for b, _ in sent]), [len(x) for _, x in sent])
        order = np.lexsort((of, full["g"], full["h"]))
        full, of = full[order], of[order]
        again = np.concatenate([[False], (full["h"][1:] == full["h"][:-1]) & (full["g"][1:] == full["g"][:-1])])
        at, of = full["at"][again], of[again]
        for batch in np.unique(of):
            rows["batch"].append(int(batch))
            rows["own"].append(False)
            rows["blob"].append(np.sort(at[of == batch]).tobytes())
    return pa.table(rows, schema=_REPEATS)


def _cut(window: int):
    def cut(key, docs, repeats):
        kind = docs.schema.field("id").type
        schema = pa.schema([("id", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
        if docs.num_rows == 0:
            return schema.empty_table()
        docs = in_order(docs)
        texts = as_bytes(docs.column("text"))
        split = [t.split() if t else [] for t in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in split])])
        change = np.zeros(int(first[-1]) + window + 1, np.int64)
        for own, blob in zip(repeats.column("own").to_pylist(), repeats.column("blob").to_pylist()):
            at = np.frombuffer(blob, np.uint32).astype(np.int64)
            if own:  # runs of starts
                np.add.at(change, at[::2], 1)
                np.add.at(change, at[1::2] - 1 + window, -1)
            else:
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
        kept = np.cumsum(change)[: int(first[-1])] == 0
        left = np.diff(np.concatenate([[0], np.cumsum(kept)])[first])
        out = []
        for d, x in enumerate(split):
            if left[d] < len(x):
                x = [x[i] for i in np.flatnonzero(kept[first[d] : first[d + 1]])]
            out.append(b" ".join(x))
        n = np.diff(first)
        columns = [docs.column("id").combine_chunks(), pa.array(n), pa.array(n - left)]
        return pa.table([*columns, pa.array(out, pa.binary()).cast(pa.string())], schema=schema)

    return cut


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that starts earlier in the corpus as well.

    Earlier is a smaller key, or the same document and a smaller place. Windows are judged on the input. Returns
    ``(key, n_words, n_removed, kept_text)`` per row, kept words joined by one space. A null, empty or blank text
    has no words and an empty kept text; a text shorter than a window keeps all words. Rows that share a key are
    ordered by text. A null key counts as the smallest. Other columns are ignored. Empty in, empty out.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    block = (window + 1) // 2
    n = batch_count(docs, text, batch_bytes)
    batches = dealt(docs, key, text, n)
    sent = batches.groupBy("batch").applyInArrow(
        _send(n, block), "part int, batch int, index binary, known binary, probes binary"
    )
    hits = sent.groupBy("part").applyInArrow(_answer, "batch int, part int, hits binary")
    windows = (
        batches.groupBy("batch")
        .cogroup(hits.groupBy("batch"))
        .applyInArrow(_extend(n, block, window), "part int, batch int, own boolean, blob binary")
    )
    repeats = windows.groupBy("part").applyInArrow(_first, "batch int, own boolean, blob binary")
    out = (
        batches.groupBy("batch")
        .cogroup(repeats.groupBy("batch"))
        .applyInArrow(
            _cut(window),
            f"id {docs.schema[key].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_text string",
        )
    )
    return out.withColumnRenamed("id", key)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
