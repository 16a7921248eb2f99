"""Similarity join of word-shingle sets by PartEnum signatures, and the components of its links.

Sets are dealt into bands of size in which linked sets differ in at most k shingles. The shingle domain is cut into
groups of four cells, so many that some group holds at most one difference: three of its cells then agree, and the hash
of a set's shingles in them is a signature that linked sets share. All three-cell subsets of all groups are
enumerated. Empty projections are no signatures; a set so small or lopsided that its differences could hide in
all groups that it fills adds its shingles of lowest hash, as many as cannot all differ. So no link is lost.

Before that, shingles are counted across documents: a document whose shingles are not shared to three quarters links with
nothing. Equal sets are collapsed to one. Links are searched in two rounds. The first compares each set with the one
it shares most signatures with among the first holders of its signatures, one comparison per set. The second looks
at signatures that still span several components and compares all pairs of different components that a
parity sketch (a lower bound of the difference) admits. Candidates are always compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.llm.batches import BATCH_BYTES, batch_count, dealt, in_order
from classlens.llm.components import components
from classlens.llm.grams import Words, as_bytes, in_sorted, mix
from classlens.sources.workdir import stage

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 3, 4
#: Groups beyond the least number, so that few sets have too few filled cells.
SLACK = 1.1
#: Signatures per set and band of the first round, the smallest ones; the second round takes all.
FIRST = 16
#: Holders of one signature that are compared in one unit of work.
BLOCK = 4096
#: The longest parity sketch; it rules pairs out and never decides that sets link.
SKETCH_BITS = 1 << 15
_SHIFT, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; of the whole text if it is shorter."""
    words = Words(texts, lower=True)
    hashes = words.hashes(k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        out.append(np.unique(hashes[a : max(b - k + 1, a + 1)]) if b > a else hashes[:0])
    return out


def _parted(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> _SHIFT) % np.uint64(parts)) << _SHIFT) | (hashes & _LOW)


def _send(parts: int, k: int):
    def send(key, table):
        sets = shingle_sets(as_bytes(in_order(table).column("text")), k)
        own = [_parted(s, parts) for s in sets]
        distinct, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64),) * 2
        cuts = np.searchsorted(distinct, np.arange(parts + 1, dtype=np.uint64) << _SHIFT)
        rows = {"part": [], "batch": [], "single": [], "shared": []}
        for p in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[p], cuts[p + 1])
            low, many = (distinct[at] & _LOW).astype(np.uint32), counts[at] > 1
            rows["part"].append(int(p))
            rows["batch"].append(key[0].as_py())
            rows["single"].append(low[~many].tobytes())
            rows["shared"].append(low[many].tobytes())
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    return send


def _answer(key, table):
    """Of the shingles that a batch has in one document only, those that other batches have too."""
    single = [np.frombuffer(x, np.uint32) for x in table.column("single").to_pylist()]
    shared = [np.frombuffer(x, np.uint32) for x in table.column("shared").to_pylist()]
    distinct, counts = np.unique(np.concatenate(single + shared), return_counts=True)
    wanted = distinct[counts > 1]
    rows = {"batch": [], "part": [], "hits": []}
    for batch, own in zip(table.column("batch").to_pylist(), single):
        hits = own[in_sorted(own, wanted)]
        if len(hits):
            rows["batch"].append(batch)
            rows["part"].append(key[0].as_py())
            rows["hits"].append(hits.tobytes())
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))


def _keep(parts: int, k: int, num: int, den: int):
    def keep(key, docs, hits):
        kind = docs.schema.field("id").type
        names, kinds = ["id", "n", "set"], [kind, pa.int64(), pa.binary()]
        if docs.num_rows == 0:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        docs = in_order(docs)
        sets = shingle_sets(as_bytes(docs.column("text")), k)
        own = [_parted(s, parts) for s in sets]
        distinct, counts = np.unique(np.concatenate(own), return_counts=True)
        known = [distinct[counts > 1]]
        for p, blob in zip(hits.column("part").to_pylist(), hits.column("hits").to_pylist()):
            known.append(np.frombuffer(blob, np.uint32).astype(np.uint64) | (np.uint64(p) << _SHIFT))
        known = np.sort(np.concatenate(known))
        blobs = []
        for s, o in zip(sets, own):
            linkable = len(s) and den * int(in_sorted(o, known).sum()) >= num * len(s)
            blobs.append(s.tobytes() if linkable else None)
        n = pa.array([len(s) for s in sets], pa.int64())
        return pa.table([docs.column("id").combine_chunks(), n, pa.array(blobs, pa.binary())], names=names)

    return keep


class Bands:
    """Bands of set size: sets that link lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * self.den // self.num))
        return int(np.searchsorted(self.high, n))

    def differences(self, band: int) -> int:
        """Most shingles in which linked sets differ, if one is of this band and the other of this or the next."""
        most = self.high[band]
        return (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def signatures(hashes: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """(band, 64-bit signatures) of a set of sorted hashes, for its band and the one below."""
    own = bands.of(len(hashes))
    out = []
    with np.errstate(over="ignore"):
        mixed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
        for band in (own, own - 1) if own else (own,):
            k = bands.differences(band)
            tag = mix(np.array([band + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if k == 0:
                out.append((band, mix(mixed.sum(dtype=np.uint64, keepdims=True) + tag)))
                continue
            groups = int(np.ceil((k + 1) / 2 * SLACK))
            cell = (((hashes >> _SHIFT) * np.uint64(groups)) >> _SHIFT).astype(np.int64) * 4 + (hashes & np.uint64(3)).astype(np.int64)
            sums = np.zeros(groups * 4, np.uint64)
            np.add.at(sums, cell, mixed)
            filled = np.bincount(cell, minlength=groups * 4).reshape(groups, 4)
            sums = sums.reshape(groups, 4)
            rest = sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums
            some = filled.sum(axis=1, keepdims=True) > filled
            name = mix(np.arange(groups * 4, dtype=np.uint64) + tag).reshape(groups, 4)
            found = [mix(rest[some] + name[some])]
            if np.minimum((filled > 0).sum(axis=1), 2).sum() <= k:
                needed = -(-len(hashes) * bands.num // bands.den)
                found.append(mix(hashes[: len(hashes) - needed + 1] + tag * np.uint64(7)))
            out.append((band, np.unique(np.concatenate(found))))
    return out


_ENTRY = np.dtype([("sig", "<u4"), ("group", "<i8"), ("rep", "<i8")])


def _sign(parts: int, num: int, den: int, first: int | None = None):
    """Blobs of (signature, component, set) by part, of an Arrow batch of sets; of the ``first`` smallest or all."""

    def sign(batches):
        bands = Bands(num, den)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                entries, to = [], []
                for rep, group, blob in zip(*(part.column(c).to_pylist() for c in ("rep", "group", "set"))):
                    sigs = np.concatenate([s[:first] for _, s in signatures(np.frombuffer(blob, np.uint64), bands)])
                    e = np.empty(len(sigs), _ENTRY)
                    e["sig"], e["group"], e["rep"] = sigs & _LOW, group, rep
                    entries.append(e)
                    to.append(((sigs >> _SHIFT) % np.uint64(parts)).astype(np.int64))
                to = np.concatenate(to)
                order = np.argsort(to, kind="stable")
                entries, cuts = np.concatenate(entries)[order], np.searchsorted(to[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                blobs = [entries[cuts[p] : cuts[p + 1]].tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return sign


def _entries(table) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("blob").to_pylist()])


def _leaders(key, table):
    """(set, first holder of a signature, number of such signatures) of a part."""
    e = _entries(table)
    e = e[np.lexsort((e["rep"], e["sig"]))]
    first = np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])
    pairs = np.stack([e["rep"], e["rep"][first][np.cumsum(first) - 1]], axis=1)[~first]
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs, n = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _conflicts(key, table):
    """Holders of the signatures of a part that span several components."""
    e = _entries(table)
    e = e[np.lexsort((e["group"], e["sig"]))]
    first = np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])
    other = ~first & np.concatenate([[False], e["group"][1:] != e["group"][:-1]])
    of = np.cumsum(first) - 1
    e = e[np.bincount(of, other, of[-1] + 1)[of] > 0]
    part = pa.array(np.full(len(e), key[0].as_py(), np.int32))
    return pa.table([part, pa.array(e["sig"].astype(np.int64)), pa.array(e["rep"])], names=["part", "sig", "rep"])


def _sketch(batches):
    """Parity bits of a set: each shingle flips one of 512 bits or of the power of two above eight times the set."""
    for batch in batches:
        out, sizes = [], []
        for blob in batch.column("set").to_pylist():
            h = np.frombuffer(blob, np.uint64)
            size = min(max(512, 1 << (8 * len(h) - 1).bit_length()), SKETCH_BITS)
            bits = np.bincount((mix(h) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
            out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
            sizes.append(len(h))
        columns = [batch.column(c) for c in ("rep", "group")]
        names = ["rep", "group", "n", "sketch"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names)


class _Sketches:
    """Sketches of several lengths. Halves that are laid over each other by XOR give the sketch of half the length."""

    def __init__(self, blobs: list[bytes]):
        words = np.array([len(x) // 8 for x in blobs])
        self.level = np.round(np.log2(np.maximum(words, 8) // 8)).astype(np.int64)
        self.place, self.rows = [], []
        for level in range(int(self.level.max(initial=0)) + 1):
            width, members = 8 << level, np.flatnonzero(self.level >= level)
            place = np.full(len(blobs), -1)
            place[members] = np.arange(len(members))
            rows = np.empty((len(members), width), np.uint64)
            for own in np.unique(words[members]):
                same = members[words[members] == own]
                full = np.frombuffer(b"".join(blobs[i] for i in same), np.uint64).reshape(len(same), -1, width)
                rows[place[same]] = np.bitwise_xor.reduce(full, axis=1)
            self.place.append(place)
            self.rows.append(rows)

    def apart(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """Bits in which sketches differ, at most the number of shingles in which the sets differ."""
        rows, place = self.rows[level], self.place[level]
        return np.bitwise_count(rows[place[i]] ^ rows[place[j]]).sum(axis=1, dtype=np.int64)


def _admitted(num: int, den: int):
    def admitted(key, table):
        """Pairs of different components whose sizes and sketches allow a link.

        Holders stand sorted by signature; pairs at growing distance are looked at for all signatures at once, first by
        512 bits, and where these allow it by the longest sketch that both have. A unit of two blocks of one signature
        pairs the blocks only.
        """
        table = table.sort_by([("sig", "ascending"), ("rep", "ascending")])
        sig, rep, group, n, block = (table.column(c).to_numpy() for c in ("sig", "rep", "group", "n", "block"))
        sketches = _Sketches(table.column("sketch").to_pylist())
        across = key[1].as_py() != key[2].as_py()
        found, at, lag = [np.zeros((0, 2), np.int64)], np.arange(len(sig)), 0

        def allowed(i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
            return sketches.apart(i, j, level) * (den + num) <= (den - num) * (n[i] + n[j])

        while len(at):
            lag += 1
            at = at[at + lag < len(sig)]
            at = at[sig[at] == sig[at + lag]]
            to = at + lag
            some = group[at] != group[to]
            if across:
                some &= block[at] != block[to]
            i, j = at[some], to[some]
            some = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            i, j = i[some], j[some]
            some = allowed(i, j, 0)
            i, j = i[some], j[some]
            both = np.minimum(sketches.level[i], sketches.level[j])
            some = both == 0
            for level in np.unique(both[~some]):
                own = np.flatnonzero(both == level)
                some[own] = allowed(i[own], j[own], level)
            if some.any():
                found.append(np.unique(np.stack([rep[i[some]], rep[j[some]]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return admitted


def _units(holders: DataFrame) -> DataFrame:
    """Holders by unit of work: a part, or for a signature with many holders each pair of its blocks."""
    m = holders.groupBy("sig", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    large = m.where("blocks > 1")
    out = holders.join(large, ["sig", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") > 1, F.concat_ws(".", "part", "sig")).otherwise(F.col("part").cast("string"))
    return out.select("sig", "rep", "block", unit.alias("unit"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _compared(num: int, den: int):
    def compared(batches):
        """The pairs that link, without those that close a circle in their task."""
        head: dict[int, int] = {}

        def root(i: int) -> int:
            while head.get(i, i) != i:
                head[i] = head.get(head[i], head[i])
                i = head[i]
            return i

        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if root(i) == root(j):
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(in_sorted(x, y).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    head[root(i)] = root(j)
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compared


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stage(both.mapInArrow(_compared(num, den), "a long, b long"), "links")


def join_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = (NUM, DEN),
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row: the smallest key that links of the threshold or more lead to.

    A set is a text's distinct shingles, A-Z in lower case; a text of fewer words is one shingle, a null, empty or
    blank text has none and links with nothing. Rows that share a key are rows of their own; a null key counts as
    larger than any other. Other columns are ignored. Empty in, empty out. The threshold is at least one half.
    """
    num, den = threshold
    if not (0 < num < den and 2 * num >= den):
        raise ValueError("the threshold lies in [1/2, 1)")
    kind = docs.schema[key].dataType.simpleString()
    n = batch_count(docs, text, batch_bytes)
    batches = dealt(docs, key, text, n)
    sent = batches.groupBy("batch").applyInArrow(_send(n, shingle), "part int, batch int, single binary, shared binary")
    hits = sent.groupBy("part").applyInArrow(_answer, "batch int, part int, hits binary")
    kept = batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(
        _keep(n, shingle, num, den), f"id {kind}, n long, set binary"
    )
    rows = stage(kept.withColumn("row", F.monotonically_increasing_id()), "sets")
    digest = ["n", "d", "e"]
    some = rows.where("set IS NOT NULL")
    some = some.withColumn("d", F.xxhash64("set")).withColumn("e", F.xxhash64(F.lit(1), F.col("set")))
    classes = stage(some.groupBy(*digest).agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    sets = stage(some.select("row", "set").join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), "set"), "reps")

    few = _sign(n, num, den, FIRST)
    signed = sets.withColumn("group", F.col("rep")).mapInArrow(few, "part int, blob binary")
    leaders = signed.groupBy("part").applyInArrow(_leaders, "a long, b long, n long")
    best = leaders.groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("m"))
    first = _links(best.select("a", (-F.col("m.col2")).alias("b")), sets, num, den)
    near = stage(components(first), "near")
    grouped = sets.join(near, F.col("rep") == F.col("node"), "left")
    grouped = stage(grouped.select("rep", F.coalesce("component", "rep").alias("group"), "set"), "grouped")
    signed = grouped.mapInArrow(_sign(n, num, den), "part int, blob binary")
    open_ = stage(signed.groupBy("part").applyInArrow(_conflicts, "part int, sig long, rep long"), "open")
    held = grouped.join(open_.select("rep").distinct(), "rep", "left_semi")
    sketches = held.mapInArrow(_sketch, "rep long, group long, n long, sketch binary")
    units = _units(open_).join(sketches, "rep").groupBy("unit", "i", "j")
    pairs = units.applyInArrow(_admitted(num, den), "a long, b long").distinct()
    second = _links(pairs, sets, num, den)
    found = stage(components(first.unionByName(second)), "components")

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("*", F.coalesce("component", "rep").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = stage(named.join(least, "c").select(*digest, "component_id"), "named")
    joined = some.select("id", *digest).join(named, digest).select("id", "n", "component_id")
    alone = rows.where("set IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return alone.unionByName(joined).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest key (nulls last), of several the first as stored.

    Rows without shingles (null, empty or blank text) stay. Where keys repeat, each row is judged by itself; to that end
    the rows are staged with a number, which is not needed where keys are unique and not null. Empty in, empty out.
    """
    name = F.col(f"`{key}`")
    unclear = not docs.groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").isEmpty()
    if not unclear:
        found = join_components(docs, key, text, **options)
        gone = found.where(F.col(f"`{key}`") != F.col("component_id")).select(F.col(f"`{key}`").alias("_gone"))
        return docs.join(stage(gone, "gone"), name == F.col("_gone"), "left_anti")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = stage(whole.withColumn("row", F.monotonically_increasing_id()), "numbered")
    flat = rows.select("row", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text}`").alias("text"))
    found = stage(join_components(flat.select("row", "text"), "row", "text", **options), "components-of-rows")
    place = F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("row"))
    heads = found.join(flat.select("row", "key"), "row").groupBy("component_id").agg(F.min(place)["row"].alias("row"))
    return rows.join(stage(heads.select("row"), "heads"), "row", "left_semi").select("doc.*")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
