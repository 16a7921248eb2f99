"""Spearman's rho and Kendall's tau-b for many columns, classes and patterns of missing values at once.

All columns are ranked in one long table keyed by (class, column, value). Ranks of a pair count only the rows on which
both columns are present, so a value has one rank per set of present rows: columns that are null on the same rows share
one, and a complete column adds none. The ranks meet the rows in one look-up on (class, column, value); frequent values
are looked up by broadcast, the others by one shuffle. The input is read three times: for the bucket cuts and the
null patterns, for the counts of the values, and for the look-up.

A few columns of which every pair has a side with few values need no ranks of the rows: equal rows are counted, the other
side is cut into stretches of its values, a task counts the table of one stretch, and the tables are put together from
their totals. Keys take no part in that, and what is shuffled are the distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import melt
from classlens.operators.ranked import MAX_BUCKETS, bucket_count, cut_columns, cuts_table, running_counts, with_bucket
from classlens.sources.workdir import stage

#: A value that holds more than one in so many of a column's rows is looked up by broadcast: fewer than that per column.
HOT_SHARE = 1_000
#: Whole rows are joined one column after the other for so many columns in all, of which so many have rare values.
JOINED_COLUMNS, RARE_COLUMNS = 8, 3
#: Bytes of the rank matrix that a task holds at a time.
SLICE_BYTES = 32 << 20
#: A column with at most so many values has few of them; a number below 2**CODE_BITS stands for each in a row's code, 0 for none.
FEW, CODE_BITS = 127, 7
#: Rows of a stretch of values that are counted in one task.
STRETCH_ROWS = 250_000


def _paired(n: int, against: int | None) -> list[tuple[int, int]]:
    """Pairs of column numbers: all, or those with one column."""
    if against is None:
        return list(combinations(range(n), 2))
    return [(i, against) for i in range(n) if i != against]


class _Ranks:
    """Columns of a table with the ranks that their pairs need.

    ``slot_of[c]`` numbers the set of rows on which column c is present, ``slots[c]`` are the sets by which column c has
    to be ranked, in the order of its rank array. Column names inside are positions, so no name can clash.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], key: str, group: str | None, against: str | None):
        self.columns = list(columns)
        if len(set(self.columns)) < len(self.columns):
            raise ValueError("columns must be distinct")
        self.pairs = _paired(len(self.columns), self.columns.index(against) if against else None)
        self.names = [f"c{i}" for i in range(len(self.columns))]
        self.by = ["grp"] if group else []
        picked = df.where(F.col(f"`{group}`").isNotNull()) if group else df
        self.rows = picked.select(
            *([F.col(f"`{group}`").alias("grp")] if group else []),
            F.col(f"`{key}`").alias("key"),
            *[clean_double(F.col(f"`{c}`")).alias(name) for c, name in zip(self.columns, self.names)],
        )
        self.buckets = bucket_count(df)
        self._survey()

    def _survey(self) -> None:
        """Bucket cuts and null patterns, in one pass. Two columns share a pattern if the 128 bits summed over their nulls agree."""
        marks = []
        for name in self.names:
            missing = F.col(name).isNull()
            marks += [F.count_if(missing).alias(f"{name}_n"), F.count(F.col(name)).alias(f"{name}_t")]
            for seed in (1, 2):
                bits = F.xxhash64(F.lit(seed), F.col("key")).cast("decimal(20,0)")
                marks.append(F.sum(F.when(missing, bits)).alias(f"{name}_{seed}"))
        row = self.rows.agg(*cut_columns(self.names, self.buckets), *marks).first()
        self.sizes = [row[f"{n}_t"] for n in self.names]
        self.cuts = cuts_table(self.rows.sparkSession, self.names, row, self.buckets)
        seen: dict[tuple, int] = {}
        patterns = [(row[f"{n}_n"], row[f"{n}_1"], row[f"{n}_2"]) for n in self.names]
        self.slot_of = [seen.setdefault(p, len(seen)) for p in patterns]
        self.present = [self.names[self.slot_of.index(s)] for s in range(len(seen))]
        needed: list[set[int]] = [set() for _ in self.names]
        for a, b in self.pairs:
            needed[a].add(self.slot_of[b])
            needed[b].add(self.slot_of[a])
        self.slots = [sorted(s) for s in needed]

    def table(self, dense: bool) -> DataFrame:
        """``([grp,] feature, value, hot, ranks)``, staged.

        ``ranks`` are average ranks on each wanted set of rows less their mean; with ``dense`` it is the one
        dense rank over all classes, which keeps the order and is all that counting pairs needs. A value is hot by
        its share of all rows of its column, so there are fewer than ``HOT_SHARE`` of them whatever the classes.
        """
        by = [] if dense else self.by
        sets = [] if dense else self.present
        flags = [F.when(F.col(p).isNotNull(), 1).otherwise(0).alias(f"s{i}") for i, p in enumerate(sets)]
        ids = [*by, *[f"s{i}" for i in range(len(sets))]]
        long = melt(self.rows.select(*by, *flags, *self.names), ids, self.names).where(F.col("value").isNotNull())
        measures = ["t", "d", *[f"s{i}" for i in range(len(sets))]] if dense else ["t", *[f"s{i}" for i in range(len(sets))]]
        counts = long.groupBy(*by, "feature", "value").agg(
            F.count(F.lit(1)).alias("t"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sets))]
        )
        if dense:
            counts = counts.withColumn("d", F.lit(1).cast("bigint"))
        ranked = running_counts(
            with_bucket(counts, self.cuts, self.buckets), [*by, "feature"], ["bucket"], measures
        )
        if dense:
            ranks = F.array(F.col("before_d").cast("double"))
        else:
            every = F.array(*[F.col(f"before_s{i}") + (F.col(f"s{i}") - F.col(f"total_s{i}")) / 2.0 for i in range(len(sets))])
            wanted = F.create_map(
                *[x for n, s in zip(self.names, self.slots) for x in (F.lit(n), F.array(*[F.lit(i) for i in s]).cast("array<int>"))]
            )
            ranks = F.transform(F.element_at(wanted, F.col("feature")), lambda i: F.get(every, i))
        size = F.element_at(F.create_map(*[F.lit(x) for pair in zip(self.names, self.sizes) for x in pair]), F.col("feature"))
        hot = F.col("t") * HOT_SHARE > size
        return stage(ranked.select(*by, "feature", "value", hot.alias("hot"), ranks.alias("ranks")), "ranks")

    def looked_up(self, ranks: DataFrame, dense: bool = False) -> DataFrame:
        """``([grp,] key, cells)``: per row its present columns as ``(f, ranks)``, ``f`` being the column's number."""
        by = [] if dense else self.by
        rare = ranks.where(~F.col("hot")).drop("hot")
        rare_columns = {r["feature"] for r in rare.select("feature").distinct().collect()}
        if len(self.names) <= JOINED_COLUMNS and len(rare_columns) <= RARE_COLUMNS:
            return self._row_by_row(ranks, rare, rare_columns, by)
        on = [*by, "feature", "value"]
        long = melt(self.rows, [*self.by, "key"], self.names).where(F.col("value").isNotNull())
        frequent = ranks.where("hot").select(*on, F.col("ranks").alias("found"))
        probe = long.join(F.broadcast(frequent), on, "left")
        if rare_columns:
            probe = self._salted(probe, F.col("found").isNotNull(), "value")
            known = rare.select(F.lit(0).cast("bigint").alias("salt"), *by, "feature", F.col("value").alias("probe"), "ranks")
            probe = probe.join(known, ["salt", *by, "feature", "probe"], "left").withColumn("found", F.coalesce("found", "ranks"))
        number = F.substring("feature", 2, 9).cast("int").alias("f")
        cells = F.collect_list(F.struct(number, F.col("found").alias("ranks")))  # one per column of the row
        return probe.groupBy(*self.by, "key").agg(cells.alias("cells"))

    def _salted(self, rows: DataFrame, known: Column, value: str) -> DataFrame:
        """Rows that need no look-up are spread by a salt, so that none of them meet under one join key."""
        salt = F.when(known, 1 + F.pmod(F.xxhash64("key"), F.lit(2**30))).otherwise(0).cast("bigint")
        return rows.withColumn("salt", salt).withColumn("probe", F.when(known, 0.0).otherwise(F.col(value)))

    def _row_by_row(self, ranks: DataFrame, rare: DataFrame, rare_columns: set[str], by: list[str]) -> DataFrame:
        wide = self.rows
        for name in self.names:
            frequent = ranks.where(F.col("hot") & (F.col("feature") == name))
            found = frequent.select(*by, F.col("value").alias(name), F.col("ranks").alias(f"r_{name}"))
            wide = wide.join(F.broadcast(found), [*by, name], "left")
        for name in self.names:
            if name in rare_columns:
                known = F.col(f"r_{name}").isNotNull() | F.col(name).isNull()
                own = rare.where(F.col("feature") == name)
                table = own.select(F.lit(0).cast("bigint").alias("salt"), *by, F.col("value").alias("probe"), "ranks")
                joined = self._salted(wide, known, name).join(table, ["salt", *by, "probe"], "left")
                wide = joined.withColumn(f"r_{name}", F.coalesce(f"r_{name}", "ranks")).drop("salt", "probe", "ranks")
        cells = [F.struct(F.lit(i).alias("f"), F.col(f"r_{n}").alias("ranks")) for i, n in enumerate(self.names)]
        return wide.select(*self.by, "key", F.filter(F.array(*cells), lambda x: x["ranks"].isNotNull()).alias("cells"))

    def named(self, sums: DataFrame, group: str | None, *columns: Column) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.columns])
        own = [F.col("grp").alias(group)] if group else []
        return sums.select(*own, F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), *columns)


def _blocks(slot_of: list[int], slots: list[list[int]], pairs: list[tuple[int, int]]) -> list[tuple]:
    """Pairs by the null patterns of both sides: (columns a, places in their rank arrays, columns b, places, members).

    All pairs of a block are one matrix product; ``members`` are the wanted (place of a, place of b, pair).
    """
    by_slots: dict[tuple[int, int], list[int]] = {}
    for p, (a, b) in enumerate(pairs):
        by_slots.setdefault((slot_of[a], slot_of[b]), []).append(p)
    out = []
    for (sa, sb), members in by_slots.items():
        left = sorted({pairs[p][0] for p in members})
        right = sorted({pairs[p][1] for p in members})
        where_a, where_b = {c: i for i, c in enumerate(left)}, {c: i for i, c in enumerate(right)}
        out.append(
            (
                [(c, slots[c].index(sb)) for c in left],
                [(c, slots[c].index(sa)) for c in right],
                np.array([where_a[pairs[p][0]] for p in members]),
                np.array([where_b[pairs[p][1]] for p in members]),
                np.array(members),
            )
        )
    return out


def _cross_products(slot_of: list[int], slots: list[list[int]], pairs: list[tuple[int, int]], grouped: bool):
    """Per task and class: for every pair the number of common rows, both sums of squared ranks and the cross product."""
    blocks = _blocks(slot_of, slots, pairs)
    width = [len(s) for s in slots]
    first = np.concatenate([[0], np.cumsum(width)])

    def sums(row: np.ndarray, f: np.ndarray, start: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros((4, len(pairs)))
        z, seen = np.zeros((n, int(first[-1]))), np.zeros((n, len(width)))
        for c in range(len(width)):
            own = np.flatnonzero(f == c)
            seen[row[own], c] = 1.0
            for k in range(width[c]):
                z[row[own], first[c] + k] = values[start[own] + k]
        for left, right, i, j, members in blocks:
            a, b = z[:, [first[c] + k for c, k in left]], z[:, [first[c] + k for c, k in right]]
            sa, sb = seen[:, [c for c, _ in left]], seen[:, [c for c, _ in right]]
            total[0, members] += (sa.T @ sb)[i, j]
            total[1, members] += ((a * a).T @ sb)[i, j]
            total[2, members] += (sa.T @ (b * b))[i, j]
            total[3, members] += (a.T @ b)[i, j]
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        kind = None
        for batch in batches:
            cells = batch.column("cells").combine_chunks() if isinstance(batch.column("cells"), pa.ChunkedArray) else batch.column("cells")
            lengths = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten()
            f = flat.field("f").to_numpy(zero_copy_only=False)
            ranks = flat.field("ranks")
            begin = ranks.offsets.to_numpy()[: len(f)].astype(np.int64) - (ranks.offsets[0].as_py() if len(f) else 0)
            values = ranks.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            if grouped:
                kind = batch.schema.field("grp").type
                codes = batch.column("grp").dictionary_encode()
                classes, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            else:
                classes, of = [None], np.zeros(batch.num_rows, np.int64)
            step = max(1, SLICE_BYTES // (8 * int(first[-1] + 1)))
            for code, name in enumerate(classes):
                members = np.flatnonzero(of == code)
                for at in range(0, len(members), step):
                    chosen = members[at : at + step]
                    place = np.full(batch.num_rows, -1)
                    place[chosen] = np.arange(len(chosen))
                    mine = np.flatnonzero(place[row] >= 0)
                    found = sums(place[row[mine]], f[mine], begin[mine], values, len(chosen))
                    totals[name] = totals[name] + found if name in totals else found
        a, b = (pa.array([p[k] for p in pairs], pa.int32()) for k in (0, 1))
        for name, found in totals.items():
            columns = [a, b, *[pa.array(x) for x in found]]
            names = ["a", "b", "n", "sxx", "syy", "sxy"]
            if grouped:
                columns, names = [pa.array([name] * len(pairs), kind), *columns], ["grp", *names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _stretch_sums(sides: list[tuple[int, list[int]]], sizes: dict[int, int], grouped: bool):
    """Counts of one stretch of values against each column of few values, one row per pair.

    ``n`` are the rows per value of the few, ``l`` the sums of the ranks inside the stretch, less their mean, ``s1`` and ``s2``
    the sums of these ranks and of their squares, ``ties`` the tied pairs and ``score`` concordant less discordant pairs.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = key[-2].as_py()
        f, others = sides[side]
        known = table.column("value").is_valid().to_numpy(zero_copy_only=False)
        value = table.column("value").to_numpy(zero_copy_only=False)[known]
        codes, count = table.column("codes").to_numpy()[known], table.column("c").to_numpy()[known].astype(float)
        order = np.argsort(value, kind="stable")
        value, codes, count = value[order], codes[order], count[order]
        place = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])).astype(np.int64) if len(value) else np.zeros(0, np.int64)
        rows = []
        for j, other in enumerate(others):
            code = (codes >> (CODE_BITS * j)) & ((1 << CODE_BITS) - 1)
            both = code > 0
            at, c, w = place[both], code[both] - 1, count[both]
            k, n_values = sizes[other], int(place[-1]) + 1 if len(place) else 0
            t = np.bincount(at, w, n_values)
            rank = np.cumsum(t) - t + (t - t.sum()) / 2.0
            n, inner, score = np.zeros(k), np.zeros(k), 0.0
            step = max(1, SLICE_BYTES // (64 * k))
            for low in range(0, n_values, step):
                first, last = np.searchsorted(at, [low, low + step])
                high = min(low + step, n_values)
                m = np.bincount((at[first:last] - low) * k + c[first:last], w[first:last], (high - low) * k).reshape(-1, k)
                score += _score(m, n)
                n += m.sum(0)
                inner += rank[low:high] @ m
            rows.append((side, other, n, inner, float(t @ rank), float(t @ rank**2), float((t * (t - 1.0) / 2.0).sum()), score))
        columns = [pa.array(x) for x in zip(*rows)] if rows else [[] for _ in range(8)]
        columns[0], columns[1] = (pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1))
        columns.insert(2, pa.array([key[-1].as_py()] * len(rows), pa.int32()))
        names = ["side", "other", "bucket", "n", "l", "s1", "s2", "ties", "score"]
        if grouped:
            columns, names = [pa.array([key[0].as_py()] * len(rows), table.schema.field("grp").type), *columns], ["grp", *names]
        return pa.Table.from_arrays(columns, names=names)

    return run


def _score(m: np.ndarray, before: np.ndarray) -> float:
    """Concordant less discordant pairs of a table of counts, also with the rows ``before`` it."""
    above = np.cumsum(m, axis=0) - m + before
    lower = np.cumsum(above, axis=1) - above
    return float((m * (lower - (above.sum(1, keepdims=True) - lower - above))).sum())


def _together(sides: list[tuple[int, list[int]]], pairs: list[tuple[int, int]], grouped: bool):
    """The sums of all pairs of a class from those of the stretches; a pair without a common row has n = 0."""
    number = {p: i for i, p in enumerate(pairs)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = np.zeros((7, len(pairs)))
        parts: dict[tuple[int, int], list[dict]] = {}
        for row in table.to_pylist():
            parts.setdefault((row["side"], row["other"]), []).append(row)
        for (side, other), stretches in parts.items():
            stretches.sort(key=lambda r: r["bucket"])
            f = sides[side][0]
            n = np.array([r["n"] for r in stretches])
            size, totals = n.sum(1), n.sum(0)
            mean = (size.sum() - 1.0) / 2.0
            rank = np.cumsum(totals) - totals + (totals - 1.0) / 2.0 - mean
            shift = np.cumsum(size) - size + (size - 1.0) / 2.0 - mean
            s1, s2, ties, score = (np.array([r[x] for r in stretches]) for x in ("s1", "s2", "ties", "score"))
            spread = float((s2 + 2.0 * s1 * shift + size * shift**2).sum())
            cross = float(((n * shift[:, None] + np.array([r["l"] for r in stretches])) @ rank).sum())
            mine = [spread, float(ties.sum())]
            theirs = [float(totals @ rank**2), float((totals * (totals - 1.0) / 2.0).sum())]
            pair = number.get((f, other))
            if pair is None:
                pair, mine, theirs = number[other, f], theirs, mine
            found[:, pair] = [size.sum(), mine[0], theirs[0], cross, mine[1], theirs[1], score.sum() + _score(n, np.zeros(n.shape[1]))]
        columns = [pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)] + [pa.array(x) for x in found]
        names = ["a", "b", *TOGETHER]
        if grouped:
            columns, names = [pa.array([key[0].as_py()] * len(pairs), table.schema.field("grp").type), *columns], ["grp", *names]
        return pa.Table.from_arrays(columns, names=names)

    return run


TOGETHER = ("n", "sxx", "syy", "sxy", "ties_ra", "ties_rb", "score")


def _counted(df: DataFrame, columns: Sequence[str], group: str | None, against: str | None) -> DataFrame | None:
    """``([group,] col_a, col_b, *TOGETHER)`` of all pairs, or None unless each pair of a few columns has a side of few values."""
    if len(set(columns)) < len(columns):
        raise ValueError("columns must be distinct")
    if not 1 < len(columns) <= JOINED_COLUMNS:
        return None
    pairs = _paired(len(columns), list(columns).index(against) if against else None)
    names, by = [f"c{i}" for i in range(len(columns))], ["grp"] if group else []
    picked = df.where(F.col(f"`{group}`").isNotNull()) if group else df
    # Adding 0.0 makes one value of both zeros.
    doubles = [(clean_double(F.col(f"`{c}`")) + F.lit(0.0)).alias(name) for c, name in zip(columns, names)]
    rows = picked.select(*([F.col(f"`{group}`").alias("grp")] if group else []), *doubles)
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(n).alias(n) for n in names]).first()
    few = {i for i, n in enumerate(names) if first[n] <= FEW}
    if not all(a in few or b in few for a, b in pairs):
        return None
    buckets = min(MAX_BUCKETS, 1 << max(0, (first["n"] // STRETCH_ROWS).bit_length()))
    many = [n for i, n in enumerate(names) if i not in few]
    lists = [F.array_sort(F.collect_set(names[i])).alias(names[i]) for i in sorted(few)]
    row = rows.agg(*cut_columns(many, buckets), *lists).first()
    values = {i: row[names[i]] for i in few}
    if any(len(v) > FEW for v in values.values()):
        return None
    sizes = {i: max(1, len(v)) for i, v in values.items()}

    def code(i: int) -> Column:
        listed = F.array(*[F.lit(v) for v in values[i]]).cast("array<double>")
        return F.coalesce(F.array_position(listed, F.col(names[i])), F.lit(0)).cast("bigint")

    sides: list[tuple[int, list[int]]] = []
    for i in range(len(names)):
        if i not in few:
            sides.append((i, [b if a == i else a for a, b in pairs if i in (a, b)]))
    sides += [(a, [b]) for a, b in pairs if a in few and b in few]

    def cells(chosen: list[int]) -> DataFrame:
        parts = []
        for s in chosen:
            f, others = sides[s]
            codes = F.lit(0).cast("bigint")
            for j, other in enumerate(others):
                codes = codes + F.shiftleft(code(other), CODE_BITS * j)
            value = F.nullif(code(f), F.lit(0)).cast("double") if f in few else F.col(names[f])
            parts.append(
                F.struct(F.lit(s).alias("side"), value.alias("value"), F.when(value.isNull(), 0).otherwise(codes).alias("codes"))
            )
        present = rows.where(F.coalesce(*names).isNotNull())
        long = present.select(*by, F.inline(F.array(*parts)))
        return long.groupBy(*by, "side", "value", "codes").agg(F.count(F.lit(1)).alias("c"))

    one = F.lit(0).cast("int").alias("bucket")
    own = [s for s, (f, _) in enumerate(sides) if f not in few]
    shared = [s for s in range(len(sides)) if s not in own]
    tables = [cells(shared).select("*", one)] if shared else []
    if own:
        cuts = cuts_table(df.sparkSession, many, row, buckets)
        numbers = F.create_map(*[F.lit(x) for s in own for x in (names[sides[s][0]], s)])
        cuts = cuts.select(F.element_at(numbers, F.col("feature")).alias("feature"), "cuts")
        tables.append(with_bucket(cells(own).withColumnRenamed("side", "feature"), cuts, buckets).withColumnRenamed("feature", "side"))
    table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    kind = f"grp {df.schema[group].dataType.simpleString()}, " if group else ""
    stretches = table.groupBy(*by, "side", "bucket").applyInArrow(
        _stretch_sums(sides, sizes, bool(group)),
        kind + "side int, other int, bucket int, n array<double>, l array<double>, s1 double, s2 double, ties double, score double",
    )
    whole = stretches.groupBy(*(by or [F.lit(0).alias("all")])).applyInArrow(
        _together(sides, pairs, bool(group)), kind + "a int, b int, " + ", ".join(f"{x} double" for x in TOGETHER)
    )
    listed = F.array(*[F.lit(c) for c in columns])
    head = [F.col("grp").alias(group)] if group else []
    return whole.select(*head, F.get(listed, F.col("a")).alias("col_a"), F.get(listed, F.col("b")).alias("col_b"), *TOGETHER)


def _rho() -> Column:
    r = F.col("sxy") / (F.sqrt("sxx") * F.sqrt("syy"))
    return F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _tau_b() -> Column:
    n = F.col("n").cast("double")
    possible = n * (n - 1.0) / 2.0
    untied = (possible - F.col("ties_ra")) * (possible - F.col("ties_rb"))
    return F.when(untied > 0, F.try_divide(F.col("score"), F.sqrt(untied)))


def spearman_pairs(
    df: DataFrame, columns: Sequence[str], key: str, group: str | None = None, against: str | None = None
) -> DataFrame:
    """``([group,] col_a, col_b, n, r)``: Spearman's rho of all pairs, or of those with the column ``against``.

    Each pair is ranked on the rows on which both columns are present, inside its class if ``group`` names a column of
    classes. r is NULL when a side is constant on those rows. ``key`` must be unique. Rows without a class are left
    out, and a class without any value has no row.
    """
    head = [F.col(f"`{group}`")] if group else []
    counted = _counted(df, columns, group, against)
    if counted is not None:
        return counted.select(*head, "col_a", "col_b", F.col("n").cast("bigint").alias("n"), _rho().alias("r"))
    ranks = _Ranks(df, columns, key, group, against)
    kind = f"grp {df.schema[group].dataType.simpleString()}, " if group else ""
    partial = ranks.looked_up(ranks.table(dense=False)).drop("key").mapInArrow(
        _cross_products(ranks.slot_of, ranks.slots, ranks.pairs, bool(group)),
        kind + "a int, b int, n double, sxx double, syy double, sxy double",
    )
    sums = partial.groupBy(*ranks.by, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sxx", "syy", "sxy")])
    return ranks.named(sums, group, F.col("n").cast("bigint").alias("n"), _rho().alias("r"))


def _cell_pairs(against: int | None) -> Column:
    """The pairs of present columns of a row, as ``(a, b, ra, rb)``; cells are in the order of the columns."""
    rank = lambda x: F.get(x["ranks"], 0).cast("bigint")

    def with_later(x: Column, i: Column) -> Column:
        later = F.slice(F.col("cells"), i + 2, F.size("cells"))
        return F.transform(
            later, lambda y: F.struct(x["f"].alias("a"), y["f"].alias("b"), rank(x).alias("ra"), rank(y).alias("rb"))
        )

    if against is None:
        return F.flatten(F.transform("cells", with_later))
    target = F.get(F.filter("cells", lambda x: x["f"] == against), 0)
    others = F.filter("cells", lambda x: (x["f"] != against) & target.isNotNull())
    return F.transform(
        others,
        lambda x: F.struct(x["f"].alias("a"), F.lit(against).alias("b"), rank(x).alias("ra"), rank(target).alias("rb")),
    )


def kendall_pairs(
    df: DataFrame, columns: Sequence[str], key: str, group: str | None = None, against: str | None = None
) -> DataFrame:
    """``([group,] col_a, col_b, n, r)``: exact tau-b of all pairs, or of those with ``against``, without comparing rows pairwise.

    The dense rank of ``col_a`` is read as a binary number. At each of its bits, two rows that agree on all
    higher bits and differ in this one are ordered by ``col_a``; whether ``col_b`` orders them the same way
    is a two-class rank count between bit 0 and bit 1. Every untied pair is counted at exactly one bit, so
    the counts add up to concordant minus discordant. Equal (rank, rank) cells collapse first, and the
    column with fewer distinct values of a pair is the one that is read bit by bit. Ranks are taken over all classes: the
    order inside a class is the same. Pairs without a common row (in a class) have no row.
    """
    head = [F.col(f"`{group}`")] if group else []
    counted = _counted(df, columns, group, against)
    if counted is not None:
        return counted.where("n > 0").select(*head, "col_a", "col_b", F.col("n").cast("bigint").alias("n"), _tau_b().alias("r"))
    ranks = _Ranks(df, columns, key, group, against)
    pair = [*ranks.by, "a", "b"]
    wanted = _cell_pairs(ranks.columns.index(against) if against else None)
    table = ranks.table(dense=True)
    top = {r["feature"]: r["top"] for r in table.groupBy("feature").agg(F.max(F.get("ranks", 0)).cast("bigint").alias("top")).collect()}
    tops = F.array(*[F.lit(top.get(name, 0)).cast("bigint") for name in ranks.names])
    cells = stage(
        ranks.looked_up(table, dense=True)
        .select(*ranks.by, F.sort_array("cells").alias("cells"))
        .select(*ranks.by, F.inline(wanted))
        .groupBy(*pair, "ra", "rb")
        .agg(F.count(F.lit(1)).alias("c")),
        "cells",
    )

    def ties(side: str) -> DataFrame:
        grouped = cells.groupBy(*pair, side).agg(F.sum("c").cast("double").alias("t"))
        tied = F.sum(F.col("t") * (F.col("t") - 1.0) / 2.0)
        return grouped.groupBy(*pair).agg(tied.alias(f"ties_{side}"))

    top_a, top_b = F.get(tops, F.col("a")), F.get(tops, F.col("b"))
    fewer = top_a <= top_b
    oriented = cells.select(
        *pair,
        "c",
        F.least(top_a, top_b).alias("top"),
        F.greatest(top_a, top_b).alias("top_other"),
        F.when(fewer, F.col("ra")).otherwise(F.col("rb")).alias("rank"),
        F.when(fewer, F.col("rb")).otherwise(F.col("ra")).alias("other"),
    )
    bits = F.ceil(F.log2(F.col("top") + 1.0)).cast("int")
    levels = F.when(F.col("top") > 0, F.sequence(F.lit(0), bits - 1))
    bucket = F.floor(F.col("other") * ranks.buckets / (F.col("top_other") + 1.0)).cast("int")
    side = [*pair, "level", "prefix"]
    counts = (
        oriented.select(
            *pair, "rank", "other", "c", bucket.alias("bucket"), F.explode(levels).alias("level")
        )
        .withColumn("bit", F.expr("shiftright(rank, level) & 1"))
        .withColumn("prefix", F.expr("shiftright(rank, level + 1)"))
        .groupBy(*side, "bucket", "other")
        .agg(
            F.sum(F.when(F.col("bit") == 0, F.col("c")).otherwise(0)).alias("low"),
            F.sum(F.when(F.col("bit") == 1, F.col("c")).otherwise(0)).alias("high"),
        )
    )
    counted = running_counts(counts, side, ["bucket"], ["low", "high"], "other")
    above = F.col("total_low") - F.col("before_low") - F.col("low")
    score = F.sum(F.col("high").cast("double") * (F.col("before_low") - above).cast("double"))
    out = cells.groupBy(*pair).agg(F.sum("c").alias("n"))
    for part in (ties("ra"), ties("rb"), counted.groupBy(*pair).agg(score.alias("score"))):
        out = out.join(part, pair, "left")
    return ranks.named(out, group, F.col("n"), _tau_b().alias("r"))
