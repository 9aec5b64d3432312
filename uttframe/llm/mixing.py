"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold their text. In a table where each row has one
source, equal texts in several sources make the patterns overlap; a row then carries its own source's share. A flow network
routes the words of each pattern to the quotas of its sources. The first time that a pattern's words are taken is free, and
each further time costs more (convex costs), so a text that several sources hold is taken from one of them where the
others have something else, and repeats are spread before anything is repeated again. Documents are then chosen by a seeded
hash: all of a cell (a pattern's rows in one source) get the whole number of copies, and one more goes to those below a
cut through the hash order, plus the one document that best fills what is left.

Patterns are planned by their sums alone; documents never reach the driver. The network has the largest patterns, of
``MAX_CELLS`` cells together, and the sources that they link; all other rows belong to the pattern of their own source
alone, so every row takes part and quotas stay exact with any number of patterns. A source that no pattern links takes
its target from its own rows, in Spark, for any number of sources.

A null text has size 0 and a null source is a source, last in order. Repeated rows (same id and text) are chosen alike,
so a cell may pass its share by their number times their size. Ties of the hash are ordered by id, nulls first. Very
long texts are only counted. An empty table gives an empty table. Other columns, whatever their names, are ignored by
``query`` and kept by ``mix_documents``.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, WORD, materialise, row_key, spread_join

MAX_CELLS = 2_000
TIERS = 8  # times that a pattern's words are taken at a cost of their own; more cost as much as the last
SMALL_ROWS = 100_000  # so many patterns, sources or shared texts are sent to all tasks; more are joined by a shuffle
BUCKETS = 4_096

Source = str | None


def source_targets(totals: dict[Source, int], weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3) -> dict[Source, float]:
    """Shares of the sum of all sizes by weight, cycling over the sources in code point order, null last; capped at max_repeat times a source's size, and what is above shared again."""
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(totals.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > max_repeat * totals[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = float(max_repeat * totals[s])
            left -= out[s]
            open_.remove(s)
    return out


class Network:
    """A flow network with whole capacities and costs."""

    def __init__(self) -> None:
        self.at: dict[tuple, int] = {}
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self, name: tuple) -> int:
        if name not in self.at:
            self.at[name] = len(self.out)
            self.out.append([])
        return self.at[name]

    def edge(self, a: tuple, b: tuple, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[self.node(x)].append(len(self.to))
            self.to.append(self.node(y))
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def push(self, start: int, end: int) -> None:
        """Fills the network at least cost: all paths of the least length at once, then those of the next."""
        potential = [0] * len(self.out)
        while True:
            dist, heap = [float("inf")] * len(self.out), [(0, start)]
            dist[start] = 0
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e] and (n := d + self.cost[e] + potential[u] - potential[self.to[e]]) < dist[self.to[e]]:
                        dist[self.to[e]] = n
                        heapq.heappush(heap, (n, self.to[e]))
            if dist[end] == float("inf"):
                return
            potential = [p + min(d, dist[end]) for p, d in zip(potential, dist, strict=True)]
            while self._block(start, end, potential):
                pass

    def _block(self, start: int, end: int, potential: list[float]) -> bool:
        """A blocking flow over edges without reduced cost, level by level; False if none is left."""
        free = lambda u, e: self.room[e] and self.cost[e] + potential[u] == potential[self.to[e]]
        level, queue = {start: 0}, deque([start])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if free(u, e) and self.to[e] not in level:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        if end not in level:
            return False
        turn, path, u = [0] * len(self.out), [], start
        while True:
            if u == end:
                room = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= room
                    self.room[e ^ 1] += room
                path, u = [], start
            while turn[u] < len(self.out[u]):
                e = self.out[u][turn[u]]
                if free(u, e) and level.get(self.to[e]) == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if not path:
                    return True
                u = self.to[path.pop() ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = self.to[e]


Pattern = tuple[Source, ...]


def min_cost_flow(patterns: dict[Pattern, int], quotas: dict[Source, int], max_repeat: int = 3, cells: dict[tuple[Pattern, Source], int] | None = None) -> dict[tuple[Pattern, Source], int]:
    """Words that each pattern gives to each of its sources. The r-th time that a pattern's words are taken costs r * r a word, from 0.

    patterns has the words of each pattern once. cells has the words of its rows in each source, which give max_repeat times
    as many at most; without cells, a pattern's rows are shared by its sources, and all of these get max_repeat times as many.
    """
    net, given = Network(), {}
    for p, size in patterns.items():
        own = {s: cells[p, s] if cells else size for s in p if not cells or (p, s) in cells}
        left = max_repeat * (sum(own.values()) if cells else size)
        for r in range(TIERS):
            room = left if r == TIERS - 1 else min(size, left)
            if room > 0:
                net.edge(("in",), ("p", p), room, r * r)
                left -= room
        for s, n in own.items():
            given[p, s] = net.edge(("p", p), ("s", s), max_repeat * n, 0)
    for s, q in quotas.items():
        net.edge(("s", s), ("out",), q, 0)
    net.push(net.node(("in",)), net.node(("out",)))
    return {cell: net.room[e ^ 1] for cell, e in given.items() if net.room[e ^ 1]}


def memberships(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_t1, _t2 (hashes of a text) and _pattern, for texts that two to MAX_CELLS / 2 sources hold, and m, their rows."""
    a, b = row_key(F.col(text_col))
    pairs = docs.filter(F.length(text_col) > 0).select(a.alias("_t1"), b.alias("_t2"), F.col(source_col).alias("source")).groupBy("_t1", "_t2", "source").agg(F.count("*").alias("m"))
    pairs = materialise(pairs, "mix-pairs")
    several = pairs.groupBy("_t1", "_t2").agg(F.count("*").alias("k")).filter(F.col("k").between(2, MAX_CELLS // 2)).drop("k")
    each = pairs.join(several, ["_t1", "_t2"], "left_semi").groupBy("_t1", "_t2").agg(F.array_sort(F.collect_list(F.struct("source"))).alias("p"), F.sum("m").alias("m"))
    return materialise(each.select("_t1", "_t2", F.transform("p", lambda x: x["source"]).alias("_pattern"), "m"), "mix-texts")


def with_patterns(docs: DataFrame, shared: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with _own, its source, and _pattern, the sources that hold its text: shared has the texts of several."""
    a, b = row_key(F.col(text_col))
    rows = docs.withColumns({"_t1": a, "_t2": b, "_own": F.array(source_col)})
    n, most = shared.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    texts = shared.drop("m")
    if n <= SMALL_ROWS:
        rows = rows.join(F.broadcast(texts), ["_t1", "_t2"], "left")
    else:
        rows = spread_join(rows, texts, ["_t1", "_t2"], shared.filter(F.col("m") > max(1_000, most // HOT_KEYS)), F.col("_own"), "left")
    return rows.withColumn("_pattern", F.coalesce("_pattern", "_own")).drop("_t1", "_t2")


def light(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", pattern: Column | None = None, count: bool = True) -> DataFrame:
    """docs with _pattern, _own (the source whose share a row carries; empty if its pattern's sources share it), _size, _u (the seeded hash) and _b (its bucket).

    Without count, _size is 1 for all texts that have a word.
    """
    if pattern is not None:
        docs = docs.withColumns({"_pattern": pattern, "_own": F.array().cast("array<string>")})
    size = F.regexp_count(F.col(text_col), F.lit(WORD)) if count else F.col(text_col).rlike(WORD).cast("int")
    return docs.withColumns({"_size": F.coalesce(size, F.lit(0)).cast("long"), "_u": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))}).withColumn("_b", F.pmod("_u", F.lit(BUCKETS)).cast("int"))


def _small(rows: DataFrame) -> DataFrame:
    """A materialised table with a row a cell or source: sent to all tasks if it is small, else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def targets_of(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """source_targets() of a table of source and source_size, in Spark: source, source_size, target.

    A source is capped if its share at the present level (what is left by weight) is above its cap. Levels only rise, so a
    round needs the sums over capped and open sources alone; sources are numbered by range partitions.
    """
    spread = materialise(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # a row a partition
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(spread.join(F.broadcast(before), "_p").select("source", "source_size", weight.alias("_w")), "mix-weights")
    cap = (max_repeat * F.col("source_size")).cast("double")

    def capped(left: float, total: float) -> Column:
        return F.lit(left) * F.col("_w") / F.lit(total) > cap if total else F.lit(True)

    all_, total = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    left, closed = float(all_ or 0), 0
    total = total or 0.0
    while True:
        above = capped(left, total)
        n, given, open_ = rows.agg(F.count_if(above), F.sum(F.when(above, max_repeat * F.col("source_size"))), F.sum(F.when(~above, F.col("_w")))).first()
        if n <= closed:
            return rows.select("source", "source_size", F.when(above, cap).otherwise(F.lit(left) * F.col("_w") / F.lit(total or 1.0)).alias("target"))
        left, total, closed = float(all_ - (given or 0)), open_ or 0.0, n


CELL = ["_pattern", "_own"]


def in_network(summed: DataFrame) -> DataFrame:
    """The overlapping patterns that the network has: the largest, as many as have MAX_CELLS cells together."""
    several = summed.filter(F.size("_pattern").between(2, MAX_CELLS // 2)).groupBy("_pattern").agg(F.sum("n").alias("n"))
    several = materialise(several.withColumn("_id", F.xxhash64("_pattern")), "mix-several")
    left, kept = MAX_CELLS, []
    for r in several.orderBy(F.desc("n"), "_id").select("_id", F.size("_pattern").alias("k")).limit(MAX_CELLS // 2).collect():
        left -= r["k"]
        if left >= 0:
            kept.append((r["_id"],))
    return several.join(F.broadcast(summed.sparkSession.createDataFrame(kept, "_id long")), "_id", "left_semi").select("_pattern")


def settle(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows with the pattern of their own source alone (or of the first of their sources) where theirs is not in the network."""
    alone = F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.slice("_pattern", 1, 1))
    found = rows.join(F.broadcast(kept.withColumn("_kept", F.lit(True))), "_pattern", "left")
    return found.withColumn("_pattern", F.when(F.col("_kept"), F.col("_pattern")).otherwise(alone)).drop("_kept")


def _routed(flow: list[tuple[Pattern, Pattern, int]], quotas: dict[Source, int], max_repeat: int) -> dict[tuple[Pattern, Pattern], int]:
    """Words that each cell (pattern, own source or none) gives."""
    words, own_words = {}, {}
    for p, own, n in flow:
        for s in own:
            own_words[p, s] = n
        words[p] = min(n, words.get(p, n)) if own else n  # each of a pattern's sources holds its texts once at least
    shared = {p for p, own, _ in flow if not own}
    if shared and own_words:
        raise ValueError("rows with and without a source of their own in one mix")
    out: dict[tuple[Pattern, Pattern], int] = {}
    for (p, s), n in min_cost_flow(dict(sorted(words.items(), key=lambda x: [(v is None, v or "") for v in x[0]])), quotas, max_repeat, own_words or None).items():
        cell = p, () if p in shared else (s,)
        out[cell] = out.get(cell, 0) + n
    return out


def plan(rows: DataFrame, id_col: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From materialised rows of light(): (a row for each cell: copies for all, and the cut up to which one more is taken; source, source_size and target; the patterns in the network)."""
    spark = rows.sparkSession
    summed = materialise(rows.groupBy(*CELL).agg(F.sum("_size").alias("n")), "mix-patterns")
    holders = F.explode(F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_pattern")))
    totals = summed.select(holders.alias("source"), "n").groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = materialise(targets_of(totals, weights, max_repeat), "mix-targets")

    kept = materialise(in_network(summed), "mix-kept")
    cells = materialise(settle(summed, kept).groupBy(*CELL).agg(F.sum("n").alias("n")), "mix-cells")
    # A source that no pattern of the network links takes what it needs from its own rows; the flow is for the others.
    linked = materialise(kept.select(F.explode("_pattern").alias("_s")).distinct().withColumn("_linked", F.lit(True)), "mix-linked")
    marked = cells.withColumn("_first", F.get("_pattern", F.lit(0))).join(F.broadcast(linked), F.col("_first").eqNullSafe(F.col("_s")), "left")
    marked = materialise(marked.select(*CELL, "n", F.coalesce("_linked", F.lit(False)).alias("_linked")), "mix-marked")
    flow = [(tuple(r["_pattern"]), tuple(r["_own"]), r["n"]) for r in marked.filter("_linked").collect()]  # two cells a source at most, besides MAX_CELLS
    takes: dict[tuple, int] = {}
    if flow:
        quotas = {r["source"]: int(r["target"]) for r in sources.join(F.broadcast(linked), F.col("source").eqNullSafe(F.col("_s")), "left_semi").collect()}
        takes = _routed(flow, quotas, max_repeat)
    schema = rows.schema["_pattern"].dataType.simpleString()
    solved = lambda some: spark.createDataFrame([(list(p), list(own), n, takes.get((p, own), 0)) for p, own, n in some], f"_pattern {schema}, _own {schema}, n long, _takes long")
    rows = settle(rows, kept)

    # Cells that sources share come first: whole documents miss their share by a little, and a source's own rows make up for it.
    shared = [c for c in flow if len(c[0]) > 1 and c[1]]
    first = _cuts(rows, solved(shared), id_col) if shared else None
    if first is not None:
        got = {r["_own"][0]: r["n"] for r in first.groupBy("_own").agg(F.sum("_taken").alias("n")).collect()}
        for p, own, n in flow:
            if p == own:
                takes[p, own] = min(max_repeat * n, max(0, quotas[p[0]] - got.get(p[0], 0)))
    # Rows of one source that are its own, and rows of patterns reduced to it, share its need by their words.
    needs = _small(sources).select(F.array("source").alias("_pattern"), F.floor("target").alias("_need"))
    alone = marked.filter("NOT _linked").select(*CELL, "n").join(needs, "_pattern").withColumn("_all", F.sum("n").over(Window.partitionBy("_pattern")))
    alone = alone.select(*CELL, "n", F.least(max_repeat * F.col("n"), F.when(F.col("_all") > 0, F.floor(F.col("_need") * (F.col("n") / F.col("_all")))).otherwise(0)).alias("_takes"))
    rest = _cuts(rows, alone.unionByName(solved([c for c in flow if c not in set(shared)])), id_col)
    return rest if first is None else first.unionByName(rest), sources, kept


def _cuts(rows: DataFrame, takes: DataFrame, id_col: str) -> DataFrame:
    """For each cell of takes (n words, of which _takes are taken, repeats counted): copies for all of its rows, the cut up to which one more is taken, and _taken, what this comes to."""
    whole = F.col("n") > 0
    shares = takes.select(*CELL, "n", F.when(whole, F.floor(F.col("_takes") / F.col("n"))).otherwise(0).alias("_base"), F.when(whole, F.col("_takes") % F.col("n")).otherwise(0).alias("_rest"))
    wanted = _small(materialise(shares, "mix-shares"))
    own = rows.join(wanted.select(*CELL), CELL, "left_semi")
    order = Window.partitionBy(*CELL).orderBy("_b")
    sums = own.groupBy(*CELL, "_b").agg(F.sum("_size").alias("_n")).withColumn("upto", F.sum("_n").over(order))
    cut = sums.join(wanted, CELL).filter(F.col("upto") > F.col("_rest")).groupBy(*CELL).agg(F.min("_b").alias("_cut"), F.min_by(F.col("upto") - F.col("_n"), "_b").alias("_before"))
    wanted = _small(materialise(wanted.join(cut, CELL, "left"), "mix-cut"))  # again a row a cell

    # Only the bucket of the cut is put in order, row by row; what the bucket adds ends at its last row that fits.
    edge = own.join(wanted, CELL).filter(F.col("_b") == F.col("_cut"))
    running = F.sum("_size").over(Window.partitionBy(*CELL).orderBy("_u", id_col).rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("_sum", F.col("_before") + running).filter(F.col("_sum") <= F.col("_rest"))
    last = last.groupBy(*CELL).agg(F.max(F.struct("_u", id_col)).alias("_last"), F.max("_sum").alias("_got"))
    full = F.coalesce("_got", "_before", F.lit(0))
    wanted = _small(materialise(wanted.join(last, CELL, "left").withColumn("_gap", F.col("_rest") - full), "mix-last"))

    other = own.join(wanted, CELL).filter(~_below(id_col) & (F.abs(F.col("_size") - F.col("_gap")) < F.col("_gap")))
    fill = other.groupBy(*CELL).agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("d"), F.col("_u"), F.col(id_col), F.col("_size"))).alias("_fill"))
    done = wanted.join(fill, CELL, "left")
    return materialise(done.select(
        *CELL, "_base", "_cut", "_last", F.col("_fill").isNotNull().alias("_has_fill"), F.struct(F.col("_fill._u"), F.col(f"_fill.{id_col}")).alias("_fill"),
        (F.col("_base") * F.col("n") + full + F.coalesce("_fill._size", F.lit(0))).alias("_taken")), "mix-plan")


def _below(id_col: str) -> Column:
    """Below the cut through the hash order."""
    in_edge = (F.col("_b") == F.col("_cut")) & F.coalesce(F.struct("_u", id_col) <= F.col("_last"), F.lit(False))
    return F.coalesce((F.col("_b") < F.col("_cut")) | in_edge, F.lit(False))


def copies(rows: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows of light() with _copies: how often the mix takes the row."""
    filled = F.col("_has_fill") & (F.struct("_u", id_col) == F.col("_fill"))
    extra = F.when(_below(id_col) | filled, 1).otherwise(0)
    joined = rows.join(_small(chosen), CELL)
    return joined.withColumn("_copies", F.when(F.col("_size") > 0, F.col("_base") + extra).otherwise(0).cast("long"))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs as the mix takes them: rows left out, or repeated."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    row = with_patterns(row, memberships(docs))
    chosen, _, kept = plan(materialise(light(row, seed).select("doc_id", *CELL, "_size", "_u", "_b"), "mix-rows"))
    taken = copies(settle(light(row, seed, count=False), kept), chosen)
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def query(docs: DataFrame, seed: int = 17) -> DataFrame:
    docs = docs.select("doc_id", "text", "source")
    rows = materialise(light(with_patterns(docs, memberships(docs)), seed).drop("text", "source"), "mix-rows")
    chosen, sources, kept = plan(rows)
    table = _small(sources).select(F.array("source").alias("_own"), "source_size", "target")
    out = copies(settle(rows, kept), chosen).join(table, "_own")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))
