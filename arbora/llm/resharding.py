"""Resharding with the fewest bytes moved, by a minimum-cost flow.

Documents lie in old shards; new shards have capacities. Equal texts are a group and move
together; only a group that no shard has room for is split. Groups of more than 1/256
of a shard (at most 256 a shard, so they fit on the driver) are blocks placed one by one,
longest first, at home while it has room. What is left of each old shard is a line of
small groups; a minimum-cost flow from old to new shards (a moved byte costs one, a kept
byte nothing) says how many bytes of each line go where, and the line is cut there, at
group borders. Positions on a line and slots in a shard are prefix sums over blocks of
rows, so that no task sees a whole shard.

Defined results: the size of a null text is 1; equal rows are told apart by nothing and
take neighbouring slots; a null doc_id sorts first; very long texts count whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

OLD, NEW = 6, 8
#: A block is heavy from this share of a shard.
HEAVY = 1 / 256
_ROWS = 100_000  # rows of a block of a line


def min_cost_flow(supply: list[int], room: list[int], cost) -> list[list[int]]:
    """Transport all supply into room (their sums agree) at least cost, by successive
    shortest paths with potentials on the bipartite network."""
    n, m = len(supply), len(room)
    s, t = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, cap: int, c: int) -> None:
        graph[u].append([v, cap, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, x in enumerate(supply):
        arc(s, i, x, 0)
        for j in range(m):
            arc(i, n + j, x, cost(i, j))
    for j, x in enumerate(room):
        arc(n + j, t, x, 0)
    height = [0] * len(graph)
    while True:
        dist: list[float] = [float("inf")] * len(graph)
        dist[s], back, heap = 0, {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, c, _) in enumerate(graph[u]):
                if cap > 0 and d + c + height[u] - height[v] < dist[v]:
                    dist[v] = d + c + height[u] - height[v]
                    back[v] = (u, k)
                    heapq.heappush(heap, (dist[v], v))
        if t not in back:
            break
        height = [h + int(d) if d < float("inf") else h for h, d in zip(height, dist)]
        path, v = [], t
        while v != s:
            u, k = back[v]
            path.append((u, k))
            v = u
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, cap, _, rev in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][rev][1]
    return flow


def _cuts(line: int, parts: list[tuple[int, int]]) -> list[tuple[int, float, float, int]]:
    """Intervals of a line for (shard, bytes) parts in order; open at both ends."""
    out, at, parts = [], 0, [p for p in parts if p[1] > 0] or parts[:1]
    for k, (shard, size) in enumerate(parts):
        out.append((line, float("-inf") if k == 0 else float(at), float("inf") if k == len(parts) - 1 else float(at + size), shard))
        at += size
    return out


def plan_moves(heavy: list[tuple[int, int, int, int]], light: list[int], new: int) -> tuple[list[tuple[int, float, float, int]], int]:
    """Intervals (line, from, to, shard) and bytes moved. heavy: (line, old shard, bytes,
    bytes of one document); light: bytes of the small groups of each old shard."""
    total = sum(light) + sum(h[2] for h in heavy)
    room = [total // new + (j < total % new) for j in range(new)]
    out, moved = [], 0
    for line, old, size, one in sorted(heavy, key=lambda h: (-h[2], h[0])):
        if size > max(room) and size > one:  # fits nowhere whole: fills shards
            left, parts = size // one, []
            for j in sorted(range(new), key=lambda j: (j != old, -room[j], j)):
                k = min(left, max(0, room[j]) // one)
                if k:
                    parts.append((j, k * one))
                    left -= k
                    room[j] -= k * one
                    moved += (j != old) * k * one
            while left:
                j = max(range(new), key=lambda j: room[j])
                parts.append((j, one))
                room[j] -= one
                moved += (j != old) * one
                left -= 1
            out += _cuts(line, parts)
        else:
            j = old if old < new and room[old] >= size else max(range(new), key=lambda j: (room[j], -j))
            room[j] -= size
            moved += (j != old) * size
            out += _cuts(line, [(j, size)])
    room = [max(0, r) for r in room]
    over = sum(room) - sum(light)  # blocks that overfill a shard leave too little room
    while over > 0:
        j = max(range(new), key=lambda j: room[j])
        step = min(over, max(1, over // new), room[j])
        room[j] -= step
        over -= step
    flow = min_cost_flow(light, room, lambda i, j: int(i != j))
    for i, row in enumerate(flow):
        moved += sum(x for j, x in enumerate(row) if j != i)
        out += _cuts(i, sorted(((j, x) for j, x in enumerate(row) if x), key=lambda p: (p[0] != i, p[0])) or [(i % new, 1)])
    return out, moved


def reshard(docs: DataFrame, new: int = NEW, old: int = OLD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard for every row.

    The old layout is by the texts' crc32. law is `bytes`; grown_shard is null."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    narrow = settle(narrow.withColumn("old_shard", F.pmod("text_crc32", F.lit(old)).cast("int")).withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")))
    groups = settle(narrow.groupBy("text_crc32", "size", "old_shard").agg(F.count("*").alias("n")))
    total, rows = groups.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    heavy_at = max(1.0, (total or 0) / new * HEAVY)
    is_heavy = F.col("size") * F.col("n") > heavy_at
    heavy = [(1000 + i, r["old_shard"], r["size"] * r["n"], r["size"], r["text_crc32"]) for i, r in enumerate(groups.where(is_heavy).orderBy("text_crc32", "size").collect())]
    light = {r["old_shard"]: r["b"] for r in groups.where(~is_heavy).groupBy("old_shard").agg(F.sum(F.col("size") * F.col("n")).alias("b")).collect()}
    cuts, _ = plan_moves([h[:4] for h in heavy], [light.get(i, 0) for i in range(old)], new)
    n_cuts: dict[int, int] = {}
    for c in cuts:
        n_cuts[c[0]] = n_cuts.get(c[0], 0) + 1
    # at most 256 heavy groups a new shard, so both tables below are bounded by the shard counts
    named = F.broadcast(spark.createDataFrame([(h[4], h[3], h[0], n_cuts[h[0]] > 1) for h in heavy], "text_crc32 long, size long, line int, split boolean"))
    where = F.broadcast(spark.createDataFrame(cuts, "line int, lo double, hi double, shard int"))
    blocks = max(16, -(-(rows or 0) // (_ROWS * old)))
    lined = narrow.join(named, ["text_crc32", "size"], "left")
    lined = lined.withColumn("apart", F.col("split").isNotNull()).withColumn("line", F.coalesce("line", "old_shard")).withColumn("block", F.when(F.col("apart"), F.pmod("h", F.lit(blocks))).otherwise(F.pmod(F.xxhash64("text_crc32", "size"), F.lit(blocks)))).drop("split")
    lined = settle(lined)
    starts = lined.groupBy("line", "block").agg(F.sum("size").alias("b")).selectExpr("line", "block", "sum(b) over (partition by line order by block) - b as off")
    placed = lined.selectExpr("*", "sum(size) over (partition by line, block order by text_crc32, size, doc_id, h rows unbounded preceding) - size as cum")
    placed = placed.selectExpr("*", "min(cum) over (partition by line, block, text_crc32, size) as g0", "sum(size) over (partition by line, block, text_crc32, size) as gb")
    placed = placed.join(starts, ["line", "block"]).withColumn("mid", F.col("off") + F.when(F.col("apart"), F.col("cum") + F.col("size") / 2).otherwise(F.col("g0") + F.col("gb") / 2))
    placed = placed.join(where, "line").where("mid >= lo and mid < hi")
    placed = settle(placed.select("doc_id", "size", "text_crc32", "old_shard", "h", "line", "block", "shard"))
    counts = placed.groupBy("shard", "line", "block").agg(F.count("*").alias("m")).selectExpr("shard", "line", "block", "sum(m) over (partition by shard order by line, block) - m as first")
    out = placed.selectExpr("*", "row_number() over (partition by shard, line, block order by doc_id, text_crc32, size, h) as rn").join(counts, ["shard", "line", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str) -> list[int]:
    """Write the files (path/shard=k) of every new shard that gives or takes documents, and
    delete those of shards left without any; the files of other shards stay as they are. Every
    row of docs goes to one row of the plan. Returns the shards written."""
    spark = docs.sparkSession
    shards = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    hit = sorted(r[0] for r in shards.collect())  # no more than there are shards
    key = ["__id", "__crc"]
    to = plan.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard")
    per = settle(to.groupBy(*key).agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")))
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__crc"))

    def same(a: str, b: str):
        return F.col(f"{a}.__id").eqNullSafe(F.col(f"{b}.__id")) & (F.col(f"{a}.__crc") == F.col(f"{b}.__crc"))

    joined = keyed.alias("d").join(per.alias("p"), same("d", "p"))
    rows = joined.where("lo = hi").select("d.__row", F.col("lo").alias("shard"))
    if not per.where("lo < hi").isEmpty():  # equal rows in several shards: one to one
        d = numbered(joined.where("lo < hi").select("d.*"), key).alias("d")
        t = numbered(to.alias("d").join(per.where("lo < hi").alias("p"), same("d", "p")).select("d.*"), key).alias("t")
        rows = rows.unionByName(d.join(t, same("d", "t") & (F.col("d.rn") == F.col("t.rn"))).select("d.__row", "t.shard"))
    rows = rows.where(F.col("shard").isin(hit)).select("__row.*", "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r[0] for r in plan.select("shard").distinct().collect()}
    for k in set(hit) - left:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return hit
