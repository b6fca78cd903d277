"""Sharding by balanced label propagation.

Documents that are linked (here: share a link key, such as the hash of their text) should lie in
one shard, while shards keep their quotas. Linked documents start evenly dealt out; in every round
a join tells each where most of its neighbours are, and it proposes to go there. Of the proposals
from shard s to shard t as many are granted as t proposes to s, and as t has free room, those of
the largest groups first, so quotas always hold. Documents without links fill what is left.

Documents of one group in one shard are alike, so a round's tables hold a row for each group and
shard, not for each document: a group of any size costs a few rows. Documents meet their group
again at the end, ranked within ranges of a hash, so no group or shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.frames import running_total, saved

ROUNDS, RANGES = 8, 4096


def _ranked(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: each row's place within its keys, from 0 without gaps, in the order of a hash of the id."""
    rows = df.withColumn("_range", F.pmod(F.xxhash64("id"), F.lit(RANGES)).cast("int"))
    rows = running_total(rows, keys, "_range", [F.col("id"), F.col("crc")], F.lit(1), "_place")
    return rows.withColumn(out, (F.col("_place") - 1).cast("long")).drop("_range", "_place")


def _by_ranges(place: Column, ends: list[int]) -> Column:
    """The first shard whose end lies beyond the place."""
    out = F.lit(len(ends) - 1)
    for j in reversed(range(len(ends) - 1)):
        out = F.when(place < ends[j], j).otherwise(out)
    return out


def grants(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from s to t: as many as come back, and the rest while t has room."""
    out = {(s, t): min(n, wanted.get((t, s), 0)) for (s, t), n in wanted.items()}
    for (s, t), n in sorted(wanted.items()):
        more = min(n - out[s, t], max(room[t], 0))
        out[s, t] += more
        room[t] -= more
    return out


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rounds over ``state``: (link, shard, n), the number of a link's documents in each shard. Only sums over shards reach the driver."""
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - loads.get(j, 0) for j, q in enumerate(quotas)]
        open_to = [j for j, r in enumerate(room) if r > 0] or list(range(len(quotas)))
        rank = F.struct(F.col("n"), F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 30)), F.col("shard"))
        goal = state.filter(F.col("shard").isin(open_to)).groupBy("link").agg(F.max(rank).alias("to"))
        moves = state.withColumn("at", rank).join(goal, "link").filter("to > at").select("link", "shard", F.col("to.shard").alias("to"), F.col("to.n").alias("gain"), "n")
        moves = saved(moves)
        wanted = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        allowed = {k: n for k, n in grants(wanted, room).items() if n}
        if not allowed:
            break
        limit = F.lit(0)
        for (s, t), n in allowed.items():
            limit = F.when((F.col("shard") == s) & (F.col("to") == t), n).otherwise(limit)
        # groups with more neighbours at the goal come first
        order = ((63 - F.least(F.lit(63), F.floor(F.log2("gain")).cast("int"))) * 64 + F.pmod(F.xxhash64("link"), F.lit(64))).cast("int")
        moves = running_total(moves.withColumn("_range", order), ["shard", "to"], "_range", [F.xxhash64("link"), F.col("link")], F.col("n"), "_until")
        moves = moves.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), limit - (F.col("_until") - F.col("n"))))).filter("go > 0")
        change = moves.select("link", "shard", (-F.col("go")).alias("n")).unionByName(moves.select("link", F.col("to").alias("shard"), F.col("go").alias("n")))
        state = saved(state.unionByName(change).groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    return state


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Shards have equally many rows, at most one apart (law ``rows``); slots number a shard's rows
    from 0. Rows with equal ``link`` (default: equal texts) are neighbours; a null link has none. A
    null text has size 1 and the checksum of no bytes. Rows that repeat an id count one by one.
    """
    text = F.col(text_col).cast("string")
    link = F.sha2(text, 256) if link is None else link
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), link.alias("link"),
    )
    rows = saved(rows)
    total = rows.count()
    quotas = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    groups = rows.filter("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("_n")).filter("_n > 1").select("link")
    groups = saved(groups)  # so that the join can split the rows of a large group
    tied = rows.join(groups.withColumn("tied", F.lit(True)), "link", "left")
    tied = saved(tied.withColumn("tied", F.coalesce("tied", F.lit(False))))
    linked = tied.filter("tied").drop("tied")
    dealt = _ranked(linked, [], "place").withColumn("shard", (F.col("place") % n_shards).cast("int"))
    state = propagate(saved(dealt.groupBy("link", "shard").agg(F.count("*").alias("n"))), quotas, rounds)
    loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # linked rows by their place in the group, the others by their place among all of them
    parts = state.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"))  # at most n_shards entries
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(
        F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("end"), F.element_at("parts", i)["shard"].alias("shard")))
    placed = _ranked(linked, ["link"], "place").join(saved(parts.select("link", ends.alias("ends"))), "link")
    placed = placed.withColumn("shard", F.element_at(F.filter("ends", lambda e: F.col("place") < e["end"]), 1)["shard"]).select("id", "size", "crc", "shard")
    free, end = [], 0
    for j, q in enumerate(quotas):
        end += q - loads.get(j, 0)
        free.append(end)
    lone = _ranked(tied.filter("NOT tied").select("id", "size", "crc"), [], "place")
    lone = lone.withColumn("shard", _by_ranges(F.col("place"), free).cast("int")).select("id", "size", "crc", "shard")
    out = _ranked(saved(placed.unionByName(lone)), ["shard"], "slot")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
