"""Chat formatting: who speaks in a transcript, by a hidden Markov model.

Hidden states are the roles. A row (a turn, or a line of a transcript) shows a speaker marker, if
any, its length, its number of lines, and whether it asks; the model has the probability of each
given the role, of the first role, and of a role after a role. Viterbi recovers the likeliest
roles of a conversation, then every row is rendered in canonical form.

All model counts are Spark aggregates over all labelled rows; what reaches the driver is counts by
role and feature value and by pairs of roles, of ``MOST_ROLES`` roles at most (more are an error). A conversation is cut into blocks of ``BLOCK`` positions, and blocks are dealt out by
conversation and number, so a conversation of any length is spread. For conversations of several
blocks a first pass gives for each block the best score from every role before it to every role at
its end (a max-plus product), and a scan over these small tables fixes the roles at the blocks'
ends; then all blocks are decoded side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.frames import importable, saved

BLOCK = 1024
#: More roles than this are refused (a table of all their pairs has 128 MB); cells of tables of pairs of roles that are worked on at once.
MOST_ROLES, CELLS = 4096, 1 << 22
#: Words that mark a speaker at the start of a line (fixed values of common transcripts).
MARKERS = {
    1: "user|human|customer|question|q|me|client|prompt|instruction",
    2: "assistant|ai|bot|agent|answer|a|response|gpt|model",
    3: "system|context|setup",
}
_MARK = r"(?is)^\s*(?:[#>*\[(<|_-]+\s*)?(?:{0})\s*(?:[*\])>|_]+\s*:?|:)\s*"
#: Features and how many values each has.
SIZES = (len(MARKERS) + 1, 18, 6, 2)


def marker(text: Column) -> Column:
    """0 without a speaker marker, else its kind."""
    out = F.lit(0)
    for k, words in MARKERS.items():
        out = F.when(text.rlike(_MARK.format(words)), k).otherwise(out)
    return out


def observed(text: Column) -> Column:
    """What a row shows: marker, size (powers of two of its characters), lines, question."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.least(F.lit(SIZES[1] - 1), F.floor(F.log2(F.length(text) + 1.0))).cast("int")
    lines = F.least(F.lit(SIZES[2] - 1), F.regexp_count(text, F.lit("\n"))).cast("int")
    asks = text.rlike(r"\?\s*$").cast("int")
    return F.array(marker(text).cast("int"), size, lines, asks)


def unmarked(text: Column) -> Column:
    """The text without its speaker marker."""
    words = "|".join(MARKERS.values())
    return F.trim(F.regexp_replace(text, _MARK.format(words), ""))


class Model:
    """Log probabilities: first role, next role, and each feature's value given the role."""

    def __init__(self, roles: list[str], first: np.ndarray, after: np.ndarray, shown: list[np.ndarray]):
        self.roles, self.first, self.after, self.shown = roles, first, after, shown

    def of(self, seen: np.ndarray) -> np.ndarray:
        """For each row's features the log probability of them under each role."""
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.shown))


def fit(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """A model from labelled rows (those with a role). Every role that occurs can be predicted; counts start at one.

    A row's predecessor is the one before it in the order in which ``roles`` reads a conversation, whatever the gap
    between their turns. An unlabelled predecessor says nothing of what follows it, and a row with a null
    conversation is one of its own.
    """
    text = F.col(text_col).cast("string")
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    labelled = rows.filter("role IS NOT NULL")
    per = labelled.select("role", F.posexplode(observed(F.col("text"))).alias("feature", "value")).groupBy("role", "feature", "value").agg(F.count("*").alias("n"))
    roles = sorted(r["role"] for r in per.select("role").distinct().limit(MOST_ROLES + 1).collect())
    if len(roles) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} roles: a table of all pairs of roles would be too large")
    at = {r: k for k, r in enumerate(roles)}
    k = max(len(roles), 1)
    shown = [np.ones((k, n)) for n in SIZES]
    for r in per.collect():  # at most roles x the features' values
        shown[r.feature][at[r["role"]], r.value] += r.n
    # neighbours within a block of turns, and the last row of a block before the first one of the next block that has rows
    order = [F.col("turn").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("role").asc_nulls_first()]
    rows = rows.filter("conv IS NOT NULL").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    rows = rows.withColumn("last", F.lag("role").over(inside)).withColumn("n", F.row_number().over(inside)).withColumn("next", F.lead(F.lit(1)).over(inside))
    rows = saved(rows.select("conv", "block", "role", "last", "n", F.col("next").isNull().alias("ends")))
    edges = rows.filter("n = 1 OR ends").groupBy("conv", "block").agg(F.max(F.when(F.col("n") == 1, F.col("role"))).alias("role"), F.max(F.when(F.col("ends"), F.col("role"))).alias("end"))
    by_block = Window.partitionBy("conv").orderBy("block")  # one row for each block
    edges = edges.withColumn("last", F.lag("end").over(by_block)).withColumn("first", F.row_number().over(by_block) == 1)
    pairs = rows.filter("n > 1").select("last", "role", F.lit(False).alias("first")).union(edges.select("last", "role", "first"))
    pairs = pairs.union(labelled.filter("conv IS NULL").select(F.lit(None).cast("string"), "role", F.lit(True)))
    first, after = np.ones(k), np.ones((k, k))
    for r in pairs.filter("role IS NOT NULL").groupBy("last", "role", "first").count().collect():
        if r["first"]:
            first[at[r["role"]]] += r["count"]
        elif r["last"] is not None:
            after[at[r["last"]], at[r["role"]]] += r["count"]
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(roles, log(first), log(after), [log(t) for t in shown])


# -- decoding ------------------------------------------------------------------------------
def _spans(conv: list, block: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of one conversation and block."""
    cuts = [0] + [i for i in range(1, len(conv)) if conv[i] != conv[i - 1] or block[i] != block[i - 1]] + [len(conv)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if conv else []


def _grid(seen: np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Spans by falling length, and how many are longer than j for each j."""
    sizes = np.array([b - a for a, b in spans])
    order = np.argsort(-sizes, kind="stable").tolist()
    active = [int((sizes > j).sum()) for j in range(int(sizes.max(initial=0)))]
    return order, active


def _groups(model: Model, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of (consecutive) spans, by number, that hold a table of all pairs of roles each within ``CELLS``."""
    most = max(1, CELLS // len(model.roles) ** 2)
    for i in range(0, len(spans), most):
        yield i, min(i + most, len(spans))


def products(model: Model, seen: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each span the best log probability from each role before it to each role at its end; works through slices of roles."""
    emit, k = model.of(seen), len(model.roles)
    order, active = _grid(seen, spans)
    starts = np.array([spans[o][0] for o in order])
    out = np.full((len(spans), k, k), -np.inf)
    out[:, np.arange(k), np.arange(k)] = 0
    for j, n in enumerate(active):
        step = model.after[None, :, :] + emit[starts[:n] + j][:, None, :]
        wide = max(1, CELLS // (n * k * k))
        for i in range(0, k, wide):
            out[:n, i : i + wide] = (out[:n, i : i + wide, :, None] + step[:, None, :, :]).max(2)
    back = np.empty_like(out)
    back[order] = out
    return back


def viterbi(model: Model, seen: np.ndarray, spans: list[tuple[int, int]], before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The likeliest role of each row; ``before`` and ``last`` fix the role before a span and at its end (-1: not fixed, the conversation's start or end)."""
    groups = list(_groups(model, spans))
    if len(groups) > 1:
        parts = [np.zeros(spans[0][0], np.int64)]
        for i, j in groups:
            a, b = spans[i][0], spans[j - 1][1]
            parts.append(viterbi(model, seen[a:b], [(x - a, y - a) for x, y in spans[i:j]], before[i:j], last[i:j]))
        return np.concatenate(parts)
    emit, k = model.of(seen), len(model.roles)
    order, active = _grid(seen, spans)
    starts = np.array([spans[o][0] for o in order], np.int64)
    before, last = before[order], last[order]
    score = np.zeros((len(spans), k))
    came: list[np.ndarray] = []
    for j, n in enumerate(active):
        if j == 0:
            score[:n] = np.where(before[:n, None] >= 0, model.after[before[:n]], model.first[None, :])
            came.append(np.zeros((n, k), np.int32))
        else:
            ways = score[:n, :, None] + model.after[None, :, :]
            came.append(ways.argmax(1).astype(np.int32))
            score[:n] = ways.max(1)
        score[:n] += emit[starts[:n] + j]
    at = np.where(last >= 0, last, score.argmax(1))
    out = np.zeros(len(seen), np.int64)
    for j in range(len(active) - 1, -1, -1):
        n = active[j]
        out[starts[:n] + j] = at[:n]
        at[:n] = came[j][np.arange(n), at[:n]]
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from batches in the order of conversation and block."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, block = batch.column("conv").to_pylist(), batch.column("block").to_pylist()
        i = n - 1
        while i > 0 and conv[i - 1] == conv[n - 1] and block[i - 1] == block[n - 1]:
            i -= 1
        if i == 0 and kept and kept[-1].column("conv")[-1].as_py() == conv[0] and kept[-1].column("block")[-1].as_py() == block[0]:
            kept.append(batch)
            continue
        if i:
            yield pa.Table.from_batches([*kept, batch.slice(0, i)])
        elif kept:
            yield pa.Table.from_batches(kept)
        kept = [batch.slice(i)]
    if kept:
        yield pa.Table.from_batches(kept)


def _seen(table: pa.Table) -> np.ndarray:
    return np.array(table.column("seen").to_pylist(), np.int64).reshape(-1, len(SIZES))


def roles(rows: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``rows``: conv, turn, text and ``role``, recovered without looking at any role.

    Rows of a conversation follow in the order of turn (null first), then text. A null or empty text
    is a row with no letters. Rows with a null conversation are each a conversation of their own.
    Without labelled rows the role is null. An empty table gives none.
    """
    spark = rows.sparkSession
    importable(spark)
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    if not model.roles:
        return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("text").alias(text_col), F.lit(None).cast("string").alias("role"))
    rows = rows.withColumn("seen", observed(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    own = F.when(F.col("conv").isNull(), F.xxhash64("turn", "text"))  # rows without a conversation lie apart
    rows = rows.withColumn("block", F.coalesce(own, F.col("block"))).withColumn("alone", F.col("conv").isNull())
    kind = rows.schema["conv"].dataType.simpleString()
    several = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x <> y").select("conv")
    sort = lambda df: df.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("turn").asc_nulls_first(), "text")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            conv, number = table.column("conv"), table.column("block").to_numpy()
            spans = _spans(conv.to_pylist(), number)
            seen = _seen(table)
            for i, j in _groups(model, spans):
                some = spans[i:j]
                a, b = some[0][0], some[-1][1]
                m = products(model, seen[a:b], [(x - a, y - a) for x, y in some])
                begun = [viterbi_start(model, seen[x:y], model.of(seen[x : x + 1])[0]) for x, y in some]
                yield pa.record_batch([conv.take([x for x, _ in some]).combine_chunks(), pa.array([number[x] for x, _ in some], pa.int64()),
                                       pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in begun], pa.binary())], ["conv", "block", "product", "start"])

    def scan(blocks: pd.DataFrame) -> pd.DataFrame:
        """The best roles at the ends of a conversation's blocks: a small table for every ``block`` rows."""
        blocks = blocks.sort_values("block")
        k = len(model.roles)
        scores, came = [np.frombuffer(blocks["start"].iloc[0])], []
        for p in blocks["product"].iloc[1:]:
            ways = scores[-1][:, None] + np.frombuffer(p).reshape(k, k)
            came.append(ways.argmax(0))
            scores.append(ways.max(0))
        at = [int(scores[-1].argmax())]
        for c in reversed(came):
            at.append(int(c[at[-1]]))
        at.reverse()
        return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "before": [-1, *at[:-1]], "last": at})

    long_rows = sort(rows.join(several, "conv", "left_semi").select("conv", "block", "turn", "text", "seen"))
    steps = long_rows.select("conv", "block", "seen").mapInArrow(multiply, f"conv {kind}, block long, product binary, start binary")
    ends = steps.groupBy("conv").applyInPandas(scan, f"conv {kind}, block long, before int, last int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            spans = _spans(table.column("conv").to_pylist(), table.column("block").to_numpy())
            if table.column("alone")[0].as_py() or any(table.column("alone").to_pylist()):
                spans = [s for a, b in spans for s in ([(i, i + 1) for i in range(a, b)] if table.column("alone")[a].as_py() else [(a, b)])]
            fixed = [np.array([-1 if (v := table.column(c)[a].as_py()) is None else v for a, _ in spans], np.int64) for c in ("before", "last")]
            said = viterbi(model, _seen(table), spans, *fixed)
            names = pa.array([model.roles[r] for r in said], pa.string())
            yield from table.select(["conv", "turn", "text"]).append_column("role", names).to_batches()

    with_ends = rows.join(ends, ["conv", "block"], "left")
    out = sort(with_ends).mapInArrow(decode, f"conv {kind}, turn long, text string, role string")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("text").alias(text_col), "role")


def viterbi_start(model: Model, seen: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best log probability of a conversation's first block for each role at its end."""
    score = model.first + first
    for e in model.of(seen)[1:]:
        score = (score[:, None] + model.after).max(0) + e
    return score


def rendered(role: Column, text: Column) -> Column:
    """A row in canonical form: the role's tag, the text without marker or outer spaces, an end tag. A "<|" in the text gets a space, so that no text can pass for a tag."""
    plain = F.replace(unmarked(F.coalesce(text, F.lit(""))), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), plain, F.lit("\n<|end|>\n"))


def lines(transcripts: DataFrame, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """A raw transcript as rows (conv, turn, text), one for each line that isn't blank, for ``roles``."""
    rows = transcripts.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("turn", "text"))
    return rows.filter(F.trim("text") != "").withColumn("turn", F.col("turn").cast("long"))
