"""Applying a policy to a result: mask it, tokenise it, or refuse it.

Masking is row-local and lazy.  Hashing and denying act on whole columns, so
which columns hold personal data must be known first: one profile scan of the
table, or, for a result that may not repeat (a limit), a staged copy.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.mask import apply_mask, redact
from cloakframe.functions.names import match_reason, name_sensitivity, sensitivity_rank
from cloakframe.functions.sql import any_of, array, lit, name
from cloakframe.functions.text import STRINGS, pii_text
from cloakframe.functions.tokens import resolve_salt, token
from cloakframe.operators.fields import Scope, fields, map_text, scanned
from cloakframe.operators.profile import profile_table, unfold_counts
from cloakframe.operators.protect import hash_table, redact_table, star_columns
from cloakframe.plans.request import POLICIES, PolicyDenied
from cloakframe.rules import DEFAULT_RULES, POLICY_RANK, SENSITIVITY_RANK, Mask, Rules


@dataclass
class SecureResult:
    """A protected result.  ``df`` is the data, ``summary`` one row about it.

    A staged result has files in the shared folder until ``release()``.
    """

    df: DataFrame
    summary: DataFrame
    columns: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)
    staged: DataFrame | None = None

    def release(self) -> None:
        """Delete the staged files; the result can't be read any more."""
        if self.staged is not None:
            drop_copy(self.staged)


def reliable_copy(df: DataFrame) -> DataFrame:
    """Materialise a small result where it outlives executors.

    Uses the checkpoint folder the cluster names; only a local session without
    one gets a temporary folder.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def drop_copy(staged: DataFrame) -> None:
    """Delete the files of a ``reliable_copy``."""
    spark = staged.sparkSession
    file = staged._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cloakframe-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


# -- what to do with each column ---------------------------------------------
def decisions(
    profile: DataFrame,
    policy: str,
    rules: Rules = DEFAULT_RULES,
    backend: str | None = None,
    enforce_levels: bool = False,
) -> DataFrame:
    """``column, is_named, pii_types, sensitivity, action`` for every column with personal data.

    From a profile, so the input has one row per column and type.  ``auto`` takes
    the strictest default action of the types found; ``enforce_levels`` raises an
    action to the mildest one the column's sensitivity allows.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy '{policy}', choose one of {POLICIES}")
    level = _ranks({d.name: SENSITIVITY_RANK[d.sensitivity] for d in rules.detections})
    default = _ranks({d.name: POLICY_RANK[d.default_action] for d in rules.detections})
    by_column = (
        profile.where("rows_scanned > 0")
        .selectExpr("column", "IF(n_rows > 0, pii_type, NULL) AS kind")
        .selectExpr("column", "kind", f"{level} AS level", f"{default} AS action")
        .groupBy("column")
        .agg(
            F.array_sort(F.collect_set("kind")).alias("pii_types"),
            F.coalesce(F.max("level"), F.lit(0)).alias("level"),
            F.coalesce(F.max("action"), F.lit(POLICY_RANK["mask"])).alias("action"),
        )
    )
    reason = match_reason("column", rules, None if backend is None else lit(backend))
    ranked = (
        by_column.selectExpr("*", f"{reason} AS reason")
        .where("reason IS NOT NULL OR size(pii_types) > 0")
        .withColumn("level", F.expr(f"greatest(level, {sensitivity_rank(name_sensitivity('column', 'reason'))})"))
    )
    act = "action" if policy == "auto" else str(POLICY_RANK[policy])
    if enforce_levels:
        floors = " ".join(f"WHEN {i} THEN {POLICY_RANK[rules.weakest_allowed(n)]}" for n, i in SENSITIVITY_RANK.items())
        act = f"greatest({act}, CASE level {floors} END)"
    return ranked.selectExpr(
        "column",
        "reason IS NOT NULL AS is_named",
        "pii_types",
        f"{array([lit(n) for n in SENSITIVITY_RANK], 'STRING')}[level] AS sensitivity",
        f"{array([lit(n) for n in ('pass', *POLICY_RANK)], 'STRING')}[{act}] AS action",
    )


def _ranks(ranks: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in ranks.items())
    return f"CASE kind {whens} END" if whens else "CAST(NULL AS INT)"


def summarise(
    profile: DataFrame,
    columns: list[str],
    policy: str,
    rules: Rules = DEFAULT_RULES,
    backend: str | None = None,
    unmasked: list[str] = [],
) -> DataFrame:
    """One row: ``row_count, columns, policy_applied, pii_detected, columns_processed, columns_left, pii_types``.

    ``columns_left`` are columns with finds in places that masking leaves as they are.
    """
    named = array([lit(c) for c in rules.named_pii(columns, backend)], "STRING")
    seen = profile.selectExpr(
        "max(rows_scanned) AS row_count",
        "collect_set(IF(n_rows > 0, column, NULL)) AS found",
        "array_sort(collect_set(IF(n_rows > 0, pii_type, NULL))) AS pii_types",
    )
    processed = f"IF(row_count > 0, array_sort(array_union(found, {named})), {array([], 'STRING')})"
    return seen.selectExpr(
        "row_count",
        f"{array([lit(c) for c in columns], 'STRING')} AS columns",
        f"{lit(policy)} AS policy_applied",
        f"size({processed}) > 0 AS pii_detected",
        f"{processed} AS columns_processed",
        f"IF(row_count > 0, array_sort(array_intersect(found, {array([lit(c) for c in unmasked], 'STRING')})), "
        f"{array([], 'STRING')}) AS columns_left",
        "pii_types",
    )


def left_by_mask(schema: T.StructType, scope: Scope, numbers: bool) -> list[str]:
    """Columns with scanned places that masking doesn't change: numbers (unless ``numbers``), nested numbers, map keys."""

    def left(dtype: T.DataType, top: bool) -> bool:
        if isinstance(dtype, T.StructType):
            return any(left(f.dataType, False) for f in dtype.fields)
        if isinstance(dtype, T.ArrayType):
            return left(dtype.elementType, False)
        if isinstance(dtype, T.MapType):
            return scanned(dtype.keyType, scope) or left(dtype.valueType, False)
        return scope.covers(dtype) and not isinstance(dtype, STRINGS) and not (top and numbers)

    return [f.name for f in schema.fields if left(f.dataType, True)]


# -- doing it -----------------------------------------------------------------
def apply_policy(
    df: DataFrame,
    policy: str = "mask",
    rules: Rules = DEFAULT_RULES,
    backend: str | None = None,
    salt: str | None = None,
    scope: Scope = Scope(),
    mask_classified: bool = False,
    enforce_levels: bool = False,
    overlap: str = "each",
    repeatable: bool = True,
    numbers: bool = False,
    most: int | None = None,
) -> SecureResult:
    """Protect a table under a policy.

    ``repeatable=False`` says that reading ``df`` again may give other rows (a
    limit without a total order).  Such a (small) result is staged once, in
    protected form only, and judged on exactly the rows that are returned.
    Of a staged result of ``most`` + 1 rows the last is left out: that there is one
    says that rows are missing (``metadata["truncated"]``).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy '{policy}', choose one of {POLICIES}")
    if not repeatable:
        return _apply_staged(df, policy, rules, backend, salt, scope, mask_classified, enforce_levels, overlap, numbers, most)
    profile = profile_table(df, rules, scope=scope)
    unmasked = left_by_mask(df.schema, scope, numbers) if policy == "mask" else []
    summary = summarise(profile, df.columns, policy, rules, backend, unmasked)
    if policy == "mask" and not enforce_levels:
        # a value without a find stays as it is, so no column need be singled out
        actions = dict.fromkeys(df.columns, "mask")
    else:
        actions = _decide(profile, policy, rules, backend, enforce_levels)
    masked = [c for c, a in actions.items() if a == "mask"]
    starred = rules.named_pii(masked, backend) if mask_classified else []
    masked = [c for c in masked if c not in starred]
    hashed = [c for c, a in actions.items() if a == "hash"]
    out = df
    if masked:
        out = redact_table(out, masked, rules, overlap, numbers)
    if starred:
        out = star_columns(out, starred)
    if hashed:
        out = hash_table(out, resolve_salt(salt), hashed)
    return SecureResult(out, summary, df.columns)


def _decide(profile: DataFrame, policy: str, rules: Rules, backend: str | None, enforce_levels: bool) -> dict[str, str]:
    """Actions per column; at most one row per column comes to the driver."""
    rows = decisions(profile, policy, rules, backend, enforce_levels).collect()
    denied = sorted(r["column"] for r in rows if r["action"] == "deny")
    if denied:
        kinds = sorted({t for r in rows if r["action"] == "deny" for t in r["pii_types"]})
        raise PolicyDenied(f"personal data in columns {denied} (types {kinds}); the policy denies the request")
    return {r["column"]: r["action"] for r in rows}


def _apply_staged(df, policy, rules, backend, salt, scope, mask_classified, enforce_levels, overlap, numbers, most=None) -> SecureResult:
    """Stage every protected form of every value, then pick one form per column.

    What is written holds no value that was found or named as personal data,
    unless the policy is to pass it on: only its masked form, token and types.
    """
    named = set(rules.named_pii(df.columns, backend))
    key = resolve_salt(salt) if policy in ("hash", "auto") or enforce_levels else None
    secret = named if policy in ("hash", "deny") else set()
    if enforce_levels:  # a name's own level already forbids masking it
        secret |= {c for c in named if POLICY_RANK[rules.weakest_allowed(rules.label(c, backend).sensitivity)] > POLICY_RANK["mask"]}
    forms = [_forms(f, rules, scope, key, f.name in secret, overlap, numbers) for f in df.schema.fields]
    if most is not None:  # at most one row more, in its order
        df, forms = df.coalesce(1), [*forms, "monotonically_increasing_id() AS __row"]
    staged = reliable_copy(df.selectExpr(*forms))
    returned, metadata = staged, {}
    if most is not None:
        returned = staged.where(F.col("__row") < most).drop("__row")
        metadata["truncated"] = not staged.where(F.col("__row") >= most).isEmpty()
    try:
        profile = _profile_staged(returned, rules)
        unmasked = left_by_mask(df.schema, scope, numbers) if policy == "mask" else []
        summary = summarise(profile, df.columns, policy, rules, backend, unmasked)
        actions = _decide(profile, policy, rules, backend, enforce_levels)
    except Exception:
        drop_copy(staged)
        raise

    def final(column: str) -> str:
        form = {"pass": "clean", "mask": "masked", "hash": "token"}[actions.get(column, "pass")]
        if form == "masked" and mask_classified and column in named:
            form = "stars"
        return f"{name(column)}.{form} AS {name(column)}"

    return SecureResult(returned.selectExpr(*[final(c) for c in df.columns]), summary, df.columns, metadata, staged=staged)


def _forms(
    f: T.StructField, rules: Rules, scope: Scope, salt: str | None, secret: bool, overlap: str, numbers: bool = False
) -> str:
    """All protected forms of one column as a struct; ``clean`` only where nothing was found."""
    x, text = name(f.name), pii_text(name(f.name), f.dataType)
    places = fields(T.StructType([f]), scope)
    kinds = [f"IF({any_of(p.holds(d, scope) for p in places)}, {lit(d.name)}, NULL)" for d in rules.detections]
    types = f"array_compact({array(kinds if places else [], 'STRING')})"
    masked = map_text(x, f.dataType, lambda v: redact(v, rules, overlap))
    if numbers and isinstance(f.dataType, T.NumericType) and scope.covers(f.dataType):
        masked = redact(text, rules, overlap)
    hidden = "NULL"
    return f"""struct(
        IF({lit(secret)} OR size({types}) > 0, {hidden}, {x}) AS clean,
        IF({lit(secret)}, {hidden}, {masked}) AS masked,
        {apply_mask(text, Mask())} AS stars,
        {token(text, salt) if salt else "CAST(NULL AS STRING)"} AS token,
        {types} AS types) AS {x}"""


def _profile_staged(staged: DataFrame, rules: Rules) -> DataFrame:
    cells = [(c, c, lit(d.name), f"n_{i}_{j}") for i, c in enumerate(staged.columns) for j, d in enumerate(rules.detections)]
    counters = [f"count_if(array_contains({name(c)}.types, {kind})) AS {n}" for c, _, kind, n in cells]
    return unfold_counts(staged.selectExpr("count(1) AS rows_scanned", *counters), cells)


def deny_in_plan(df: DataFrame, rules: Rules = DEFAULT_RULES, columns: list[str] | None = None) -> DataFrame:
    """The table itself, failing at run time on the first row with personal data.

    Needs no scan beforehand; the message names the column, not the value.
    """
    scope = Scope()
    for p in fields(df.schema, scope, columns):
        stop = f"CAST(raise_error({lit('personal data in column ' + p.path)}) AS BOOLEAN)"
        df = df.where(f"IF({p.holds_any(rules, scope)}, {stop}, true)")
    return df
