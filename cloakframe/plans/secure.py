"""The one entry point: a request in, a protected result out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import literals
from cloakframe.functions.tokens import resolve_salt, token_of
from cloakframe.operators.fields import Scope, fields
from cloakframe.operators.relational import aggregate, filter_equal, filter_token, order_limit
from cloakframe.operators.protect import redact_table, star_columns
from cloakframe.plans.policy import SecureResult, apply_policy, left_by_mask, summarise
from cloakframe.plans.request import LIMIT_RANGE, Request, RequestError, check_identifier
from cloakframe.rules import DEFAULT_RULES, Rules
from cloakframe.sources import catalog, inventory
from cloakframe.sources.profiles import Profile, get_profile


@dataclass(frozen=True)
class Settings:
    """What a deployment chooses.  ``match`` says how a filter value that is itself
    personal data is looked up: ``token`` compares its token with a tokenised
    column, ``raw`` compares it with the token of every value of a raw column.

    ``max_rows`` is the deployment's ceiling: no caller may ask for more, and a request
    without a limit is cut there (``truncated`` in the metadata says whether it was).
    Without a ceiling such a request returns all rows.  ``consistent`` stages a masked
    result before it is summarised; by default wherever a limit may return other rows
    when it is read again.  ``numbers`` masks numbers too."""

    rules: Rules = DEFAULT_RULES
    salt: str | None = None
    scope: Scope = Scope()
    max_rows: int | None = None
    match: str = "token"
    mask_classified: bool = False
    enforce_levels: bool = False
    overlap: str = "each"
    consistent: bool | None = None
    numbers: bool = False
    allowed_buckets: tuple[str, ...] = ()
    allowed_prefixes: tuple[str, ...] = ()
    catalog: DataFrame | None = None


def plan_request(
    spark: SparkSession, request: Request, settings: Settings = Settings(), profile: Profile | None = None
) -> DataFrame:
    """The unprotected result as one lazy plan (filters and limits come before any policy)."""
    request = request.checked(settings.max_rows or LIMIT_RANGE[1])
    profile = profile or get_profile(request.backend)
    if profile.kind == "object":
        return _list_objects(spark, request, settings)
    if profile.kind == "catalog":
        columns = settings.catalog or catalog.columns_of_database(spark, request.filters.get("database", "default"))
        labelled = catalog.column_catalog(columns, settings.rules, request.backend)
        return catalog.answer_intent(labelled, request.intent, request.entity, request.filters.get("database"))
    entity = check_identifier(request.entity or profile.infer_entity(request.intent))
    df = profile.scan(spark, entity)
    df = _filter(df, request.filters, settings, profile)
    if request.aggregations:
        df = aggregate(df, request.aggregates(), request.group_by)
    df = order_limit(df, request.sort_keys(), _limit(request, settings), profile)
    return profile.render(df)


def _limit(request: Request, settings: Settings) -> int | None:
    return settings.max_rows if request.limit is None else request.limit


def _filter(df: DataFrame, filters: dict[str, Any], settings: Settings, profile: Profile) -> DataFrame:
    plain = {}
    for name, value in filters.items():
        if not literals.find(value, settings.rules):
            plain[name] = value
            continue
        salt = resolve_salt(settings.salt)
        if settings.match == "raw":
            if name not in df.columns:
                raise RequestError(f"no column '{name}'")
            df = filter_token(df, name, token_of(value, salt), salt)
        else:
            plain[name] = token_of(value, salt)
    return filter_equal(df, plain, profile)


def _list_objects(spark: SparkSession, request: Request, settings: Settings) -> DataFrame:
    if not request.entity:
        raise RequestError("the entity must name the bucket")
    return inventory.list_objects(
        spark,
        request.entity,
        request.filters.get("prefix", ""),
        _limit(request, settings),
        list(settings.allowed_buckets),
        list(settings.allowed_prefixes),
    )


def secure_query(
    spark: SparkSession,
    request: Request,
    settings: Settings = Settings(),
    profile: Profile | None = None,
) -> SecureResult:
    """Run a request under its policy.

    Masking of unlimited results stays lazy, so an error in the data shows when they are
    read.  The other policies look at the result first; it, and every limited result, is
    staged, so that what was judged and summarised is what is returned.
    """
    profile = profile or get_profile(request.backend)
    cut = request.limit is None and settings.max_rows is not None
    one_more = replace(settings, max_rows=settings.max_rows + 1) if cut else settings
    lazy = request.pii_policy == "mask" and not settings.enforce_levels
    consistent = _limit(request, settings) is not None if settings.consistent is None else settings.consistent
    staged = not lazy or consistent
    df = plan_request(spark, request, one_more if cut and staged else settings, profile)
    result = apply_policy(
        df,
        request.pii_policy,
        settings.rules,
        request.backend.lower(),
        settings.salt,
        settings.scope,
        settings.mask_classified,
        settings.enforce_levels,
        settings.overlap,
        repeatable=not staged,
        numbers=settings.numbers,
        most=settings.max_rows if cut and staged else None,
    )
    metadata = {**result.metadata, "backend": request.backend.lower(), "invocation_id": f"inv_{uuid.uuid4()}"}
    if cut and not staged:  # the deployment waives consistency: another look at the table
        metadata["truncated"] = plan_request(spark, replace(request, order_by=()), one_more, profile).count() > settings.max_rows
    return replace(result, metadata=metadata)


@dataclass
class Reply:
    """A result, or a safe error message."""

    success: bool
    result: SecureResult | None = None
    error: str | None = None
    error_type: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def query_data(
    spark: SparkSession,
    arguments: dict[str, Any],
    settings: Settings = Settings(),
    profile: Profile | None = None,
) -> Reply:
    """``secure_query`` from plain arguments; errors come back with personal data masked."""
    try:
        result = secure_query(spark, Request.from_dict(arguments), settings, profile)
        return Reply(True, result, metadata=result.metadata)
    except Exception as error:  # noqa: BLE001 - every failure becomes a safe reply
        return Reply(False, error=literals.scrub(str(error), settings.rules), error_type=type(error).__name__)


def observed(df: DataFrame, observation: Any, rules: Rules = DEFAULT_RULES, scope: Scope = Scope(), most: int | None = None) -> DataFrame:
    """Count rows and finds while the data passes, for results that must be read once.

    ``observation`` is a ``pyspark.sql.Observation``; its metrics are ``row_count``
    and one ``<path>:<type>`` count per scanned place and type. With ``most``, of a
    limited result of one row more (in one partition), that row is counted in
    ``rows_read`` alone and doesn't pass.
    """
    passes, columns = "true", df.columns
    if most is not None:
        df, passes = df.coalesce(1).withColumn("__row", F.monotonically_increasing_id()), f"__row < {most}"
    counts = [
        F.expr(f"count_if({passes} AND {p.holds(d, scope)})").alias(f"{p.path}:{d.name}")
        for p in fields(df.select(*columns).schema, scope)
        for d in rules.detections
    ]
    seen = df.observe(observation, F.count(F.lit(1)).alias("rows_read"), F.expr(f"count_if({passes})").alias("row_count"), *counts)
    return seen if most is None else seen.where(passes).drop("__row")


def deliver(
    spark: SparkSession, request: Request, path: str, settings: Settings = Settings(), profile: Profile | None = None
) -> SecureResult:
    """Write a request's masked result to ``path`` in one pass over the data.

    What the summary says was observed while the rows were written, so nothing is read or run a
    second time: one row more than ``Settings.max_rows`` is asked for, and its presence is what
    ``metadata["truncated"]`` says. The result's data is read from what was written.
    """
    if request.pii_policy != "mask" or settings.enforce_levels:
        raise RequestError("only masking needs no look at the result beforehand")
    profile = profile or get_profile(request.backend)
    most = settings.max_rows if request.limit is None else None
    df = plan_request(spark, request, settings if most is None else replace(settings, max_rows=most + 1), profile)
    watch = Observation()
    seen = observed(df, watch, settings.rules, settings.scope, most)
    starred = settings.rules.named_pii(df.columns, request.backend.lower()) if settings.mask_classified else []
    out = redact_table(seen, [c for c in df.columns if c not in starred], settings.rules, settings.overlap, settings.numbers)
    out = star_columns(out, starred) if starred else out
    out.write.mode("overwrite").parquet(path)
    metrics = watch.get
    n = metrics["row_count"]
    places = fields(df.schema, settings.scope)
    rows = [(p.path, p.column, d.name, metrics[f"{p.path}:{d.name}"], n) for p in places for d in settings.rules.detections]
    rows += [(c, c, None, 0, n) for c in df.columns if c not in {p.column for p in places}]
    counted = spark.createDataFrame(rows, "path string, column string, pii_type string, n_rows long, rows_scanned long")
    unmasked = left_by_mask(df.schema, settings.scope, settings.numbers)
    summary = summarise(counted, df.columns, "mask", settings.rules, request.backend.lower(), unmasked)
    metadata = {"backend": request.backend.lower(), "invocation_id": f"inv_{uuid.uuid4()}"}
    if most is not None:
        metadata["truncated"] = metrics["rows_read"] > most
    return SecureResult(spark.read.schema(out.schema).parquet(path), summary, df.columns, metadata)
