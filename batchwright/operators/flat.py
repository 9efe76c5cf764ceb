"""Insert, update, delete and upsert of single rows.

A batch is a DataFrame with the entity's columns and ``__idx``, the place of each row. When several rules fail for a
row, its reason is the first of ValidationError, ConcurrencyConflict, DuplicateKey (stored), DatabaseConstraint; only
rows that pass all of these compete for keys inside the batch, the earliest first. A batch of no rows gives no
outcomes and the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.errors import BatchError
from batchwright.functions.keys import all_set, any_null, entity_id, is_default
from batchwright.model import Entity, Model
from batchwright.options import DuplicateKey, Options, UpsertOptions
from batchwright.plans.constraints import CONFLICT, DANGLING, INVALID, STORED, claims_of, first_of, with_dangling, with_flag, with_stored, with_validity
from batchwright.plans.claims import losers
from batchwright.plans.guards import guard_navigations
from batchwright.plans.index import IDX, densify
from batchwright.result import FAILED, SKIPPED, SUCCESS, Result

OUTCOME = ("idx", "entity_id", "operation", "status", "reason", "message", "retried", "is_default_key")


def _guard(batch: DataFrame, entity: Entity, options: Options | None, operation: str) -> None:
    if options is None or options.validate_navigations:
        guard_navigations(batch, entity, operation)


def _keys(model: Model) -> dict[str, tuple[str, ...]]:
    return {e.name: e.key for e in model.entities.values()}


def _outcomes(judged: DataFrame, entity: Entity) -> DataFrame:
    return judged.select(F.col(IDX).alias("idx"), entity_id(entity.key).alias("entity_id"), "operation", "status", "reason", "message", "retried", (F.col("attempted") == "Insert").alias("is_default_key"))


def _verdict(judged: DataFrame, rules: list[tuple[Column, str, Column]], operation: Column | str) -> DataFrame:
    """Add status, reason, message, operation: the first rule that holds fails the row."""
    reason, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(rules):
        reason, message = F.when(condition, F.lit(name)).otherwise(reason), F.when(condition, text).otherwise(message)
    named = operation if isinstance(operation, Column) else F.lit(operation)
    judged = judged.withColumns({"reason": reason, "message": message})
    return judged.withColumns({"status": F.when(F.col("reason").isNull(), SUCCESS).otherwise(FAILED), "operation": named, "attempted": named, "retried": F.lit(False)})


def judge_insert(batch: DataFrame, target: DataFrame, model: Model, entity: Entity, related: dict[str, DataFrame]) -> DataFrame:
    """The batch with its verdict columns; rows aren't held against each other yet."""
    flagged = with_dangling(with_stored(with_validity(batch, entity), target, entity), entity, related, _keys(model))
    return _verdict(
        flagged,
        [
            (F.col(INVALID).isNotNull(), "ValidationError", F.col(INVALID)),
            (F.col(STORED), "DuplicateKey", F.lit("a stored row has this key")),
            (F.col(DANGLING).isNotNull(), "DatabaseConstraint", F.col(DANGLING)),
        ],
        "Insert",
    )


def compete(judged: DataFrame, entity: Entity, updates: bool = True) -> DataFrame:
    """``judged``, where of the passing rows that want one unique value (of the key, if they are inserted) only the
    first passes. Updates of one row are no rivals. ``updates``: whether there may be any."""
    passing = judged.where(F.col("status") == SUCCESS)
    inserts = passing.where("attempted = 'Insert'")
    if len(entity.constraints) == 1:
        marked = judged.join(first_of(inserts, entity).withColumn("__ahead", F.lit(True)), IDX, "left")
        behind = (F.col("status") == SUCCESS) & (F.col("attempted") == "Insert") & F.col("__ahead").isNull()
    else:
        claims = claims_of(inserts, entity, F.concat(F.lit("row "), F.col(IDX)))
        if updates:
            claims = claims.unionByName(claims_of(passing.where("attempted <> 'Insert'"), entity, F.to_json(F.struct(*entity.key)), with_key=False))
        marked = judged.join(losers(claims).select(F.col("root").alias(IDX), F.lit(True).alias("__behind")), IDX, "left")
        behind = F.coalesce(F.col("__behind"), F.lit(False))
    return marked.withColumns(
        {
            "reason": F.when(behind, "DuplicateKey").otherwise(F.col("reason")),
            "message": F.when(behind, "an earlier row of the batch has this key").otherwise(F.col("message")),
            "status": F.when(behind, FAILED).otherwise(F.col("status")),
        }
    ).drop("__ahead", "__behind")


def assign_ids(rows: DataFrame, target: DataFrame, entity: Entity) -> DataFrame:
    """Give rows whose generated key isn't set the next ids, by their order."""
    if not entity.generated_key:
        return rows
    key = entity.key[0]
    kind = rows.schema[key].dataType
    unset = is_default(rows, entity.key)
    top = target.select(key).unionByName(rows.where(~unset).select(key)).agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    fresh = densify(rows.where(unset).withColumn("__new", F.col(IDX)), "__new", 1)
    return fresh.withColumn(key, (F.col("__new") + top).cast(kind)).drop("__new").unionByName(rows.where(~unset))


def insert(batch: DataFrame, target: DataFrame, model: Model, name: str, related: dict[str, DataFrame] | None = None, options: Options | None = None) -> Result:
    """Insert the rows that can be inserted. Rows without a generated key get one, by their order, after the largest
    that is stored or given."""
    entity = model[name]
    _guard(batch, entity, options, "insert")
    judged = compete(judge_insert(batch, target, model, entity, related or {}), entity, updates=False)
    written = assign_ids(judged.where(F.col("status") == SUCCESS), target, entity)
    shown = written.unionByName(judged.where(F.col("status") != SUCCESS)) if entity.generated_key else judged
    return Result(_outcomes(shown, entity), {name: target.unionByName(written.select(*target.columns))}, options or Options())


def with_owner_clash(rows: DataFrame, target: DataFrame, entity: Entity) -> DataFrame:
    """Add ``__owned``: whether a stored row with another key has one of the row's unique values."""
    clash, owners = F.lit(False), []
    for i, columns in enumerate(entity.uniques):
        stored = target.where(all_set(columns)).select(*(F.col(c).alias(f"__k{j}") for j, c in enumerate(columns)), F.struct(*entity.key).alias(f"__owner{i}"))
        on = [F.col(c) == F.col(f"__k{j}") for j, c in enumerate(columns)]
        rows = rows.join(stored, on, "left").drop(*(f"__k{j}" for j in range(len(columns))))
        clash = clash | F.coalesce(F.col(f"__owner{i}") != F.struct(*(F.col(k).cast(target.schema[k].dataType).alias(k) for k in entity.key)), F.lit(False))
        owners.append(f"__owner{i}")
    return rows.withColumn("__owned", clash).drop(*owners)


def judge_update(batch: DataFrame, target: DataFrame, model: Model, entity: Entity, related: dict[str, DataFrame]) -> DataFrame:
    """The batch with its verdict columns; rows aren't held against each other yet."""
    flagged = with_dangling(with_validity(batch, entity), entity, related, _keys(model))
    match = (*entity.key, *entity.tokens)
    flagged = with_flag(flagged, target, match, match, "__found", entity.tokens).withColumn(CONFLICT, ~F.col("__found")).drop("__found")
    flagged = with_owner_clash(flagged, target, entity)
    return _verdict(
        flagged,
        [
            (F.col(INVALID).isNotNull(), "ValidationError", F.col(INVALID)),
            (F.col(CONFLICT), "ConcurrencyConflict", F.lit("no stored row has this key and token")),
            (F.col("__owned"), "DuplicateKey", F.lit("another stored row has this value")),
            (F.col(DANGLING).isNotNull(), "DatabaseConstraint", F.col(DANGLING)),
        ],
        "Update",
    )


def apply_updates(state: DataFrame, updates: DataFrame, entity: Entity) -> DataFrame:
    """``state`` with the rows of ``updates`` in place of those with the same key; of equal keys the last counts."""
    columns = [c for c in state.columns if c not in entity.key]
    latest = updates.groupBy(*entity.key).agg(F.max_by(F.struct(*columns), IDX).alias("__new")) if columns else updates.select(*entity.key).distinct().withColumn("__new", F.lit(None).cast("struct<x:int>"))
    joined = state.join(latest, [*entity.key], "left")
    return joined.select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns))


def update(batch: DataFrame, target: DataFrame, model: Model, name: str, related: dict[str, DataFrame] | None = None, options: Options | None = None) -> Result:
    """Replace stored rows. A row that isn't stored, or with another token, is a conflict. Of rows with the same key
    all succeed and the last one stays. Unique values are compared with those stored before the batch, and of rows that
    want one new value for different keys the first gets it."""
    entity = model[name]
    _guard(batch, entity, options, "update")
    judged = judge_update(batch, target, model, entity, related or {})
    if entity.uniques:
        judged = compete(judged, entity)
    return Result(_outcomes(judged, entity), {name: apply_updates(target, judged.where(F.col("status") == SUCCESS), entity)}, options or Options())


def delete(batch: DataFrame, target: DataFrame, model: Model, name: str, dependents: dict[str, DataFrame] | None = None, options: Options | None = None) -> Result:
    """Delete stored rows. Of rows with the same key the first succeeds and the others conflict. A row that a row of
    ``dependents`` names by a foreign key that restricts is kept; one that cascades or sets null changes that table."""
    entity = model[name]
    _guard(batch, entity, options, "delete")
    match = (*entity.key, *entity.tokens)
    flagged = with_flag(batch, target, match, match, "__found", entity.tokens)
    first = flagged.where("__found").groupBy(*entity.key).agg(F.min(IDX).alias("__first"))
    flagged = flagged.join(first, [*entity.key], "left")
    held = F.lit(False)
    restricted = [(d, fk) for d in dependents or {} for fk in model[d].foreign_keys if fk.entity == name]
    for i, (d, fk) in enumerate(restricted):
        if fk.on_delete == "restrict":
            flagged = with_flag(flagged, dependents[d], entity.key, fk.columns, f"__held{i}")
            held = held | F.col(f"__held{i}")
    judged = _verdict(
        flagged,
        [
            (~F.coalesce(F.col("__found") & (F.col("__first") == F.col(IDX)), F.lit(False)), "ConcurrencyConflict", F.lit("no stored row has this key and token")),
            (held, "DatabaseConstraint", F.lit("other rows refer to this one")),
        ],
        "Delete",
    )
    gone = judged.where(F.col("status") == SUCCESS).select(*entity.key)
    state = {name: target.join(gone, [*entity.key], "left_anti")}
    for d, fk in restricted:
        if fk.on_delete != "restrict":
            state[d] = without_parents(state.get(d, dependents[d]), gone, fk.columns, entity.key, fk.on_delete)
    return Result(_outcomes(judged, entity), state, options or Options())


def without_parents(rows: DataFrame, gone: DataFrame, columns: tuple[str, ...], key: tuple[str, ...], on_delete: str) -> DataFrame:
    """Children of the keys ``gone``: removed, or with their foreign key set to null."""
    parents = gone.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key))).distinct()
    on = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(columns)]
    if on_delete == "cascade":
        return rows.join(parents, on, "left_anti")
    joined = rows.join(parents.withColumn("__gone", F.lit(True)), on, "left")
    return joined.select(*(F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


# Upsert


def check_match_by(columns: tuple[str, ...], entity: Entity, batch: DataFrame, target: DataFrame) -> None:
    """Whether rows may be matched by these columns at all."""
    if entity.query_filter:
        raise BatchError(f"{entity.name} has a query filter; rows can't be matched safely")
    if not columns or len(set(columns)) != len(columns):
        raise BatchError("name one or more different columns to match by")
    for c in columns:
        if c in {n.name for n in entity.navigations}:
            raise BatchError(f"{c} is a navigation")
        if c not in batch.columns or c not in target.columns:
            raise BatchError(f"{entity.name} has no column {c}")
        if c in entity.key:
            raise BatchError(f"{c} belongs to the key; rows are matched by other columns")
        if c in entity.store_generated:
            raise BatchError(f"{c} is generated by the store")


def duplicate_match_keys(batch: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Match keys without a null that several rows of the batch have."""
    return batch.where(all_set(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def matching_rows(target: DataFrame, batch: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Stored rows whose match key is in the batch."""
    return target.join(batch.where(all_set(columns)).select(*columns).distinct(), [*columns], "left_semi")


def ambiguous_match_keys(batch: DataFrame, target: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Match keys of the batch that several stored rows have."""
    return matching_rows(target, batch, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def guard_match(batch: DataFrame, target: DataFrame, columns: tuple[str, ...]) -> None:
    """Raise for ambiguous or repeated match keys. Both counts come from one action."""
    repeated = duplicate_match_keys(batch, columns).select(F.lit("batch").alias("where"))
    unclear = ambiguous_match_keys(batch, target, columns).select(F.lit("store").alias("where"))
    found = {r["where"]: r["n"] for r in repeated.unionByName(unclear).groupBy("where").agg(F.count(F.lit(1)).alias("n")).collect()}
    if found.get("store"):
        raise BatchError(f"{found['store']} keys match several stored rows")
    if found.get("batch"):
        raise BatchError(f"{found['batch']} keys are in several rows of the batch")


def route(batch: DataFrame, target: DataFrame, entity: Entity, match_by: tuple[str, ...] | None) -> DataFrame:
    """Add ``__route`` (Insert or Update) and ``__null_match``. With ``match_by`` the stored key and tokens of a hit
    replace the batch's."""
    if not match_by:
        return batch.withColumns({"__route": F.when(is_default(batch, entity.key), "Insert").otherwise("Update"), "__null_match": F.lit(None).cast("boolean")})
    taken = (*entity.key, *entity.tokens)
    stored = target.where(all_set(match_by)).select(*match_by, F.struct(*taken).alias("__hit"))
    joined = batch.join(stored, [*match_by], "left")
    columns = [F.coalesce(F.col("__hit")[c], F.col(c)).alias(c) if c in taken else F.col(c) for c in batch.columns]
    return joined.select(*columns, F.when(F.col("__hit").isNull(), "Insert").otherwise("Update").alias("__route"), any_null(match_by).alias("__null_match"))


def judge_upsert(batch: DataFrame, target: DataFrame, model: Model, entity: Entity, options: UpsertOptions, related: dict[str, DataFrame]) -> DataFrame:
    """The batch, routed and with its verdict columns."""
    routed = route(batch, target, entity, options.match_by)
    inserts = judge_insert(routed.where("__route = 'Insert'"), target, model, entity, related)
    updates = judge_update(routed.where("__route = 'Update'"), target, model, entity, related)
    judged = compete(inserts.unionByName(updates, allowMissingColumns=True), entity)
    duplicate = (F.col("__route") == "Insert") & (F.col("reason") == "DuplicateKey")
    if options.duplicate_key is DuplicateKey.SKIP:
        clear = F.lit(None).cast("string")
        return judged.withColumns({"status": F.when(duplicate, SKIPPED).otherwise(F.col("status")), "reason": F.when(duplicate, clear).otherwise(F.col("reason")), "message": F.when(duplicate, clear).otherwise(F.col("message"))})
    if options.duplicate_key is DuplicateKey.RETRY_AS_UPDATE:
        return _retried(judged, target, entity, duplicate, options.match_by)
    return judged


def _retried(judged: DataFrame, target: DataFrame, entity: Entity, duplicate: Column, match_by: tuple[str, ...] | None) -> DataFrame:
    """Insert attempts that met a duplicate key, saved again as updates of the row that has the key: stored, or
    inserted by an earlier row. With a match key that row must have it, else the conflict is lost."""
    owned = match_by or entity.key
    owners = target.select(*owned).unionByName(judged.where((F.col("__route") == "Insert") & (F.col("status") == SUCCESS)).select(*owned))
    found = with_flag(judged, owners, owned, owned, "__owner")
    good, lost = duplicate & F.col("__owner"), duplicate & ~F.col("__owner")
    return found.withColumns(
        {
            "retried": F.coalesce(duplicate, F.lit(False)),
            "operation": F.when(good, "Update").otherwise(F.col("operation")),
            "status": F.when(good, SUCCESS).otherwise(F.col("status")),
            "message": F.when(good, F.lit(None)).when(lost, "no row has this key any more").otherwise(F.col("message")),
            "reason": F.when(good, F.lit(None)).when(lost, "BusinessKeyConflictLost" if match_by else "ConcurrencyConflict").otherwise(F.col("reason")),
        }
    )


def upsert(batch: DataFrame, target: DataFrame, model: Model, name: str, related: dict[str, DataFrame] | None = None, options: UpsertOptions | None = None) -> Result:
    """Insert rows whose key isn't set and update the others; or, with ``match_by``, update the stored rows with the
    same business key and insert the rest. A key that is set but not stored is a failed update, not an insert.

    With ``match_by`` a batch that repeats a key, or a key that several stored rows have, aborts the call."""
    entity, options = model[name], options or UpsertOptions()
    _guard(batch, entity, options, "upsert")
    if options.match_by is not None:
        check_match_by(options.match_by, entity, batch, target)
        guard_match(batch, target, options.match_by)
    judged = judge_upsert(batch, target, model, entity, options, related or {})
    inserted = assign_ids(judged.where("status = 'Success' and operation = 'Insert'"), target, entity)
    others = judged.where("not (status = 'Success' and operation = 'Insert')")
    state = apply_updates(target.unionByName(inserted.select(*target.columns)), judged.where("status = 'Success' and operation = 'Update'"), entity)
    shown = inserted.unionByName(others) if entity.generated_key else judged
    extra = {"null_matches": judged.agg(F.sum(F.col("__null_match").cast("long")).alias("null_match_keys"))}
    return Result(_outcomes(shown, entity), {name: state}, options, extra)
