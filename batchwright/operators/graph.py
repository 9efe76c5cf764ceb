"""Operators over graphs: a root row and the rows that its navigations reach.

A graph batch is a dict of DataFrames by entity; the root's has ``__idx``. Children are connected by the columns of
their navigation; or, where the parent's key isn't known yet, by ``__owner``, the ``__idx`` of the parent's row in its
own frame. A root and everything below it succeed or fail together.

Rows of an entity with a generated key that isn't set are rows of their own. Until it is known which graphs go ahead they
have provisional keys; then they get the next ids in order of their ``__idx``, and what refers to them follows.

Rows of the root's frame without ``__idx`` are no roots but may be met as children.

``expand`` gives, by entity, the rows with ``__root`` (the root's index), ``__depth`` and ``__parent`` (the parent's
entity and key as text). A node at depth d is expanded if d is under the limit. Expansion and guards run jobs; verdicts
and the next states are plans over tables that are written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.errors import BatchError
from batchwright.functions.keys import entity_id, is_default, shown
from batchwright.model import Entity, ForeignKey, Model, Navigation
from batchwright.operators import links
from batchwright.operators.flat import apply_updates, with_owner_clash, without_parents
from batchwright.options import Cascade, Cycles, DuplicateKey, GraphOptions, LinkInsert, Orphans
from batchwright.plans.claims import losers
from batchwright.plans.constraints import claims_of, with_dangling, with_flag, with_stored, with_validity
from batchwright.plans.guards import guard_references
from batchwright.plans.index import IDX, densify
from batchwright.result import FAILED, SKIPPED, SUCCESS, Result
from batchwright.session import materialize

ROOT, DEPTH, PARENT, OWNER, FRESH = "__root", "__depth", "__parent", "__owner", "__fresh"
#: Keys from here down stand for keys that aren't known yet.
PROVISIONAL = -(1 << 62)


def provisional(entity: Entity) -> Column:
    """Whether a row's key is provisional."""
    return F.coalesce(F.col(entity.key[0]).cast("long") <= PROVISIONAL, F.lit(False)) if entity.generated_key else F.lit(False)


def is_fresh(rows: DataFrame, entity: Entity) -> Column:
    return is_default(rows, entity.key) | provisional(entity)


def _owners(model: Model, name: str, frames: dict[str, DataFrame]) -> tuple[Entity, tuple[str, ...]]:
    """The entity whose rows own those of the frame ``name``, and the columns that name them."""
    found = [(e, n.columns) for e in model.entities.values() if e.name in frames for n in e.navigations if name == (n.link if n.kind == "link" else n.target) and n.kind != "reference"]
    if len(found) != 1:
        raise BatchError(f"{OWNER} in the frame of {name} needs one navigation to it, not {len(found)}")
    return found[0]


def prepare(frames: dict[str, DataFrame], model: Model) -> dict[str, DataFrame]:
    """The frames with provisional keys for rows whose generated key isn't set, and with the keys of owners."""
    keyed = {}
    for name, rows in frames.items():
        entity = model[name]
        if entity.generated_key:
            number, itself = F.monotonically_increasing_id() + F.lit(1 << 61), any(n.target == name for n in entity.navigations)
            if IDX not in rows.columns or itself:  # rows that aren't roots have no index
                given = F.col(IDX) if IDX in rows.columns else F.lit(None).cast("long")
                rows = materialize(rows.withColumn("__number", F.coalesce(given, number)), "numbered")
            key, place = entity.key[0], F.col("__number" if "__number" in rows.columns else IDX)
            rows = rows.withColumn(key, F.when(is_default(rows, entity.key), F.lit(PROVISIONAL) - place).otherwise(F.col(key).cast("long"))).drop("__number")
        keyed[name] = rows
    out = {}
    for name, rows in keyed.items():
        if OWNER in rows.columns:
            parent, columns = _owners(model, name, keyed)
            if IDX not in keyed[parent.name].columns:
                raise BatchError(f"{OWNER} in the frame of {name} names rows of {parent.name}, whose frame has no {IDX}")
            owners = keyed[parent.name].select(F.col(IDX).alias("__at"), *(F.col(k).alias(f"__p{i}") for i, k in enumerate(parent.key)))
            place = spread(rows, F.col(OWNER).cast("long"), F.col(OWNER).isNotNull())
            rows = rows.withColumn("__spread", place).join(owners, (F.col("__spread") == F.col("__at")) & F.col(OWNER).isNotNull(), "left").drop("__spread", "__at")
            rows = rows.withColumns({c: F.when(F.col(OWNER).isNull(), F.col(c)).otherwise(F.col(f"__p{i}")) for i, c in enumerate(columns[: len(parent.key)])}).drop(OWNER, *(f"__p{i}" for i in range(len(parent.key))))
        out[name] = rows
    return out


def _referring(model: Model, name: str) -> dict[str, str]:
    """Columns of the entity ``name`` that hold the key of another one, which is generated; by column."""
    found = {}
    for e in model.entities.values():
        for n in e.navigations:
            if n.kind == "collection" and n.target == name and e.generated_key:
                found[n.columns[0]] = e.name
            elif n.kind == "reference" and e.name == name and model[n.target].generated_key:
                found[n.columns[0]] = n.target
            elif n.kind == "link" and n.link == name:
                found |= {c: o.name for c, o in ((n.columns[0], e), (n.related[0], model[n.target])) if o.generated_key}
    return found | {fk.columns[0]: fk.entity for fk in model[name].foreign_keys if fk.entity in model.entities and model[fk.entity].generated_key}


def known_ids(kept: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model) -> dict[str, DataFrame]:
    """By entity with provisional keys the ids that they stand for: __old, __new."""
    ids = {}
    for name, rows in kept.items():
        entity = model[name]
        if entity.generated_key:
            key = entity.key[0]
            new = rows.where(provisional(entity)).select((F.lit(PROVISIONAL) - F.col(key)).alias("__at")).distinct()
            top = targets[name].select(F.col(key).cast("long").alias(key)).unionByName(rows.where(~provisional(entity)).select(F.col(key).cast("long").alias(key))).agg(F.coalesce(F.max(key), F.lit(0))).scalar()
            dense = densify(new.withColumn("__new", F.col("__at")), "__new", 1)
            ids[name] = materialize(dense.select((F.lit(PROVISIONAL) - F.col("__at")).alias("__old"), (F.col("__new") + top).alias("__new")), "ids")
    return ids


def spread(rows: DataFrame, column: Column, meets: Column) -> Column:
    """``column`` to join by, where ``meets``; else a number from 0 that depends on the whole row. Rows that meet nothing,
    such as those with a null, would all go to one task otherwise."""
    return F.when(meets, column).otherwise(F.shiftrightunsigned(F.xxhash64(*rows.columns), 1))


def _renamed(rows: DataFrame, column: str, ids: DataFrame, text: str | None = None) -> DataFrame:
    """``rows`` with the known ids in ``column``; with ``text``, a column of texts that begin with it."""
    old = F.col(column).cast("long") if text is None else F.when(F.col(column).startswith(text), F.substring(column, len(text) + 1, 40).try_cast("long"))
    new = F.col("__new") if text is None else F.concat(F.lit(text), F.col("__new"))
    names = rows.columns
    meets = F.coalesce(old <= PROVISIONAL, F.lit(False))
    joined = rows.withColumn("__at", spread(rows, old, meets)).join(ids.select(F.col("__old").alias("__at"), new.alias("__known")), "__at", "left")
    return joined.select(*(F.coalesce("__known", F.col(c)).alias(c) if c == column else F.col(c) for c in names))


def with_ids(rows: DataFrame, name: str, model: Model, ids: dict[str, DataFrame]) -> DataFrame:
    """Rows of an entity with known ids in place of the provisional ones: of their own key, of what they refer to, and
    of their parents."""
    if name in ids:
        rows = _renamed(rows, model[name].key[0], ids[name])
    for column, other in _referring(model, name).items():
        if other in ids and column in rows.columns:
            rows = _renamed(rows.withColumn(column, F.col(column).cast("long")), column, ids[other])
    if PARENT in rows.columns:
        for parent, known in ids.items():
            rows = _renamed(rows, PARENT, known, f"{parent} ")
    return rows


def as_stored(rows: DataFrame, target: DataFrame) -> DataFrame:
    """The columns of ``target``, with its types."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema))


def followed(model: Model, entity: Entity, options: GraphOptions) -> Iterator[Navigation]:
    """The navigations of ``entity`` that these options follow."""
    for n in entity.navigations:
        if n.kind == "reference" and not options.include_references or n.kind == "link" and not options.include_links:
            continue
        if options.navigation_filter is None or options.navigation_filter.follows(entity.name, n.name):
            yield n


def check_filter(model: Model, options: GraphOptions) -> None:
    """Raise for a filter that names what isn't there or can't be followed with these options."""
    for name, navigation in sorted(options.navigation_filter.rules) if options.navigation_filter else ():
        n = model[name].navigation(navigation)
        if options.navigation_filter.include and (n.kind == "reference" and not options.include_references or n.kind == "link" and not options.include_links):
            raise BatchError(f"{name}.{navigation} is a {n.kind}, which these options don't follow")


def _below(parents: DataFrame, entity: Entity, n: Navigation, target: Entity, frames: dict[str, DataFrame]) -> DataFrame:
    """The rows that one navigation reaches from ``parents``."""
    keys = parents.select(ROOT, DEPTH, F.concat(F.lit(f"{entity.name} "), shown(entity.key)).alias(PARENT), *(F.col(k).alias(f"__p{i}") for i, k in enumerate(n.columns if n.kind == "reference" else entity.key)))
    rows = frames[n.target].drop(IDX)
    if n.kind == "link":
        links = frames[n.link].select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(n.columns)), *(F.col(c).alias(f"__r{i}") for i, c in enumerate(n.related)))
        keys = keys.join(links, [f"__p{i}" for i in range(len(n.columns))])
        on = [F.col(k) == F.col(f"__r{i}") for i, k in enumerate(target.key)]
    else:
        on = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(target.key if n.kind == "reference" else n.columns[: len(entity.key)])]
    found = keys.join(rows, on)
    return found.select(*rows.columns, ROOT, (F.col(DEPTH) + 1).alias(DEPTH), PARENT)


def expand(frames: dict[str, DataFrame], model: Model, root: str, options: GraphOptions) -> dict[str, DataFrame]:
    """Rows by entity with their marks; a join for each navigation of each level. Types that reach themselves are
    followed level by level until nothing is found; others end by themselves."""
    check_filter(model, options)
    start = frames[root].where(F.col(IDX).isNotNull()).withColumns({ROOT: F.col(IDX), DEPTH: F.lit(0), PARENT: F.lit(None).cast("string")}).drop(IDX)
    level, out, depth = {root: [start]}, {root: [start]}, 0
    seen = {root}
    while level and depth < options.depth:
        below: dict[str, list[DataFrame]] = {}
        for name, parts in level.items():
            entity, parents = model[name], reduce(DataFrame.unionByName, parts)
            for n in followed(model, entity, options):
                if n.target in frames:
                    rows = _below(parents, entity, n, model[n.target], frames)
                    if n.target in seen:  # the types may go round
                        rows = materialize(rows, "level")
                        if rows.isEmpty():
                            continue
                    below.setdefault(n.target, []).append(rows)
        seen |= set(below)
        for name, parts in below.items():
            out.setdefault(name, []).extend(parts)
        level, depth = below, depth + 1
    return {name: reduce(DataFrame.unionByName, parts) for name, parts in out.items()}


def revisited(nodes: dict[str, DataFrame], model: Model) -> DataFrame:
    """(root, entity, id, visits) of rows that one root reaches several times: cycles and shared rows."""
    parts = [rows.groupBy(F.col(ROOT).alias("root"), F.lit(name).alias("entity"), shown(model[name].key).alias("id")).agg(F.count(F.lit(1)).alias("visits")) for name, rows in nodes.items()]
    return reduce(DataFrame.unionByName, parts).where("visits > 1")


def once_each(nodes: dict[str, DataFrame], model: Model, options: GraphOptions) -> dict[str, DataFrame]:
    """Each row once for every root, where it is met first; raise if rows may not be met again."""
    if options.cycles is Cycles.THROW and not revisited(nodes, model).isEmpty():
        raise BatchError("a graph reaches a row twice")
    if options.cycles is Cycles.IGNORE:
        loops = [rows.where(F.col(PARENT) == F.concat(F.lit(f"{name} "), shown(model[name].key))).select(ROOT) for name, rows in nodes.items()]
        if not reduce(DataFrame.unionByName, loops).isEmpty():
            raise BatchError("a row refers to itself")
    out = {}
    for name, rows in nodes.items():
        columns = [c for c in rows.columns if c not in (ROOT, *model[name].key)]
        best = rows.groupBy(ROOT, *model[name].key).agg(F.min_by(F.struct(*columns), F.struct(DEPTH, PARENT)).alias("__first"))
        out[name] = best.select(*(F.col("__first")[c].alias(c) if c in columns else F.col(c) for c in rows.columns))
    return out


def _written(nodes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The expanded rows as tables: verdicts, claims and the next states all read them."""
    return {name: materialize(rows, "nodes") for name, rows in nodes.items()}


def hierarchy(nodes: dict[str, DataFrame], model: Model) -> DataFrame:
    """Edges: root, parent, entity, id, depth."""
    return reduce(DataFrame.unionByName, [rows.select(F.col(ROOT).alias("root"), F.col(PARENT).alias("parent"), F.lit(name).alias("entity"), shown(model[name].key).alias("id"), F.col(DEPTH).alias("depth")) for name, rows in nodes.items()])


def statistics(edges: DataFrame) -> DataFrame:
    """Rows by depth and entity."""
    return edges.groupBy("depth", "entity").agg(F.count(F.lit(1)).alias("rows"))


def descendants(edges: DataFrame) -> DataFrame:
    """root and its descendants without itself."""
    return edges.where("depth > 0").select("root", "entity", "id", "depth")


def first_roots(claims: DataFrame) -> DataFrame:
    """Of ``claims`` (root, key) the roots that may go ahead: in order of their index, one that shares no key with an
    earlier one that went ahead."""
    lost = losers(claims.select("root", "key", F.col("root").cast("string").alias("owner")))
    return claims.select("root").distinct().join(lost, "root", "left_anti")


def _failures(name: str, flagged: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """root, depth, entity, reason of the rows that break a rule."""
    reason = F.lit(None).cast("string")
    for condition, text in reversed(rules):
        reason = F.when(condition, text).otherwise(reason)
    return flagged.select(F.col(ROOT).alias("root"), F.col(DEPTH).alias("depth"), F.lit(name).alias("entity"), reason.alias("reason")).where("reason is not null")


def _foreign(entity: Entity, nodes: dict[str, DataFrame], related: dict[str, DataFrame], model: Model) -> tuple[Entity, dict[str, DataFrame]]:
    """The tables that foreign keys are held against: the stored rows and those of the graphs themselves."""
    there = {}
    for fk in entity.foreign_keys:
        key = model[fk.entity].key
        parts = [t.select(*key) for t in (related.get(fk.entity), nodes.get(fk.entity)) if t is not None]
        if fk.entity in related or fk.entity in nodes:
            there[fk.entity] = reduce(DataFrame.unionByName, parts)
    return entity, there


def judge(nodes: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, references: set[str], related: dict[str, DataFrame]) -> DataFrame:
    """root, depth, entity, reason of every row that can't be written. ``nodes`` have ``__fresh``: whether the row is
    inserted; others must be stored, and no other stored row may have their unique values."""
    keys, found = {e.name: e.key for e in model.entities.values()}, []
    for name, rows in nodes.items():
        entity = model[name]
        flagged = with_stored(with_validity(rows, entity), targets[name], entity)
        match = (*entity.key, *entity.tokens)
        flagged = with_flag(flagged, targets[name], match, match, "__there", entity.tokens)
        if name in references:
            clash, gone = F.lit(False), ~F.col(FRESH) & ~F.col("__there")
        else:
            flagged = with_owner_clash(flagged, targets[name], entity)
            clash, gone = F.when(F.col(FRESH), F.col("__stored")).otherwise(F.col("__owned")), ~F.col(FRESH) & ~F.col("__there")
        entity, there = _foreign(entity, nodes, related, model)
        flagged = with_dangling(flagged, entity, there, keys)
        found.append(_failures(name, flagged, [(F.col("__invalid").isNotNull(), "ValidationError"), (gone, "ConcurrencyConflict"), (clash, "DuplicateKey"), (F.col("__dangling").isNotNull(), "DatabaseConstraint")]))
    return reduce(DataFrame.unionByName, found)


def rivals(nodes: dict[str, DataFrame], model: Model, shared: set[str], failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots that fail because two of their own rows want one unique value, as ``failures`` are; and (root) those that
    want one that an earlier root gets. Inserted rows claim their key and unique values, updated rows the latter."""
    parts = []
    for name, rows in nodes.items():
        if name not in shared:
            entity = model[name]
            for fresh in (True, False):
                if fresh or entity.uniques:
                    one = F.to_json(F.struct(*entity.key))
                    owner = F.struct(F.lit(fresh).alias("fresh"), one.alias("row"))
                    parts.append(claims_of(rows.where(F.col(FRESH) if fresh else ~F.col(FRESH)), entity, owner, ROOT, with_key=fresh))
    if not parts:
        none = failures.select("root").where(F.lit(False))
        return failures.where(F.lit(False)), none
    claims = reduce(DataFrame.unionByName, parts)
    shared_keys = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    contested = claims.join(shared_keys, "key").join(failures.select("root").distinct(), "root", "left_anti")
    claims = materialize(contested, "graph-claims")  # few: what only one row wants is no matter
    twice = claims.distinct().groupBy("root", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root").distinct()
    inner = twice.select("root", F.lit(0).alias("depth"), F.lit("").alias("entity"), F.lit("DuplicateKey").alias("reason"))
    among = claims.join(twice, "root", "left_anti")
    return inner, losers(among.select("root", "key", F.when(F.col("owner.fresh"), F.concat(F.lit("root "), F.col("root"))).otherwise(F.col("owner.row")).alias("owner")))


def _by_root(roots: DataFrame, entity: Entity, failures: DataFrame, lost: DataFrame, operation: Column) -> DataFrame:
    """Outcomes: a root fails with the reason of its highest failing row, or because an earlier root has a key."""
    worst = failures.groupBy("root").agg(F.min_by("reason", F.struct("depth", "entity", "reason")).alias("reason"), F.count(F.lit(1)).alias("failing_rows"))
    behind = lost.select(F.col("root").alias(ROOT), F.lit(True).alias("__behind"))
    joined = roots.join(worst.withColumnRenamed("root", ROOT), ROOT, "left").join(behind, ROOT, "left")
    reason = F.coalesce("reason", F.when(F.col("__behind"), "DuplicateKey"))
    return joined.select(
        F.col(ROOT).alias("idx"),
        entity_id(entity.key).alias("entity_id"),
        operation.alias("operation"),
        F.when(reason.isNull(), SUCCESS).otherwise(FAILED).alias("status"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.concat(F.lit("Graph "), F.lower(operation), F.lit(" failed: "), reason)).alias("message"),
        F.lit(False).alias("retried"),
        (operation == "Insert").alias("is_default_key"),
    )


def _shown_ids(outcomes: DataFrame, entity: Entity, ids: dict[str, DataFrame]) -> DataFrame:
    """``outcomes`` with the ids of written roots; a root that wasn't written and has none yet has 0."""
    if entity.name not in ids:
        return outcomes
    key, names = entity.key[0], outcomes.columns
    joined = outcomes.withColumn("__old", F.col("entity_id")[key].cast("long")).join(ids[entity.name], "__old", "left")
    known = F.coalesce("__new", F.when(F.col("__old") > PROVISIONAL, F.col("__old")).otherwise(F.lit(0)))
    return joined.withColumn("entity_id", F.struct(known.cast("long").alias(key))).select(*names)


def _kept(nodes: dict[str, DataFrame], outcomes: DataFrame) -> dict[str, DataFrame]:
    good = outcomes.where(F.col("status") == SUCCESS).select(F.col("idx").alias(ROOT))
    return {name: rows.join(good, ROOT, "left_semi") for name, rows in nodes.items()}


def _references(model: Model, root: str, nodes, options: GraphOptions) -> set[str]:
    """Entities that are only met by references or links: their rows are shared, not owned."""
    owned = {root} | {n.target for e in nodes for n in followed(model, model[e], options) if n.kind == "collection"}
    return set(nodes) - owned


def wanted_links(nodes: dict[str, DataFrame], frames: dict[str, DataFrame], model: Model, options: GraphOptions) -> Iterator[tuple[Entity, Navigation, DataFrame]]:
    """Of every link navigation that is followed, the link rows that the graphs ask for, with ``__root``. The frame of
    the link entity holds them."""
    for name, rows in nodes.items():
        entity = model[name]
        for n in followed(model, entity, options):
            if n.kind == "link" and n.link in frames:
                owners = rows.select(ROOT, *(F.col(k).alias(c) for k, c in zip(entity.key, n.columns, strict=True)))
                yield entity, n, frames[n.link].join(owners, [*n.columns])


def link_failures(entity: Entity, n: Navigation, wanted: DataFrame, targets: dict[str, DataFrame], fresh: DataFrame | None, model: Model, options: GraphOptions) -> DataFrame:
    """Roots that ask for too many links, or for links to rows that aren't there (nor inserted with them)."""
    capped = links.over_cap(wanted, options.max_link_count).select("root", F.lit(1).alias("depth"), F.lit(n.link).alias("entity"), F.lit("ValidationError").alias("reason"))
    if not options.validate_links:
        return capped
    key = model[n.target].key
    there = targets[n.target].select(*key)
    if options.link_insert is LinkInsert.INSERT_IF_NEW and fresh is not None:
        there = there.unionByName(fresh.select(*key))
    missing = links.missing_related(wanted, there, n.related, key).select("root", F.lit(1).alias("depth"), F.lit(n.link).alias("entity"), F.lit("DatabaseConstraint").alias("reason"))
    return capped.unionByName(missing)


def insert_graph(frames: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, root: str, options: GraphOptions | None = None, related: dict[str, DataFrame] | None = None) -> Result:
    """Insert whole graphs. Of roots that want the same child row, or the same unique value, the first one gets it; rows
    met by reference are shared and inserted once where they aren't stored."""
    options = options or GraphOptions()
    frames = prepare(frames, model)
    nodes = once_each(expand(frames, model, root, options), model, options)
    nodes = _written({name: rows.withColumn(FRESH, F.lit(True)) for name, rows in nodes.items()})
    shared = _references(model, root, nodes, options)
    linked = [*wanted_links(nodes, frames, model, options)]
    attached = {n.target for _, n, _ in linked} if options.link_insert is LinkInsert.ATTACH_EXISTING else set()
    nodes = {name: rows for name, rows in nodes.items() if name not in attached}  # rows that are only attached aren't written
    failures = judge(nodes, targets, model, shared, related or {})
    for entity, n, wanted in linked:
        failures = failures.unionByName(link_failures(entity, n, wanted, targets, frames.get(n.target), model, options))
    inner, lost = rivals(nodes, model, shared, failures)
    outcomes = materialize(_by_root(nodes[root], model[root], failures.unionByName(inner), lost, F.lit("Insert")), "outcomes")
    kept, state = _kept(nodes, outcomes), {}
    ids = known_ids(kept, targets, model)
    kept = {name: with_ids(rows, name, model, ids) for name, rows in kept.items()}
    for name, rows in kept.items():
        fresh = as_stored(rows, targets[name])
        if name in shared:
            fresh = fresh.dropDuplicates([*model[name].key]).join(targets[name].select(*model[name].key), [*model[name].key], "left_anti")
        state[name] = targets[name].unionByName(fresh)
    good = outcomes.where(F.col("status") == SUCCESS).select(F.col("idx").alias(ROOT))
    extra = {}
    for entity, n, wanted in linked:
        wanted = with_ids(wanted.join(good, ROOT, "left_semi"), n.link, model, ids)
        new = links.created(wanted, targets[n.link], n.columns, n.related)
        state[n.link] = state.get(n.link, targets[n.link]).unionByName(as_stored(new, targets[n.link]))
        extra["links"] = _also(extra.get("links"), links.counts(new.withColumn("change", F.lit("added")), f"{entity.name}.{n.name}"))
    edges = hierarchy(kept, model)
    return Result(_shown_ids(outcomes, model[root], ids), state, options, {"hierarchy": edges, "statistics": statistics(edges), **extra})


def _also(before: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if before is None else before.unionByName(more)


def orphans(nodes: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, options: GraphOptions) -> dict[str, DataFrame]:
    """By entity the stored children of submitted parents that aren't submitted with them; with ``__root`` and
    ``__navigation``."""
    out: dict[str, list[DataFrame]] = {}
    for name, rows in nodes.items():
        entity = model[name]
        for n in followed(model, entity, options):
            if n.kind == "collection" and n.target in targets:
                parents = rows.where(F.col(DEPTH) < options.depth).select(ROOT, *(F.col(k).alias(f"__p{i}") for i, k in enumerate(entity.key)))
                stored = targets[n.target].join(parents, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(n.columns)]).select(*targets[n.target].columns, ROOT, F.lit(n.name).alias("__navigation"))
                left = stored.join(nodes[n.target].select(*model[n.target].key), [*model[n.target].key], "left_anti") if n.target in nodes else stored
                out.setdefault(n.target, []).append(left)
    return {name: reduce(DataFrame.unionByName, parts) for name, parts in out.items()}


def without_orphans(state: dict[str, DataFrame], found: dict[str, DataFrame], model: Model, behavior: Orphans) -> dict[str, DataFrame]:
    """The tables after their orphans are deleted (with what is below them) or detached. A detached row stays; its
    foreign key becomes null where the navigation isn't required."""
    state = dict(state)
    for name, rows in found.items():
        if behavior is Orphans.DELETE:
            state = delete_closure(state, {name: rows}, model, name)
        else:
            for entity in model.entities.values():
                for n in entity.navigations:
                    if n.kind == "collection" and n.target == name and not n.required:
                        gone = rows.where(F.col("__navigation") == n.name).select(*model[name].key).distinct().withColumn("__off", F.lit(True))
                        state[name] = state[name].join(gone, [*model[name].key], "left").select(*(F.when(F.col("__off").isNull(), F.col(c)).alias(c) if c in n.columns else F.col(c) for c in state[name].columns))
    return state


def _with_route(nodes: dict[str, DataFrame], model: Model, root: str, operation: str) -> dict[str, DataFrame]:
    """The nodes with ``__fresh``: whether they are inserted. The root of an update never is."""
    return {name: rows.withColumn(FRESH, F.when(F.lit(operation == "Update" and name == root) & (F.col(DEPTH) == 0), F.lit(False)).otherwise(is_fresh(rows, model[name]))) for name, rows in nodes.items()}


def _retry_roots(nodes: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, root: str) -> dict[str, DataFrame]:
    """Roots to insert whose key is stored, as updates; ``__retried`` marks them."""
    entity = model[root]
    flagged = with_flag(nodes[root], targets[root], entity.key, entity.key, "__there")
    again = F.col(FRESH) & F.col("__there") & (F.col(DEPTH) == 0)
    return nodes | {root: flagged.withColumn("__retried", again).withColumn(FRESH, F.col(FRESH) & ~again).drop("__there")}


def update_graph(frames: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, root: str, options: GraphOptions | None = None, related: dict[str, DataFrame] | None = None, operation: str = "Update") -> Result:
    """Update whole graphs: children whose key isn't set are inserted, others replaced; stored children that aren't
    submitted are orphans. Orphans of failing roots stay as they are."""
    options, entity = options or GraphOptions(), model[root]
    frames = prepare(frames, model)
    nodes = _with_route(once_each(expand(frames, model, root, options), model, options), model, root, operation)
    retries = operation == "Upsert" and options.duplicate_key is DuplicateKey.RETRY_AS_UPDATE
    nodes = _written(_retry_roots(nodes, targets, model, root) if retries else nodes)
    if options.orphans is Orphans.THROW:
        found = [r.select(ROOT) for r in orphans(nodes, targets, model, options).values()]
        if found and not reduce(DataFrame.unionByName, found).isEmpty():
            raise BatchError("stored children are missing from their parents")
    shared = _references(model, root, nodes, options)
    failures = judge(nodes, targets, model, shared, related or {})
    inner, lost = rivals(nodes, model, shared, failures)
    tops = nodes[root].where(F.col(DEPTH) == 0)
    route = F.when(F.col(FRESH), "Insert").otherwise("Update") if operation == "Upsert" else F.lit("Update")
    outcomes = _by_root(tops, entity, failures.unionByName(inner), lost, route)
    if operation == "Upsert" and options.duplicate_key is not DuplicateKey.FAIL:
        outcomes = _settled(outcomes, tops, options.duplicate_key)
    outcomes = materialize(outcomes, "outcomes")
    kept = _kept(nodes, outcomes)
    ids = known_ids(kept, targets, model)
    final, state = {name: with_ids(rows, name, model, ids) for name, rows in kept.items()}, {}
    for name, rows in final.items():
        added = as_stored(rows.where(F.col(FRESH)), targets[name])
        added = targets[name].unionByName(added.dropDuplicates([*model[name].key]) if name in shared else added)
        changed = rows.where(~F.col(FRESH))
        changed = as_stored(changed.select(*targets[name].columns, ROOT), targets[name].withColumn(ROOT, F.lit(0).cast("long")))
        state[name] = apply_updates(added, changed.withColumnRenamed(ROOT, IDX), model[name])
    found = orphans(final, targets, model, options)
    state = without_orphans({**targets, **state}, found, model, options.orphans)
    extra = {}
    for owner, n, wanted in wanted_links(final, {name: with_ids(f, name, model, ids) for name, f in frames.items()}, model, options):
        change = links.changes(targets[n.link], wanted, n.columns, n.related)
        state[n.link] = as_stored(links.apply_changes(targets[n.link], change, n.columns, n.related, wanted), targets[n.link])
        extra["links"] = _also(extra.get("links"), links.counts(change, f"{owner.name}.{n.name}"))
    edges = hierarchy(final, model)
    return Result(_shown_ids(outcomes, entity, ids), state, options, {"hierarchy": edges, "statistics": statistics(edges), "routes": routes(final, model), **extra})


def _settled(outcomes: DataFrame, tops: DataFrame, strategy: DuplicateKey) -> DataFrame:
    """Roots that were to be inserted and met a duplicate key: skipped; or, saved again as updates, in conflict, as no
    stored row has their key. Those whose key was stored are updates already."""
    duplicate = (F.col("operation") == "Insert") & (F.col("reason") == "DuplicateKey")
    if strategy is DuplicateKey.SKIP:
        clear = F.lit(None).cast("string")
        return outcomes.withColumns({"status": F.when(duplicate, SKIPPED).otherwise(F.col("status")), "message": F.when(duplicate, clear).otherwise(F.col("message")), "reason": F.when(duplicate, clear).otherwise(F.col("reason"))})
    again = tops.where("__retried").select(F.col(ROOT).alias("idx"), F.lit(True).alias("__again"))
    joined = outcomes.join(again, "idx", "left")
    retried = duplicate | F.col("__again").isNotNull()
    return joined.withColumns(
        {
            "retried": F.coalesce(retried, F.lit(False)),
            "is_default_key": F.col("is_default_key") | F.col("__again").isNotNull(),
            "message": F.when(duplicate, "no row has this key any more").otherwise(F.col("message")),
            "reason": F.when(duplicate, "ConcurrencyConflict").otherwise(F.col("reason")),
        }
    ).select(*outcomes.columns)


def upsert_graph(frames, targets, model: Model, root: str, options: GraphOptions | None = None, related=None) -> Result:
    """As ``update_graph``, but a root whose key isn't set is an insert; ``duplicate_key`` says what becomes of one that
    meets a duplicate."""
    return update_graph(frames, targets, model, root, options, related, "Upsert")


def routes(nodes: dict[str, DataFrame], model: Model) -> DataFrame:
    """Of every row (with ``__fresh``) whether it is inserted or updated: root, entity, id, route."""
    return reduce(DataFrame.unionByName, [rows.select(F.col(ROOT).alias("root"), F.lit(name).alias("entity"), shown(model[name].key).alias("id"), F.when(F.col(FRESH), "Insert").otherwise("Update").alias("route")) for name, rows in nodes.items()])


def children_of(model: Model, name: str) -> Iterator[tuple[Entity, ForeignKey]]:
    for entity in model.entities.values():
        for fk in entity.foreign_keys:
            if fk.entity == name:
                yield entity, fk


def _goes_on(entity: Entity, child: Entity, fk: ForeignKey, options: GraphOptions) -> bool:
    """Whether a delete follows a foreign key: unless a filter leaves out the navigation that it belongs to."""
    own = [n for n in entity.navigations if n.kind == "collection" and n.target == child.name and n.columns[: len(fk.columns)] == fk.columns]
    return options.navigation_filter is None or not own or any(options.navigation_filter.follows(entity.name, n.name) for n in own)


def below(targets: dict[str, DataFrame], top: DataFrame, model: Model, root: str, options: GraphOptions) -> dict[str, DataFrame]:
    """By entity the stored rows that go with those of ``top`` (the root's key and ``__root``): keys with their marks,
    as ``expand`` gives them. A row that is met several times is there once for every way."""
    start = top.select(*model[root].key, ROOT, F.lit(0).alias(DEPTH), F.lit(None).cast("string").alias(PARENT))
    level, out, depth, seen = {root: [start]}, {root: [start]}, 0, {root}
    met: dict[str, DataFrame] = {root: start.select(*model[root].key)}
    while level and depth < options.depth:
        found: dict[str, list[DataFrame]] = {}
        for name, parts in level.items():
            entity, parents = model[name], reduce(DataFrame.unionByName, parts)
            for child, fk in children_of(model, name):
                if child.name in targets and _goes_on(entity, child, fk, options):
                    keys = parents.select(ROOT, DEPTH, F.concat(F.lit(f"{name} "), shown(entity.key)).alias(PARENT), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(entity.key)))
                    rows = targets[child.name].join(keys, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(fk.columns)]).select(*child.key, ROOT, (F.col(DEPTH) + 1).alias(DEPTH), PARENT)
                    if child.name in seen:  # the types may go round: rows met before aren't followed again
                        rows = materialize(rows.join(met[child.name], [*child.key], "left_anti"), "closure")
                        if rows.isEmpty():
                            continue
                    found.setdefault(child.name, []).append(rows)
        seen |= set(found)
        for name, parts in found.items():
            out.setdefault(name, []).extend(parts)
            keys = reduce(DataFrame.unionByName, parts).select(*model[name].key)
            met[name] = met[name].unionByName(keys) if name in met else keys
        level, depth = found, depth + 1
    return {name: reduce(DataFrame.unionByName, parts) for name, parts in out.items()}


def delete_closure(targets: dict[str, DataFrame], gone: dict[str, DataFrame], model: Model, root: str, options: GraphOptions | None = None) -> dict[str, DataFrame]:
    """The tables without the rows ``gone`` of ``root`` and all that goes with them."""
    nodes = below(targets, gone[root].select(*model[root].key).distinct().withColumn(ROOT, F.lit(0).cast("long")), model, root, options or GraphOptions(max_depth=100))
    return _without(targets, nodes, model)


def _without(targets: dict[str, DataFrame], nodes: dict[str, DataFrame], model: Model) -> dict[str, DataFrame]:
    return {name: rows.join(nodes[name].select(*model[name].key).distinct(), [*model[name].key], "left_anti") if name in nodes else rows for name, rows in targets.items()}


def _held_back(nodes: dict[str, DataFrame], targets: dict[str, DataFrame], model: Model, skip: set[str]) -> DataFrame:
    """(root) of graphs with a row that a stored row which stays refers to by a foreign key that restricts. Rows of other
    graphs of the batch count as rows that go."""
    held = [nodes[next(iter(nodes))].select(ROOT).where(F.lit(False))]
    for name, rows in nodes.items():
        for child, fk in children_of(model, name):
            if child.name in targets and child.name not in skip and fk.on_delete == "restrict":
                stays = targets[child.name]
                if child.name in nodes:
                    stays = stays.join(nodes[child.name].select(*child.key).distinct(), [*child.key], "left_anti")
                flagged = with_flag(rows, stays, model[name].key, fk.columns, "__held")
                held.append(flagged.where("__held").select(ROOT))
    return reduce(DataFrame.unionByName, held).distinct()


def delete_graph(roots: DataFrame, targets: dict[str, DataFrame], model: Model, root: str, options: GraphOptions | None = None) -> Result:
    """Delete roots and what belongs to them. CASCADE: the stored rows that refer to them, as far as depth and filter
    go. THROW: abort if anything does. PARENT_ONLY: the roots alone. Whatever then still refers to a deleted row acts as
    its foreign key is declared: one that restricts fails the root, others cascade or are set to null.

    A root matches by key and tokens; of repeated roots the first succeeds. With links, those of deleted roots go and
    are counted; the related rows stay."""
    options, entity = options or GraphOptions(), model[root]
    check_filter(model, options)
    if options.validate_references:
        guard_references(roots, entity)
    match = (*entity.key, *entity.tokens)
    flagged = with_flag(roots, targets[root], match, match, "__found", entity.tokens)
    first = flagged.where("__found").groupBy(*entity.key).agg(F.min(IDX).alias("__first"))
    flagged = materialize(flagged.join(first, [*entity.key], "left").withColumn("__goes", F.coalesce(F.col("__found") & (F.col("__first") == F.col(IDX)), F.lit(False))), "delete-roots")
    top = flagged.where("__goes").select(*entity.key, F.col(IDX).alias(ROOT))
    only = replace_depth(options, 0) if options.cascade is not Cascade.CASCADE else options
    linked = [(n, model[n.link]) for n in entity.navigations if n.kind == "link" and n.link in targets] if options.include_links else []
    cleaned = {link.name for _, link in linked}
    if options.cascade is Cascade.THROW:
        reached = below({k: v for k, v in targets.items() if k not in cleaned}, top, model, root, replace_depth(options, min(1, options.max_depth)))
        children = [rows.where(F.col(DEPTH) > 0) for rows in reached.values()]
        found = {r["entity"]: r["n"] for r in reduce(DataFrame.unionByName, [c.select(F.lit(name).alias("entity")) for name, c in zip(reached, children, strict=True)]).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).collect()}
        if found:
            raise BatchError(f"rows of {root} (depth 0) to delete have stored children (depth 1): " + ", ".join(f"{n} of {name}" for name, n in sorted(found.items())))
    nodes = _written(below({k: v for k, v in targets.items() if k not in cleaned}, top, model, root, only))
    held = materialize(_held_back(nodes, targets, model, cleaned), "held")
    joined = flagged.join(held.select(F.col(ROOT).alias(IDX), F.lit(True).alias("__held")), IDX, "left")
    reason = F.when(~F.col("__goes"), "ConcurrencyConflict").when(F.col("__held"), "DatabaseConstraint")
    outcomes = joined.select(F.col(IDX).alias("idx"), entity_id(entity.key).alias("entity_id"), F.lit("Delete").alias("operation"), F.when(reason.isNull(), SUCCESS).otherwise(FAILED).alias("status"), reason.alias("reason"), F.when(reason.isNotNull(), F.concat(F.lit("Graph delete failed: "), reason)).alias("message"), F.lit(False).alias("retried"), F.lit(False).alias("is_default_key"))
    kept, extra = _kept(nodes, outcomes), {}
    state = _without(targets, kept, model)
    for name, rows in kept.items():
        for child, fk in children_of(model, name):
            if child.name in state and child.name not in cleaned and fk.on_delete != "restrict":
                state[child.name] = without_parents(state[child.name], rows.select(*model[name].key), fk.columns, model[name].key, fk.on_delete)
    for n, link in linked:
        gone = targets[link.name].join(kept[root].where(F.col(DEPTH) == 0).select(*(F.col(k).alias(c) for k, c in zip(entity.key, n.columns, strict=True))).distinct(), [*n.columns], "left_semi")
        state[link.name] = links.without(state[link.name], kept[root].where(F.col(DEPTH) == 0), n.columns, entity.key)
        extra["links"] = _also(extra.get("links"), links.counts(gone.withColumn("change", F.lit("removed")), f"{root}.{n.name}"))
    edges = hierarchy(kept, model)
    return Result(outcomes, state, options, {"hierarchy": edges, "statistics": statistics(edges), **extra})


def replace_depth(options: GraphOptions, depth: int) -> GraphOptions:
    return replace(options, max_depth=depth)


def _doubled(pointers: DataFrame) -> DataFrame:
    """Each pointer (node, at, steps, ended) taken as far again, by that of the node where it is."""
    onward = pointers.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("ended").alias("__ended"))
    still = pointers.where("not ended").join(onward, "at")
    moved = still.select("node", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__ended").alias("ended"))
    return materialize(pointers.where("ended").unionByName(moved), "pointers")


def chain(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Of a self-referencing type (node, parent; a parent for each node, null for roots) the root and depth of every node
    that a root reaches, in as many rounds as the logarithm of the depth. ``limit`` leaves out what is deeper."""
    pointers = materialize(edges.select("node", F.coalesce("parent", "node").alias("at"), F.col("parent").isNotNull().cast("int").alias("steps"), F.col("parent").isNull().alias("ended")).distinct(), "pointers")
    known, before = pointers.where("ended").count(), -1
    while known != before:
        pointers, before = _doubled(pointers), known
        known = pointers.where("ended").count()
    found = pointers.where("ended").select("node", F.col("at").alias("root"), F.col("steps").alias("depth"))
    return found if limit is None else found.where(F.col("depth") <= limit)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of (node, parent; a parent for each node) that lie on a cycle. After as many steps as there are nodes every
    pointer that hasn't come to an end is on a cycle, and every node of a cycle is where one is; steps are doubled."""
    pointers = materialize(edges.where("parent is not null").select("node", F.col("parent").alias("at"), F.lit(1).alias("steps"), F.lit(False).alias("ended")).distinct(), "pointers")
    nodes, steps = pointers.count(), 1
    while steps < nodes and not pointers.isEmpty():
        pointers, steps = _doubled(pointers.withColumn("steps", F.lit(0))), steps * 2
    return pointers.select(F.col("at").alias("node")).distinct().join(edges.where("parent is not null").select("node"), "node", "left_semi")
