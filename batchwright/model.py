"""The declared model: what Parquet can't say about keys, constraints and relationships."""

from __future__ import annotations

from dataclasses import dataclass, field

from batchwright.errors import BatchError


@dataclass(frozen=True)
class Check:
    """A condition (SQL over the entity's columns) and what to say of rows for which it is false. Null passes."""

    condition: str
    message: str


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` must be null or name a row of ``entity`` by its key."""

    columns: tuple[str, ...]
    entity: str
    on_delete: str = "restrict"  # restrict, cascade or set_null


@dataclass(frozen=True)
class Navigation:
    """A relationship that graph operators can follow.

    collection: rows of ``target`` whose ``columns`` hold this entity's key;
    reference: the row of ``target`` that this entity's ``columns`` name;
    link: rows of ``target`` by way of the entity ``link``, whose ``columns`` hold this entity's key and whose
    ``related`` columns hold the target's key.
    """

    name: str
    target: str
    columns: tuple[str, ...]
    kind: str = "collection"
    link: str | None = None
    related: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class Entity:
    name: str
    key: tuple[str, ...]
    generated_key: bool = False
    tokens: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    navigations: tuple[Navigation, ...] = ()
    store_generated: tuple[str, ...] = ()
    query_filter: bool = False

    def __post_init__(self):
        if not self.key:
            raise BatchError(f"{self.name} has no key")

    @property
    def constraints(self) -> tuple[tuple[str, ...], ...]:
        """The key and every other unique set of columns."""
        return (self.key, *self.uniques)

    def navigation(self, name: str) -> Navigation:
        for n in self.navigations:
            if n.name == name:
                return n
        raise BatchError(f"{self.name} has no navigation {name}")


@dataclass
class Model:
    entities: dict[str, Entity] = field(default_factory=dict)

    @classmethod
    def of(cls, *entities: Entity) -> Model:
        return cls({e.name: e for e in entities})

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise BatchError(f"the model has no entity {name}")
        return self.entities[name]
