"""Options of the operators and their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum


#: A larger depth means this one; with links it is refused.
MAX_DEPTH = 100


class Strategy(Enum):
    """How attempts are counted; outcomes are the same."""

    ONE_BY_ONE = "one_by_one"
    DIVIDE_AND_CONQUER = "divide_and_conquer"


class DuplicateKey(Enum):
    FAIL = "fail"
    RETRY_AS_UPDATE = "retry_as_update"
    SKIP = "skip"


class Orphans(Enum):
    THROW = "throw"
    DELETE = "delete"
    DETACH = "detach"


class Cascade(Enum):
    CASCADE = "cascade"
    THROW = "throw"
    PARENT_ONLY = "parent_only"


class Cycles(Enum):
    THROW = "throw"
    IGNORE = "ignore"
    IGNORE_ALL = "ignore_all"


class LinkInsert(Enum):
    ATTACH_EXISTING = "attach_existing"
    INSERT_IF_NEW = "insert_if_new"


class Detail(Enum):
    NONE = 0
    MINIMAL = 1
    FULL = 2


@dataclass(frozen=True)
class Retry:
    """Retries of a commit with growing pauses. ``is_transient`` replaces the built-in test."""

    max_retries: int = 3
    initial_delay: float = 0.1
    backoff: float = 2.0
    is_transient: Callable[[Exception], bool] | None = None

    def __post_init__(self):
        if self.max_retries < 0 or self.initial_delay < 0 or self.backoff <= 0:
            raise ValueError("retries and delay must not be negative, and the back-off must be positive")


@dataclass(frozen=True)
class Options:
    strategy: Strategy = Strategy.ONE_BY_ONE
    detail: Detail = Detail.FULL
    retry: Retry | None = None
    validate_navigations: bool = True

    def __post_init__(self):
        if not isinstance(self.strategy, Strategy):
            raise ValueError(f"unknown strategy {self.strategy!r}")


@dataclass(frozen=True)
class UpsertOptions(Options):
    duplicate_key: DuplicateKey = DuplicateKey.FAIL
    match_by: tuple[str, ...] | None = None


@dataclass(frozen=True)
class NavigationFilter:
    """Include: only the listed navigations of a type are followed, none of other types. Exclude: all but those."""

    include: bool
    rules: frozenset[tuple[str, str]]

    @classmethod
    def including(cls, *rules: tuple[str, str]) -> NavigationFilter:
        return cls._built(True, rules)

    @classmethod
    def excluding(cls, *rules: tuple[str, str]) -> NavigationFilter:
        return cls._built(False, rules)

    @classmethod
    def _built(cls, include, rules):
        if not rules:
            raise ValueError("a navigation filter needs at least one rule")
        return cls(include, frozenset(rules))

    def follows(self, entity: str, navigation: str) -> bool:
        return ((entity, navigation) in self.rules) == self.include


@dataclass(frozen=True)
class GraphOptions(Options):
    max_depth: int = 10
    include_references: bool = False
    include_links: bool = False
    cycles: Cycles = Cycles.THROW
    max_link_count: int = 0
    navigation_filter: NavigationFilter | None = None
    orphans: Orphans = Orphans.THROW
    cascade: Cascade = Cascade.CASCADE
    validate_references: bool = True
    link_insert: LinkInsert = LinkInsert.ATTACH_EXISTING
    validate_links: bool = True
    duplicate_key: DuplicateKey = DuplicateKey.FAIL
    depth: int = field(init=False, default=10)

    def __post_init__(self):
        super().__post_init__()
        if self.max_depth < 0:
            raise ValueError("max_depth must not be negative")
        if self.include_links and self.max_depth > MAX_DEPTH:
            raise ValueError(f"max_depth must be at most {MAX_DEPTH} where links are included")
        object.__setattr__(self, "depth", min(self.max_depth, MAX_DEPTH))
