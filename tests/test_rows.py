"""Flat operators: pinned cases, and a plain sequential model on random batches."""

import random

import pytest
from pyspark.sql import functions as F

from batchwright.errors import BatchError, DetailError
from batchwright.functions.attempts import attempts
from batchwright.model import Check, Entity, ForeignKey, Model
from batchwright.operators import flat
from batchwright.operators.partition import with_chunk
from batchwright.options import Detail, DuplicateKey, Options, Retry, Strategy, UpsertOptions
from batchwright.plans.claims import losers
from batchwright.plans import claims
from batchwright.plans.components import components
from batchwright.plans.constraints import first_of

PRODUCT = Entity("product", ("id",), uniques=(("code",),), checks=(Check("price > 0", "the price must be over 0"),), foreign_keys=(ForeignKey(("category",), "category"),))
MODEL = Model.of(PRODUCT, Entity("category", ("id",)), Entity("line", ("a", "b"), checks=(Check("price > 0", "price"),)), Entity("item", ("id",), generated_key=True, uniques=(("code",),), tokens=()), Entity("token", ("id",), tokens=("version",)))
SCHEMA = "__idx long, id long, code string, price double, category long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def by_idx(result):
    return {r["idx"]: (r["status"], r["reason"]) for r in result.outcomes.collect()}


def test_insert_reasons_and_first_valid_wins(spark):
    stored = frame(spark, [(0, 1, "x", 1.0, None)]).drop("__idx")
    batch = frame(
        spark,
        [
            (0, 2, "a", -1.0, None),  # invalid, so it doesn't reserve its key
            (1, 2, "a", 1.0, None),
            (2, 2, "b", 1.0, None),  # the key of row 1
            (3, 1, "c", 1.0, None),  # stored
            (4, 5, "d", 1.0, 9),  # no such category
            (5, 6, None, 1.0, 7),
            (6, 7, None, None, 7),  # nulls never clash and pass checks
        ],
    )
    result = flat.insert(batch, stored, MODEL, "product", {"category": frame(spark, [(7,)], "id long")})
    assert by_idx(result) == {
        0: ("Failed", "ValidationError"),
        1: ("Success", None),
        2: ("Failed", "DuplicateKey"),
        3: ("Failed", "DuplicateKey"),
        4: ("Failed", "DatabaseConstraint"),
        5: ("Success", None),
        6: ("Success", None),
    }
    assert sorted(r["id"] for r in result.state["product"].collect()) == [1, 2, 6, 7]


def greedy(rows, columns):
    taken, out = [set() for _ in columns], []
    for i, row in enumerate(rows):
        keys = [tuple(row[c] for c in cs) for cs in columns]
        held = [None if None in k else k for k in keys]
        if not any(k in t for k, t in zip(held, taken, strict=True) if k):
            out.append(i)
            for k, t in zip(held, taken, strict=True):
                if k:
                    t.add(k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_several_constraints_are_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [{"a": rng.randrange(8), "b": rng.choice([None, *range(6)]), "c": rng.randrange(5)} for _ in range(40)]
    df = frame(spark, [(i, r["a"], r["b"], r["c"]) for i, r in enumerate(rows)], "__idx long, a long, b long, c long")
    entity = Entity("e", ("a",), uniques=(("b",), ("b", "c")))
    assert sorted(r[0] for r in first_of(df, entity).collect()) == greedy(rows, [("a",), ("b",), ("b", "c")])


def test_rank_per_constraint_would_be_wrong(spark):
    df = frame(spark, [(0, "a", "x"), (1, "a", "y"), (2, "b", "y")], "__idx long, p string, q string")
    assert sorted(r[0] for r in first_of(df, Entity("e", ("p",), uniques=(("q",),))).collect()) == [0, 2]


def dc_attempts(bad, n):
    def run(lo, size):
        failing = any(lo <= b < lo + size for b in bad)
        return 1 if size == 1 or not failing else 1 + run(lo, size // 2) + run(lo + size // 2, size - size // 2)

    return run(0, n) if n else 0


@pytest.mark.parametrize(("n", "bad"), [(0, []), (1, [0]), (8, [3, 5]), (13, [0, 12]), (40, [7]), (5, [])])
def test_attempts(spark, n, bad):
    rows = frame(spark, [(i, "Failed" if i in bad else "Success", False) for i in range(n)], "idx long, status string, retried boolean")
    assert attempts(rows, True).first()[0] == dc_attempts(bad, n)
    assert attempts(rows, False).first()[0] == n


def test_attempts_over_several_buckets(spark):
    """The previous failing row is looked for in other buckets of 2**16 places too; segments aren't listed by row."""
    n, bad = 1_000_003, {0, 5, 65_535, 65_536, 65_537, 400_000, 999_999, 1_000_002}
    places = spark.range(n).select(F.col("id").alias("idx"), F.when(F.col("id").isin(*bad), "Failed").otherwise("Success").alias("status"), F.lit(False).alias("retried"))
    made = attempts(places, True)
    assert "Generate explode" not in made._jdf.queryExecution().optimizedPlan().toString()
    segments, stack = 0, [(0, n, sorted(bad))]
    while stack:
        lo, size, held = stack.pop()
        segments += 1
        if size > 1 and held:
            mid = lo + size // 2
            stack += [(lo, size // 2, [b for b in held if b < mid]), (mid, size - size // 2, [b for b in held if b >= mid])]
    assert made.first()[0] == segments


def test_update_conflicts_and_last_wins(spark):
    stored = frame(spark, [(1, "v1", "a"), (2, "v1", "b"), (3, "v1", "c")], "id long, version string, name string")
    batch = frame(spark, [(0, 1, "v1", "x"), (1, 1, "v1", "y"), (2, 2, "old", "z"), (3, 9, "v1", "w")], "__idx long, id long, version string, name string")
    result = flat.update(batch, stored, MODEL, "token")
    assert by_idx(result) == {0: ("Success", None), 1: ("Success", None), 2: ("Failed", "ConcurrencyConflict"), 3: ("Failed", "ConcurrencyConflict")}
    assert sorted((r["id"], r["name"]) for r in result.state["token"].collect()) == [(1, "y"), (2, "b"), (3, "c")]


def test_delete(spark):
    model = Model.of(Entity("p", ("id",)), Entity("c", ("id",), foreign_keys=(ForeignKey(("p",), "p", "restrict"),)), Entity("d", ("id",), foreign_keys=(ForeignKey(("p",), "p", "set_null"),)))
    stored = frame(spark, [(1,), (2,), (3,)], "id long")
    batch = frame(spark, [(0, 1), (1, 1), (2, 2), (3, 8)], "__idx long, id long")
    others = {"c": frame(spark, [(5, 2)], "id long, p long"), "d": frame(spark, [(6, 1), (7, 3)], "id long, p long")}
    result = flat.delete(batch, stored, model, "p", others)
    assert by_idx(result) == {0: ("Success", None), 1: ("Failed", "ConcurrencyConflict"), 2: ("Failed", "DatabaseConstraint"), 3: ("Failed", "ConcurrencyConflict")}
    assert sorted(r[0] for r in result.state["p"].collect()) == [2, 3]
    assert sorted((r["id"], r["p"]) for r in result.state["d"].collect()) == [(6, None), (7, 3)]


ITEM = "__idx long, id long, code string, price double"


def test_upsert_routes_by_key(spark):
    stored = frame(spark, [(5, "a", 1.0)], "id long, code string, price double")
    batch = frame(spark, [(0, 0, "n", 1.0), (1, 5, "a2", 2.0), (2, 9, "q", 1.0), (3, None, "m", 1.0), (4, 0, "a", 1.0)], ITEM)
    result = flat.upsert(batch, stored, MODEL, "item")
    assert by_idx(result) == {0: ("Success", None), 1: ("Success", None), 2: ("Failed", "ConcurrencyConflict"), 3: ("Success", None), 4: ("Failed", "DuplicateKey")}
    assert sorted(tuple(r) for r in result.state["item"].collect()) == [(5, "a2", 2.0), (6, "n", 1.0), (7, "m", 1.0)]
    skipped = flat.upsert(batch, stored, MODEL, "item", options=UpsertOptions(duplicate_key=DuplicateKey.SKIP))
    assert by_idx(skipped)[4] == ("Skipped", None)
    assert skipped.metrics().first()["skipped_count"] == 1


def test_upsert_by_business_key(spark):
    stored = frame(spark, [(5, "a", 1.0), (6, "b", 1.0)], "id long, code string, price double")
    batch = frame(spark, [(0, 0, "a", 3.0), (1, 77, "c", 1.0), (2, 0, None, 1.0), (3, 0, None, 2.0)], ITEM)
    result = flat.upsert(batch, stored, MODEL, "item", options=UpsertOptions(match_by=("code",)))
    assert sorted(tuple(r) for r in result.state["item"].select("id", "code", "price").collect() if r["code"]) == [(5, "a", 3.0), (6, "b", 1.0), (77, "c", 1.0)]
    assert result.extra["null_matches"].first()[0] == 2
    assert [r["operation"] for r in result.outcomes.orderBy("idx").collect()] == ["Update", "Insert", "Insert", "Insert"]


@pytest.mark.parametrize(("rows", "stored"), [([(0, 0, "a", 1.0), (1, 0, "a", 1.0)], []), ([(0, 0, "a", 1.0)], [(1, "a", 1.0), (2, "a", 1.0)])])
def test_repeated_or_ambiguous_keys_abort(spark, rows, stored):
    with pytest.raises(BatchError):
        flat.upsert(frame(spark, rows, ITEM), frame(spark, stored, "id long, code string, price double"), MODEL, "item", options=UpsertOptions(match_by=("code",)))


@pytest.mark.parametrize("columns", [("id",), ("nothing",), (), ("code", "code")])
def test_match_columns_are_checked(spark, columns):
    with pytest.raises(BatchError):
        flat.upsert(frame(spark, [], ITEM), frame(spark, [], "id long, code string, price double"), MODEL, "item", options=UpsertOptions(match_by=columns))


def test_retry_as_update(spark):
    model = Model.of(Entity("e", ("id",)))
    stored = frame(spark, [(0, "old")], "id long, name string")
    batch = frame(spark, [(0, 0, "x"), (1, 0, "y")], "__idx long, id long, name string")
    result = flat.upsert(batch, stored, model, "e", options=UpsertOptions(duplicate_key=DuplicateKey.RETRY_AS_UPDATE, strategy=Strategy.ONE_BY_ONE))
    assert [tuple(r) for r in result.state["e"].collect()] == [(0, "y")]
    assert result.attempts().first()[0] == 4


def test_empty_batch_and_detail(spark):
    stored = frame(spark, [(1, 1, 2.0)], "a long, b long, price double")
    result = flat.insert(frame(spark, [], "__idx long, a long, b long, price double"), stored, MODEL, "line", options=Options(detail=Detail.NONE))
    m = result.metrics().first()
    assert (m["total_processed"], m["success_rate"], m["is_complete_success"]) == (0, 0.0, False)
    assert result.state["line"].count() == 1
    with pytest.raises(DetailError):
        result.failures()


def test_options_are_checked():
    for bad in ({"max_retries": -1}, {"initial_delay": -1}, {"backoff": 0}):
        with pytest.raises(ValueError):
            Retry(**bad)
    with pytest.raises(ValueError):
        Options(strategy="other")


def test_chunks(spark):
    found = with_chunk(spark.range(10).withColumnRenamed("id", "__idx"), 4).orderBy("__idx").collect()
    assert [r["chunk"] for r in found] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert found[9]["offset"] == 9


def test_filled_navigations_abort_flat_operators(spark):
    from batchwright.model import Navigation

    model = Model.of(Entity("p", ("id",), navigations=(Navigation("kids", "k", ("p",)),)), Entity("k", ("id",)))
    batch = spark.createDataFrame([(0, 1, [5]), (1, 2, [])], "__idx long, id long, kids array<long>")
    stored = spark.createDataFrame([], "id long")
    with pytest.raises(BatchError):
        flat.insert(batch, stored, model, "p")
    assert flat.insert(batch.where("__idx = 1"), stored, model, "p").metrics().first()["success_count"] == 1
    assert flat.insert(batch, stored, model, "p", options=Options(validate_navigations=False)).metrics().first()["success_count"] == 2


def test_cancellation(spark):
    from batchwright.cancellation import Cancellation, Cancelled, not_attempted

    stop = Cancellation(spark)
    with stop.running():
        spark.range(3).count()
    stop.cancel()
    with pytest.raises(Cancelled), stop.running():
        pass
    result = not_attempted(flat.insert(frame(spark, [(0, 1, 1, 2.0)], "__idx long, a long, b long, price double"), frame(spark, [], "a long, b long, price double"), MODEL, "line"))
    m = result.metrics().first()
    assert (m["was_cancelled"], m["total_processed"], m["not_attempted_count"]) == (True, 0, 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    label = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    for in_task in (1000, 0):
        found = components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"), in_task)
        assert {r["node"]: r["label"] for r in found.collect()} == {k: v for k, v in label.items() if k not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("in_task", [1_000_000, 50, 3])
def test_losers_against_going_through_in_order(spark, in_task):
    """In one task, split into components, and with components that no task holds."""
    rng = random.Random(17)
    claims = {(r, f"k{rng.randrange(120)}"): f"o{r if rng.random() < 0.8 else rng.randrange(5)}" for r in range(150) for _ in range(rng.randrange(1, 4))}
    claims |= {(1000 + i, f"c{k}"): f"x{i}" for i in range(60) for k in (i, i + 1)}
    holder, lost = {}, set()
    for root in sorted({r for r, _ in claims}):
        own = {k: o for (r, k), o in claims.items() if r == root}
        if all(holder.get(k, o) == o for k, o in own.items()):
            holder.update(own)
        else:
            lost.add(root)
    rows = [(r, k, o) for (r, k), o in claims.items()]
    found = losers(spark.createDataFrame([*rows, rows[0], (5, None, "o")], "root long, key string, owner string"), in_task=in_task)
    assert sorted(r["root"] for r in found.collect()) == sorted(lost)
    assert losers(spark.createDataFrame([], "root long, key string, owner string")).count() == 0


def test_a_long_chain_of_rivals_takes_few_jobs(spark, monkeypatch):
    """Its length once was the number of rounds; now blocks of it are gone through in order."""
    written = []
    monkeypatch.setattr(claims, "materialize", lambda df, name, write=claims.materialize: written.append(name) or write(df, name))
    chain = spark.range(4000).selectExpr("id AS root", "explode(array(string(id), string(id + 1))) AS key", "string(id) AS owner")
    assert sorted(r["root"] for r in losers(chain, in_task=3000).collect()) == [*range(1, 4000, 2)]
    assert len(written) < 30


UNIQUE = Model.of(Entity("p", ("id",), uniques=(("code",), ("name",)), generated_key=True))


def test_updates_and_inserts_want_one_value(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, code string, name string")
    batch = spark.createDataFrame([(0, 1, "n", "x"), (1, 2, "n", "q"), (2, 1, "n", "w"), (3, 0, "m", "v"), (4, 3, "m", "z"), (5, 3, "b", "z"), (6, 0, "m", "u"), (7, 0, "f", None)], "__idx long, id long, code string, name string")
    found = {r["idx"]: (r["status"], r["reason"]) for r in flat.upsert(batch, stored, UNIQUE, "p").outcomes.collect()}
    good, twice = ("Success", None), ("Failed", "DuplicateKey")
    assert found == {0: good, 1: twice, 2: good, 3: good, 4: twice, 5: twice, 6: twice, 7: good}


def test_null_tokens_and_null_parts_of_keys(spark):
    model = Model.of(Entity("t", ("a", "b"), tokens=("v",)))
    stored = spark.createDataFrame([(1, 1, None, 5), (1, 2, 7, 5)], "a long, b long, v long, x long")
    batch = spark.createDataFrame([(0, 1, 1, None, 6), (1, 1, 2, None, 6), (2, 1, None, 7, 6)], "__idx long, a long, b long, v long, x long")
    found = {r["idx"]: (r["reason"], r["message"]) for r in flat.update(batch, stored, model, "t").outcomes.collect()}
    assert found[0] == (None, None) and found[1][0] == "ConcurrencyConflict" and found[2] == ("ValidationError", "the key column b of t is null")
    assert [(r["a"], r["b"]) for r in flat.delete(batch, stored, model, "t").state["t"].collect()] == [(1, 2)]
