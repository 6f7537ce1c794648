import math
from collections import Counter, defaultdict

import pytest

from lamina.llm import mixing

SCHEMA = "doc_id long, text string, source string, tokens long, place long, n_chars long"


def rows_of(sizes, seed=0):
    return [(1000 * k + n, "x" * 4 * (1 + (n * 7 + seed) % 5), source, 99, 1, 0) for k, (source, count) in enumerate(sizes.items()) for n in range(count)]


def summed(rows):
    found = Counter()
    for r in rows:
        found[r["source"]] += max(1, -(-len(r["text"] or "") // 4))
    return found


@pytest.mark.parametrize("how", [{"max_repeats": 1.3}, {"max_repeats": 2.0, "whole": True}, {"evenness": 0.9}, {"evenness": 0.99, "max_repeats": 1.1}, {"max_repeats": 3.0, "budget": 5000}])
def test_weights_and_budgets(make, how):
    docs = make(rows_of({"a": 600, "b": 90, "c": 30, None: 8}), SCHEMA)
    plan = mixing.source_plan(docs, block_tokens=40, **how).collect()
    total, number = sum(r["tokens"] for r in plan), len(plan)
    budget = how.get("budget", total)
    shares = {r["source"]: r["tokens"] / total for r in plan}

    def weights(a):
        powered = {s: p**a for s, p in shares.items()}
        return {s: w / sum(powered.values()) for s, w in powered.items()}

    def fits(a):
        w = weights(a)
        repeats = max(w[s] / shares[s] for s in w) / min(w[s] / shares[s] for s in w) if how.get("whole") else max(w[s] / shares[s] for s in w) * budget / total
        return "max_repeats" not in how or repeats <= how["max_repeats"]

    def even(a):
        return -sum(w * math.log(w) for w in weights(a).values()) >= how.get("evenness", 0) * math.log(number)

    a = plan[0]["exponent"]
    # Reached, and one step beyond it is not.
    if "max_repeats" in how:
        assert fits(a) or a == 1.0
    if how == {"evenness": 0.9}:
        assert even(a) and not even(a + 1e-6)
    elif "evenness" not in how:
        assert a == 0 or not fits(a - 1e-6)
    taken = mixing.mix(docs, block_tokens=40, **how).collect()
    got, wanted = summed(taken), {r["source"]: r["wanted"] for r in plan}
    assert all(abs(r["weight"] - weights(a)[r["source"]] * 1e9) <= 1 for r in plan)
    assert all(wanted[s] - 5 < got[s] <= wanted[s] for s in wanted)
    if how.get("whole"):
        assert set(r["doc_id"] for r in taken) == set(r["doc_id"] for r in docs.collect())


def test_epochs_are_whole_permutations_of_blocks(make):
    docs = make(rows_of({"a": 50, "b": 400}), SCHEMA)
    taken = mixing.mix(docs, block_tokens=20, max_repeats=4.0).collect()
    by_epoch = defaultdict(list)
    for r in taken:
        by_epoch[r["source"], r["mix_epoch"]].append(r)
    epochs = {s: max(e for x, e in by_epoch if x == s) for s in "ab"}
    for (source, epoch), rows in by_epoch.items():
        assert len({r["doc_id"] for r in rows}) == len(rows)
        if epoch < epochs[source]:
            assert len(rows) == {"a": 50, "b": 400}[source]
    first, second = ({r["doc_id"]: r["mix_place"] for r in by_epoch["a", e]} for e in (0, 1))
    assert len(set(first.values())) > 3 and any(first[d] != second[d] for d in set(first) & set(second))
    # A block keeps together.
    assert len({(first[d], second[d]) for d in set(first) & set(second)}) == len({second[d] for d in set(first) & set(second)})


def test_no_python_in_the_plan(make):
    plan = mixing.mix(make(rows_of({"a": 5, "b": 9}), SCHEMA), max_repeats=1.2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_of_given_columns_meet_no_others(make):
    names = "_blocks _epochs _last_place _last_hash _weight _exponent _plan_source _source _id _tokens row of hash block blocks epochs times weight exponent plan_source e_place".split()
    schema = "doc_id long, text string, source string, mix_epoch long, " + ", ".join(f"{n} string" for n in names)
    rows = [(n, "abcd" * n, "ab"[n % 2], 9, *names) for n in range(1, 9)]
    found = mixing.mix(make(rows, schema), max_repeats=1.0, whole=True)
    assert found.columns == ["doc_id", "text", "source", *names, "mix_epoch", "mix_place", "mix_order", "mix_weight", "mix_exponent"]
    assert {tuple(r)[3:-5] for r in found.collect()} == {tuple(names)} and {r["doc_id"] for r in found.collect()} == set(range(1, 9))


def test_odd_rows(make):
    rows = [(1, None, "a", 1, 1, 1), (1, None, "a", 1, 1, 1), (None, "", None, 1, 1, 1), (2, "y" * 100_000, "b", 1, 1, 1)]
    found = mixing.mix(make(rows, SCHEMA), max_repeats=1.0, whole=True)
    assert found.columns == [*make(rows, SCHEMA).columns, "mix_epoch", "mix_place", "mix_order", "mix_weight", "mix_exponent"]
    assert sorted((r["doc_id"] for r in found.collect()), key=str) == sorted([1, 1, 2, None], key=str)
    for how in ({"max_repeats": 2.0}, {"evenness": 0.5}):
        assert mixing.mix(make([], SCHEMA), **how).collect() == []
        one = mixing.mix(make([(1, "abc", "a", 1, 1, 1)], SCHEMA), **how).collect()
        assert [r["doc_id"] for r in one] == [1]
    with pytest.raises(ValueError):
        mixing.source_plan(make(rows, SCHEMA))


@pytest.mark.parametrize("name", ["op7_mixing", "op9_embedding_dedup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from check import canonical

    db, path = duckdb.connect(), "/root/testdata/sf0.01"
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got, want = entry.queries()[name](spark, path).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
