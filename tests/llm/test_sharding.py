from collections import Counter

import pytest

from tagmill.llm import sharding as S


def brute(names, size):
    order = [[(S.digest(n, "offset") + j * (S.digest(n, "skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner, at = [-1] * size, [0] * len(names)
    while True:
        for k in range(len(names)):
            while order[k][at[k]] in taken(owner):
                at[k] += 1
            owner[order[k][at[k]]] = k
            if -1 not in owner:
                return owner


def taken(owner):
    return {i for i, k in enumerate(owner) if k >= 0}


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 31), (5, 101), (7, 7)])
def test_table_equals_brute_force(n, size):
    assert S.lookup_table(S.shard_names(n), size).tolist() == brute(S.shard_names(n), size)


def test_shares_are_even_and_few_keys_move():
    a = S.lookup_table(S.shard_names(64))
    assert max(Counter(a.tolist()).values()) - min(Counter(a.tolist()).values()) <= 1
    b = S.lookup_table(S.shard_names(63))
    assert ((a != b) & (a != 63)).mean() < 0.05


def test_bad_tables():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (S.shard_names(9), 7)):
        with pytest.raises(ValueError):
            S.lookup_table(names, size)


def test_odd_keys(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 4)], "k string, shard long")
    got = {r.key_hash: r.shard for r in S.assign(df, "k", S.shard_names(3), 31).collect()}
    assert len(got) == 2 and S.assign(df.limit(0), "k", S.shard_names(3), 31).count() == 0


def test_columns_of_the_result_replace_others(spark):
    df = spark.createDataFrame([("a", "b", "c", 5)], "slot string, `x.y` string, key_hash string, n int")
    out = S.assign(df, "key_hash", S.shard_names(3), 31)
    row = out.first()
    assert sorted(out.columns) == ["key_hash", "n", "shard", "slot", "x.y"] and (row["x.y"], row.n) == ("b", 5)
    assert row.key_hash == S.assign(spark.createDataFrame([("c",)], "k string"), "k", S.shard_names(3), 31).first().key_hash
