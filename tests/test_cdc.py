import random

from pyspark.sql import functions as F

from mnemospark.operators.cdc import BucketedTable, Feed, winners

SCHEMA = "k string, version long, at string, device string, gone boolean, value string"


def feed():
    return Feed("k", (F.col("version"), F.col("at"), F.col("device")), F.col("gone"))


def brute(rows):
    best = {}
    for r in rows:
        if r[0] is None:
            continue
        order = tuple((x is not None, x) for x in r[1:4])
        if r[0] not in best or order > best[r[0]][0]:
            best[r[0]] = (order, r)
    return sorted(b[1][0] for b in best.values() if not b[1][4])


def ops(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if rng.random() < 0.33 else f"k{rng.randrange(40)}"
        out.append((rng.choice([k, k, k, None]), rng.choice([None, *range(6)]), rng.choice([None, "a", "b"]), rng.choice(["x", "y", None]), rng.choice([True, False, None]), f"v{i}"))
    return out + out[:: 3]


def test_batches_in_any_order_give_one_state(spark, tmp_path):
    rows = ops(300, 1)
    want = brute(rows)
    seen = []
    for seed in range(2):
        table = BucketedTable(spark, f"file://{tmp_path}/t{seed}")
        order = rows[:]
        random.Random(seed).shuffle(order)
        for i in range(0, len(order), 150):
            state = table.apply(spark.createDataFrame(order[i : i + 150], SCHEMA), feed(), 8)
        seen.append(sorted((r.k, r.version, r.at, r.device) for r in state.collect()))
        assert table.version() == -(-len(order) // 150)
    assert seen[0] == seen[1] and [r[0] for r in seen[0]] == want


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t")
    table.apply(spark.createDataFrame([(f"k{i}", 1, "a", "x", False, "v") for i in range(100)], SCHEMA), feed(), 16)
    before = table.manifest()["buckets"]
    table.apply(spark.createDataFrame([("k7", 2, "a", "x", True, "v")], SCHEMA), feed())
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1 and table.read().count() == 99
    assert table.read(1).count() == 100  # an older version stays readable
    table.apply(spark.createDataFrame([("k7", 1, "z", "x", False, "late")], SCHEMA), feed())
    assert table.read().count() == 99  # a late older change doesn't bring it back


def test_empty_feed(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t")
    assert table.apply(spark.createDataFrame([], SCHEMA), feed(), 4).count() == 0
    assert winners(spark.createDataFrame([], SCHEMA), feed()).count() == 0


def test_the_base_is_not_shuffled_for_a_small_batch(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t")
    table.apply(spark.createDataFrame([(f"k{i}", 1, "a", "x", False, "v") for i in range(200)], SCHEMA), feed(), 4)
    base = table._rows(table.manifest())
    won = winners(spark.createDataFrame([("k7", 2, "a", "x", False, "w"), ("new", 1, "a", "x", False, "w")], SCHEMA), feed()).withColumn("__bucket", F.pmod(F.xxhash64("k"), F.lit(4)).cast("int"))
    plan = table._merge(base, won, "k")._jdf.queryExecution().optimizedPlan().toString()
    copied = plan[plan.index("LeftAnti") :]
    assert "Repartition" not in copied[: copied.index("Relation")]
    assert table._merge(base, won, "k").count() == 201


def test_a_manifest_appears_whole_or_not_at_all(spark, tmp_path):
    from mnemospark.storage import commit_file

    folder = f"file://{tmp_path}/m"
    commit_file(spark, f"{folder}/v1.json", "{}")
    try:
        commit_file(spark, f"{folder}/v1.json", "other")
        raise AssertionError("a second writer must fail")
    except Exception as e:
        assert "already exists" in str(e) or "FileAlreadyExists" in str(e)
    assert (tmp_path / "m" / "v1.json").read_text() == "{}"
    # What a writer leaves that died before its rename is no version.
    table = BucketedTable(spark, f"file://{tmp_path}/t")
    table.apply(spark.createDataFrame([("a", 1, "a", "x", False, "v")], SCHEMA), feed(), 2)
    (tmp_path / "t" / "manifests" / ".dead.tmp").write_text("")
    assert table.version() == 1 and table.read().count() == 1
