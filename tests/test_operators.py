"""Operators on small tables with known results."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A
from tidemark.operators import inference as I
from tidemark.operators import joins as J
from tidemark.operators import order as O
from tidemark.operators import table as R
from tidemark.plans import relational
from tidemark.sources.tables import from_columns, masked, random_table, read_column, read_csv, write_column, zero_table
from tidemark.sources.weights import encode_weights, read_weights
from tidemark.streaming import windows


def got(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


@pytest.fixture()
def halves(spark):
    """Two keys that take turns, values in hundreds."""
    return from_columns(spark, {"k": [7, 3, 7, 3, 7, 3], "v": [100, 200, 300, 400, 500, 900]})


def test_distinct_flag(spark):
    colours, sizes = [4, 4, 9, 9, 9, 4], [1, 2, 2, 2, 1, 1]
    df = from_columns(spark, {"i": list(range(6)), "colour": colours, "size": sizes})
    for keys, of in ((["colour"], colours), (["size"], sizes), (["colour", "size"], list(zip(colours, sizes)))):
        want = [1] + [int(x != y) for x, y in zip(of, of[1:])]
        assert [r.x for r in R.distinct_flag(df, keys, ["i"], "x").orderBy("i").collect()] == want


def test_distinct_flag_of_a_whole_table_is_made_in_blocks(spark):
    r = np.random.default_rng(2)
    i, a = r.permutation(3000).tolist(), r.integers(0, 3, 3000).tolist()
    by = [x for _, x in sorted(zip(i, a))]
    df = from_columns(spark, {"i": i, "a": a}).withColumn("a", F.when(F.col("a") > 0, F.col("a")))  # also null keys
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = R.distinct_flag(df, ["a"], ["i"], "x").withColumn("task", F.spark_partition_id()).orderBy("i").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.x for r in out] == [1] + [int(x != y) for x, y in zip(by, by[1:])]
    assert len({r.task for r in out}) > 1


def test_group_aggregates(halves):
    out = A.aggregate(halves, ["k"], [("v", "s", "sum"), ("v", "n", "count"), ("v", "lo", "min"), ("v", "hi", "max")])
    assert got(out) == [(3, 1500, 3, 200, 900), (7, 900, 3, 100, 500)]


def test_running_both_ways(halves):
    out = A.running(halves, ["k"], ["v"], [("v", "s", "sum")])
    assert [r.s for r in out.orderBy("k", "v").collect()] == [200, 600, 1500, 100, 400, 900]
    out = A.running(halves, ["k"], ["v"], [("v", "s", "sum")], reverse=True)
    assert [r.s for r in out.orderBy("k", "v").collect()] == [1500, 1300, 900, 900, 800, 500]


@pytest.mark.parametrize("reverse", [False, True])
def test_prefix_sum_over_blocks(spark, reverse):
    v = np.random.default_rng(1).integers(-9, 9, 100)
    df = from_columns(spark, {"i": list(range(100)), "v": v.tolist()})
    want = v[::-1].cumsum()[::-1] if reverse else v.cumsum()
    assert [r.s for r in A.prefix_sum(df, "i", "v", "s", 7, reverse).orderBy("i").collect()] == want.tolist()


def test_windows(halves):
    assert [r.w for r in windows.tumbling(halves, "v", 250, "w").orderBy("v").collect()] == [0, 0, 1, 1, 2, 3]
    assert got(windows.gap_session(halves, ["k"], "v", 200, "w"), "k", "w") == [(3, 200)] * 2 + [(3, 900)] + [(7, 100)] * 3
    out = windows.threshold_session(halves, ["k"], "v", "v", 250, "w", marked=False)
    assert [r.w for r in out.orderBy("v").collect()] == [-1, -1, 300, 400, 300, 400]
    assert windows.threshold_session(halves, ["k"], "v", "v", 250, "w").count() == 4


def test_gap_opens_only_beyond(spark):
    df = from_columns(spark, {"k": [5, 5, 5, 6, 6], "t": [20, 45, 71, 20, 46]})
    assert [r.s for r in windows.gap_session(df, ["k"], "t", 25, "s").orderBy("k", "t").collect()] == [20, 20, 71, 20, 46]


def test_rows_at_one_time_have_an_order(spark):
    df = from_columns(spark, {"k": [1] * 4, "t": [10, 10, 20, 20], "v": [50, 5, 60, 6]})
    for rows in (df, df.orderBy("v"), df.orderBy(F.desc("v"))):
        out = windows.threshold_session(rows, ["k"], "v", "t", 9, "s", marked=False)
        assert got(out, "t", "v", "s") == [(10, 5, -1), (10, 50, 10), (20, 6, -1), (20, 60, 20)]


def test_integer_division(spark):
    df = from_columns(spark, {"a": [7, -7, 5], "b": [2, 2, 0]})
    assert [tuple(r) for r in df.select(S.idiv(F.col("a"), F.col("b")), S.remainder(F.col("a"), F.col("b")), S.idiv(F.col("a"), 3)).collect()] == [(3, 1, 2), (-3, -1, -2), (None, None, 1)]


def test_most_common(spark):
    votes = from_columns(spark, {"v": [12] * 4 + [9] * 5 + [2] * 5 + [0] * 3 + [40] * 6})
    assert A.most_common(votes, "v").first().value == 40
    assert A.most_common(votes, "v", 13).first().value == 9  # as often as 2, and larger
    assert A.most_common(votes, "v", 1000).first().value == 40


@pytest.fixture()
def shop(spark):
    """Customers (one of them, 50, without a sale) and sales (one by 80, who is no customer)."""
    customers = from_columns(spark, {"who": [20, 30, 50], "town": [1, 2, 3]})
    return customers, from_columns(spark, {"who": [20, 30, 20, 80, 30, 20], "paid": [5, 7, 6, 9, 8, 4]})


def test_inner_join_copies_and_counts(shop):
    customers, sales = shop
    assert got(J.inner_join(customers, sales, ["who"], ["town"]), "paid", "town") == [(4, 1), (5, 1), (6, 1), (7, 2), (8, 2)]
    assert got(J.inner_join(customers, sales, ["who"], ["town"], [("paid", "n", "count"), ("paid", "total", "sum")])) == [(20, 1, 3, 15), (30, 2, 2, 15)]
    assert got(J.inner_join(customers.filter("town <> 1"), sales.filter("paid < 8"), ["who"]), "paid") == [(7,)]


def test_join_on_two_keys(spark):
    prices = from_columns(spark, {"part": [1, 1, 2], "shop": [8, 9, 8]})
    orders = from_columns(spark, {"part": [1, 2, 1, 1, 2], "shop": [9, 8, 9, 8, 9]})
    assert got(J.inner_join(prices, orders, ["part", "shop"], specs=[("part", "n", "count")])) == [(1, 8, 1), (1, 9, 2), (2, 8, 1)]


def test_outer_joins(shop):
    customers, sales = shop
    assert got(J.left_outer_join(customers, sales, ["who"], ["town"]), "who", "town", "paid") == [(20, 1, 4), (20, 1, 5), (20, 1, 6), (30, 2, 7), (30, 2, 8), (50, 3, 0)]
    assert got(J.right_outer_join(customers, sales, ["who"], ["town"]), "paid", "town") == [(4, 1), (5, 1), (6, 1), (7, 2), (8, 2), (9, 0)]
    assert J.full_outer_union(customers, sales, ["who"], ["town"]).count() == customers.count() + sales.count()
    assert got(J.full_outer_join(customers, sales, ["who"]), "who", "town", "paid")[-2:] == [(50, 3, 0), (80, 0, 9)]


def test_outer_joins_keep_the_nulls_of_matched_rows(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k long, a long")
    right = spark.createDataFrame([(1, None), (2, 8), (4, 9)], "k long, b long")
    rows = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()), key=repr)
    assert rows(J.left_outer_join(left, right, ["k"], ["a"])) == [(1, 5, None), (2, None, 8), (3, 7, 0)]
    assert rows(J.right_outer_join(left, right, ["k"], ["a"])) == [(1, 5, None), (2, None, 8), (4, 0, 9)]
    assert rows(J.full_outer_join(left, right, ["k"])) == [(1, 5, None), (2, None, 8), (3, 7, 0), (4, 0, 9)]
    assert rows(J.full_outer_union(left, right, ["k"], ["a"])) == [(1, 5, 0), (1, 5, None), (2, None, 0), (2, None, 8), (3, 7, 0), (4, 0, 9)]


def test_a_join_without_keys_needs_one_row(spark):
    rows = from_columns(spark, {"x": [1, 2]})
    assert got(J.inner_join(from_columns(spark, {"mean": [9]}), rows, [], ["mean"])) == [(1, 9), (2, 9)]
    with pytest.raises(Exception, match="one row"):
        J.inner_join(from_columns(spark, {"mean": [9, 9]}), rows, [], ["mean"]).collect()


def test_semi_and_anti(shop):
    customers, sales = shop
    assert got(J.semi_join(sales, customers, ["who"]), "paid") == [(4,), (5,), (6,), (7,), (8,)]
    assert got(J.anti_join(sales, customers, ["who"]), "paid") == [(9,)]
    assert got(J.anti_join(customers, sales, ["who"]), "who") == [(50,)]


def test_unique_join(spark):
    doors, keys = from_columns(spark, {"k": list(range(0, 40, 3))}), from_columns(spark, {"k": list(range(0, 40, 4)), "metal": list(range(10))})
    assert got(J.unique_join(doors, keys, ["k"], check=True)) == [(0, 0), (12, 3), (24, 6), (36, 9)]
    with pytest.raises(ValueError, match="not unique"):
        J.unique_join(doors, keys.union(keys), ["k"], check=True)


def test_first_per_key_makes_a_key_side(spark):
    df = from_columns(spark, {"k": [1, 1, 2], "o": [5, 3, 9], "x": [10, 20, 30]})
    assert got(J.first_per_key(df, ["k"], ["o"]), "k", "o", "x") == [(1, 3, 20), (2, 9, 30)]


def test_table_chain(spark):
    df = random_table(spark, {"a": (0, 100), "b": (0, 5)}, 200, 1)
    t = R.Table(df).sort([("a", True), ("b", False)])
    assert t.head(5).df.count() == t.tail(5).df.count() == t.cut(10, 15).df.count() == 5
    assert R.Table(df).add_columns(["z"]).rename("a", "c").delete_columns(["b"]).df.columns == ["c", "z"]
    with pytest.raises(KeyError):
        R.Table(df)["nothing"]
    with pytest.raises(KeyError):
        R.Table(df).rename("nothing", "x")


def test_deep_cuts_are_made_on_numbered_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "GATHER", 50)
    r = np.random.default_rng(6)
    values = r.permutation(1000).tolist()
    df = from_columns(spark, {"a": [v // 10 for v in values], "b": values}).repartition(5)
    order = [("a", False), ("b", True)]
    want = sorted(values, key=lambda v: (-(v // 10), v))
    assert [x.b for x in R.cut(df, order, 700, 720).collect()] == want[700:720]
    assert [x.b for x in R.head(df, order, 300).collect()] == want[:300]
    assert [x.b for x in R.tail(df, order, 300).collect()] == want[-300:]


def test_distinct_takes_the_first_in_order(spark):
    df = from_columns(spark, {"k": [1, 1, 2], "o": [5, 3, 9], "x": [10, 20, 30]})
    assert got(R.distinct(df, ["k"], ["o"])) == [(1, 3, 20), (2, 9, 30)]


def test_permutations(spark):
    r = np.random.default_rng(7)
    p, q, values = r.permutation(30), r.permutation(30), r.integers(0, 99, 30)
    table = lambda x, name: from_columns(spark, {"place": list(range(30)), name: x.tolist()})
    rows = table(values, "v")
    moved = np.empty(30, int)
    moved[p] = values
    assert [x.v for x in O.apply_permutation(rows, table(p, "target")).orderBy("place").collect()] == moved.tolist()
    back = O.apply_permutation(O.apply_permutation(rows, table(p, "target")), O.invert(table(p, "target")))
    assert got(back) == got(rows)
    both = O.compose(table(p, "target"), table(q, "target"))
    one_by_one = O.apply_permutation(O.apply_permutation(rows, table(p, "target")), table(q, "target"))
    assert got(O.apply_permutation(rows, both)) == got(one_by_one)


def test_concatenate_fills_with_zero(spark):
    a, b = from_columns(spark, {"x": [1], "y": [2]}), from_columns(spark, {"x": [3], "z": [4]})
    assert got(R.concatenate(a, b, "side"), "x", "y", "z", "side") == [(1, 2, 0, 0), (3, 0, 4, 1)]


def test_csv_round_trip_and_strict_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,region,age\n1,2,30\n2,1,41\n")
    df = read_csv(spark, f"file://{tmp_path}/e.csv", "age long, id long, region long")
    assert got(df) == [(30, 1, 2), (41, 2, 1)]
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, f"file://{tmp_path}/e.csv", "id long, age long")


def test_columns_masks_and_zeros(spark, tmp_path):
    write_column(from_columns(spark, {"a": [5, 6]}), "a", f"file://{tmp_path}/c")
    assert got(read_column(spark, f"file://{tmp_path}/c", "a")) == [(5,), (6,)]
    assert got(zero_table(spark, ["a"], 2)) == [(0,), (0,)]
    assert got(masked(from_columns(spark, {"a": [5, 6], "ok": [1, 0]}), "ok", fill=99)) == [(5,), (99,)]
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [1], "b": [1, 2]})


def test_fixed_point_product(spark):
    df = spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") / 11).alias("y"))
    out = df.select("x", "y", S.fixed_mul(S.fixed(F.col("x")), S.fixed(F.col("y"))).alias("z")).toPandas()
    assert (abs(out.z / 65536 - out.x * out.y) < 300 / 65536).all()


def test_wrap_and_bits(spark):
    df = from_columns(spark, {"a": [127, 128, 255, -129]})
    assert [r[0] for r in df.select(S.wrap(F.col("a"), 8)).collect()] == [127, -128, -1, 127]
    assert [r[0] for r in df.select(S.extend_low_bit(F.col("a"))).collect()] == [-1, 0, -1, -1]


def test_custom_reducer(spark):
    df = from_columns(spark, {"k": [1, 1, 2], "v": [6, 3, 4]})
    assert got(A.custom(df, ["k"], "v", "x", np.bitwise_xor.reduce)) == [(1, 5), (2, 4)]


def conv_by_hand(x, f, stride, pad):
    x = np.pad(x, ((pad, pad), (pad, pad), (0, 0)))
    n, m = (x.shape[0] - f.shape[0]) // stride + 1, (x.shape[1] - f.shape[1]) // stride + 1
    out = np.zeros((n, m, f.shape[3]), x.dtype)
    for i in range(n):
        for j in range(m):
            for o in range(f.shape[3]):
                out[i, j, o] = (x[i * stride : i * stride + f.shape[0], j * stride : j * stride + f.shape[1]] * f[..., o]).sum()
    return out


def forward_by_hand(model, x):
    """One image through a model, layer by layer in loops."""
    for layer in model.layers:
        if isinstance(layer, I.Conv2D):
            x = conv_by_hand(x, layer.filters, layer.stride, layer.pad)
        elif isinstance(layer, I.AvgPool):
            n, m = ((size - layer.size) // layer.stride + 1 for size in x.shape[:2])
            s = layer.stride
            x = np.stack([np.stack([x[i * s : i * s + layer.size, j * s : j * s + layer.size].sum(axis=(0, 1)) // layer.size**2 for j in range(m)]) for i in range(n)])
        else:
            x = np.maximum(x, 0) if isinstance(layer, I.ReLU) else x.reshape(-1) @ layer.weights
    return x


@pytest.mark.parametrize("make", [lambda w: I.alexnet(w, 32), lambda w: I.vgg16(w, 64)])
def test_image_models(make):
    r = np.random.default_rng(8)
    model = make(lambda n: r.integers(-2, 3, n))
    x = r.integers(0, 9, (2, 32, 32, 3))
    out = model.forward(x)
    assert out.shape == (2, 10) and (out == np.stack([forward_by_hand(model, y) for y in x])).all()


def test_the_large_model_fits_its_dense_layers():
    model = I.vgg16(lambda n: np.ones(n, np.int8), 64, 224)
    assert [x.weights.shape for x in model.layers if isinstance(x, I.FullyConnected)] == [(72, 64), (64, 64), (64, 1000)]
    assert I.vgg16(lambda n: np.ones(n, np.int8), 1, 32).layers[-6].weights.shape == (512, 256)


def test_the_query_runs_the_large_model_at_all_its_widths(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(I, "apply_model", lambda df, keys, column, model, *how: seen.append(model))
    plans.queries()["vgg16_forward"](spark, "/root/testdata/sf0.001")
    model = seen[0]
    assert [x.filters.shape[3] for x in model.layers if isinstance(x, I.Conv2D)] == [w for block in I.VGG16 for w in block]
    assert [x.weights.shape for x in model.layers if isinstance(x, I.FullyConnected)] == [(512, 256), (256, 256), (256, 10)]
    x = np.random.default_rng(3).integers(-40_000, 40_000, (2, 32, 32, 3))
    out = model.forward(x)
    for layer in model.layers:  # the same tap by tap
        if isinstance(layer, I.Conv2D):
            x = np.stack([_conv_by_taps(y, layer.filters) for y in x])
        elif isinstance(layer, I.FullyConnected):
            x = x.reshape(len(x), -1).astype(float) @ layer.weights.astype(float)
            assert np.abs(x).max() < 2**53
            x = x.astype(np.int64)
        else:
            x = layer(x)
    assert (out == x).all() and len(np.unique(out)) > 2


def _conv_by_taps(x, f):
    """3 x 3 with a margin of one, tap by tap; sums stay where floating point is exact."""
    x = np.pad(x, ((1, 1), (1, 1), (0, 0))).astype(float)
    n, m = x.shape[0] - 2, x.shape[1] - 2
    out = sum(x[i : i + n, j : j + m] @ f[i, j].astype(float) for i in range(3) for j in range(3))
    assert np.abs(out).max() < 2**50
    return out.astype(np.int64)


@pytest.mark.parametrize("high", [1 << 20, 1 << 52, 1 << 56])
def test_products_of_whole_numbers_are_exact(high):
    r = np.random.default_rng(4)
    x, w = r.integers(-high, high, (20, 30)), r.integers(-2, 3, (30, 4)).astype(np.int8)
    assert (I.exact_product(x, w) == np.array(x.astype(object) @ w.astype(object))).all()


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        I.exact_product(np.full((1, 30), 1 << 59), np.full((30, 1), 2, np.int8))


@pytest.mark.parametrize(("stride", "pad"), [(1, 0), (1, 1), (2, 1)])
def test_layers(stride, pad):
    r = np.random.default_rng(2)
    x, f = r.integers(-5, 5, (3, 7, 7, 2)), r.integers(-3, 3, (3, 3, 2, 4))
    assert (I.Conv2D(f, stride=stride, pad=pad)(x) == np.stack([conv_by_hand(y, f, stride, pad) for y in x])).all()
    pool = I.AvgPool(2, 2, total=True)(x)
    assert (pool[0, 0, 0] == x[0, :2, :2].sum(axis=(0, 1))).all()
    assert (I.AvgPool(2, 2)(x) == pool // 4).all()
    assert (I.ReLU()(x) >= 0).all()


def test_model_over_a_table(spark):
    from tidemark.plans.inference import small_model

    x = np.random.default_rng(3).integers(-9, 9, (5, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    out = I.apply_model(df, ["id"], "v", small_model(), (8, 8, 1), "y", "long").orderBy("id").collect()
    conv, _, pool, _, dense = small_model().layers
    for row, image in zip(out, x):
        y = np.maximum(conv_by_hand(image.reshape(8, 8, 1), conv.filters, 1, 1), 0)
        y = np.maximum(np.stack([[y[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].sum(axis=(0, 1)) // 4 for j in range(4)] for i in range(4)]), 0)
        assert row.y == (y.reshape(-1) @ dense.weights).tolist()
    assert I.apply_model(df.limit(0), ["id"], "v", small_model(), (8, 8, 1), "y", "long").count() == 0


def test_matmul(spark):
    a, b = np.arange(6).reshape(2, 3), np.arange(12).reshape(3, 4)
    rows = lambda m: spark.createDataFrame([(i, j, int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v long")
    out = np.zeros((2, 4), int)
    for r in I.matmul(rows(a), rows(b)).collect():
        out[r.i, r.j] = r.v
    assert (out == a @ b).all()


def test_weights_round_trip(spark, tmp_path):
    w = np.array([[0.5, -1.25], [3.0, 0.0]])
    (tmp_path / "w.bin").write_bytes(encode_weights(w))
    assert (read_weights(spark, f"file://{tmp_path}/w.bin", (2, 2)) == w).all()


def test_a_model_sees_few_rows_at_a_time(spark):
    """A layer that counts the rows it gets."""
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "array(1L) as v")
    out = I.apply_model(df, ["id"], "v", I.Model([partial(np.add.accumulate, axis=0)]), (1,), "y", "long").collect()
    assert len({r.id for r in out}) == len(out) == 1000 and max(r.y[0] for r in out) == I.BLOCK


def test_an_equi_join_of_one_file_runs_in_many_tasks(spark):
    left, right = spark.range(0, 1000, 1, 1).selectExpr("id % 3 as k", "id as a"), spark.range(0, 30, 1, 1).selectExpr("id % 3 as k", "id as b")
    out = J.equi_join(left, right, "k")
    assert out.count() == 10_000 and out.selectExpr("spark_partition_id() as p").distinct().count() >= spark.sparkContext.defaultParallelism


def test_a_large_join_by_keys_has_tasks_for_its_rows(spark):
    df = spark.range(1000).select((F.col("id") % 300).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("b"), "id")
    parts = J.dealt(df, ["a", "b"], rows=20)
    assert parts.rdd.getNumPartitions() == 50 and got(parts, "id") == got(df, "id") and J.dealt(df.limit(0), ["a"]).count() == 0
    where = parts.withColumn("at", F.spark_partition_id()).groupBy("a", "b").agg(F.count_distinct("at").alias("n"))
    assert where.filter("n > 1").isEmpty()
    plan = relational.QUERIES["join_composite_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
