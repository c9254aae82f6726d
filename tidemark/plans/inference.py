"""Matrices and models on embeddings, and a query that mixes inference, joins and sessions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed, flag, idiv
from tidemark.operators import inference as I
from tidemark.operators.joins import dealt
from tidemark.plans.base import Group, happenings
from tidemark.sources.tables import Tables
from tidemark.streaming import windows

G = Group()
c = F.col

#: Rows of a task of a large model: some ten seconds of work.
MODEL_ROWS = 256

_FIXED = "f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 65536) AS BIGINT)) AS v FROM embeddings)"


def _vectors(t: Tables) -> DataFrame:
    """Embeddings in fixed point, so that sums don't depend on their order."""
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: fixed(x.cast("double"))).alias("v"))


def _weight(i: int, j: int) -> int:
    """The queries' weights: small whole numbers by rule."""
    return (3 * i + 5 * j) % 7 - 3


def _dense(outputs: int, inputs: int = 64) -> np.ndarray:
    return np.array([[_weight(i, j) for j in range(outputs)] for i in range(inputs)], np.int64)


@G.add(f"WITH {_FIXED} SELECT vec_id AS i, j, CAST(list_sum(list_transform(range(64), lambda k: v[k + 1] * ((3 * k + 5 * j) % 7 - 3))) AS BIGINT) AS v FROM f, range(4) AS u(j)")
def matmul(t: Tables) -> DataFrame:
    a = _vectors(t).select(c("vec_id").alias("i"), F.posexplode("v").alias("j", "v")).withColumn("j", c("j").cast("long"))
    b = t.spark.createDataFrame([(i, j, _weight(i, j)) for i in range(64) for j in range(4)], "i long, j long, v long")
    return I.matmul(a, b)


@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(v, lambda x: greatest(x, 0)) AS y FROM f")
def relu(t: Tables) -> DataFrame:
    return _vectors(t).select("vec_id", F.transform("v", lambda x: F.greatest(x, F.lit(0).cast("long"))).alias("y"))


@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(range(3), lambda j: CAST(list_sum(list_transform(range(64), lambda k: v[k + 1] * ((3 * k + 5 * j) % 7 - 3))) AS BIGINT) + j) AS y FROM f")
def fully_connected(t: Tables) -> DataFrame:
    return I.apply_model(_vectors(t), ["vec_id"], "v", I.Model([I.FullyConnected(_dense(3), np.arange(3))]), (64,), "y", "long")



@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(range(16), lambda p: CAST(floor((v[(p // 4) * 16 + (p % 4) * 2 + 1] + v[(p // 4) * 16 + (p % 4) * 2 + 2] + v[(p // 4) * 16 + (p % 4) * 2 + 9] + v[(p // 4) * 16 + (p % 4) * 2 + 10]) / 4) AS BIGINT)) AS y FROM f")
def avg_pool(t: Tables) -> DataFrame:
    return I.apply_model(_vectors(t), ["vec_id"], "v", I.Model([I.AvgPool(2, 2)]), (8, 8, 1), "y", "long")


@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(range(36), lambda p: CAST(list_sum(list_transform(range(9), lambda k: v[(p // 6 + k // 3) * 8 + p % 6 + k % 3 + 1] * (k - 4))) AS BIGINT)) AS y FROM f")
def conv2d(t: Tables) -> DataFrame:
    filters = (np.arange(9, dtype=np.int64) - 4).reshape(3, 3, 1, 1)
    return I.apply_model(_vectors(t), ["vec_id"], "v", I.Model([I.Conv2D(filters)]), (8, 8, 1), "y", "long")


def small_model() -> I.Model:
    """Convolution, ReLU, pooling, ReLU, fully connected: three classes of an 8 x 8 image."""
    filters = (np.arange(18, dtype=np.int64) % 5 - 2).reshape(3, 3, 1, 2)
    return I.Model([I.Conv2D(filters, pad=1), I.ReLU(), I.AvgPool(2, 2), I.ReLU(), I.FullyConnected(_dense(3, 32))])


@G.add(f"""WITH {_FIXED},
a AS (SELECT vec_id, list_transform(range(128), lambda q: greatest(CAST(list_sum(list_transform(range(9), lambda k: CASE WHEN q // 16 + k // 3 BETWEEN 1 AND 8 AND (q // 2) % 8 + k % 3 BETWEEN 1 AND 8 THEN v[(q // 16 + k // 3 - 1) * 8 + (q // 2) % 8 + k % 3] * ((k * 2 + q % 2) % 5 - 2) ELSE 0 END)) AS BIGINT), 0)) AS x FROM f),
b AS (SELECT vec_id, list_transform(range(32), lambda q: CAST(floor((x[(q // 8) * 32 + (q // 2) % 4 * 4 + q % 2 + 1] + x[(q // 8) * 32 + (q // 2) % 4 * 4 + q % 2 + 3] + x[(q // 8) * 32 + (q // 2) % 4 * 4 + q % 2 + 17] + x[(q // 8) * 32 + (q // 2) % 4 * 4 + q % 2 + 19]) / 4) AS BIGINT)) AS x FROM a)
SELECT vec_id, list_transform(range(3), lambda j: CAST(list_sum(list_transform(range(32), lambda i: x[i + 1] * ((3 * i + 5 * j) % 7 - 3))) AS BIGINT)) AS y FROM b""")
def model_forward(t: Tables) -> DataFrame:
    return I.apply_model(_vectors(t), ["vec_id"], "v", small_model(), (8, 8, 1), "y", "long")


@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(range(16), lambda p: v[(p // 4) * 16 + (p % 4) * 2 + 1] + v[(p // 4) * 16 + (p % 4) * 2 + 2] + v[(p // 4) * 16 + (p % 4) * 2 + 9] + v[(p // 4) * 16 + (p % 4) * 2 + 10]) AS y FROM f")
def sum_pool(t: Tables) -> DataFrame:
    return I.apply_model(_vectors(t), ["vec_id"], "v", I.Model([I.AvgPool(2, 2, total=True)]), (8, 8, 1), "y", "long")


@G.add(f"WITH {_FIXED} SELECT vec_id, list_transform(range(64), lambda i: v[(i % 16) * 4 + i // 16 + 1]) AS planes, v AS back FROM f")
def channels(t: Tables) -> DataFrame:
    """A 16-pixel image of four channels, channel by channel, and back."""
    planes = _vectors(t).select("vec_id", I.separate_channels(c("v"), 4).alias("planes"))
    return planes.select("vec_id", "planes", I.interleave_channels(c("planes"), 4).alias("back"))


@G.add(f"WITH {_FIXED}, e AS (SELECT vec_id * 64 + j AS at_, v[j + 1] AS v FROM f, range(64) AS u(j)) SELECT at_ // 48 AS i, at_ % 48 AS j, v FROM e")
def matrix_reshape(t: Tables) -> DataFrame:
    rows = _vectors(t).select(c("vec_id").alias("i"), F.posexplode("v").alias("j", "v"))
    return I.reshape(rows.withColumn("j", c("j").cast("long")), 64, 48)


@G.add(f"WITH {_FIXED} SELECT a.vec_id AS i, CAST(j AS BIGINT) AS j, a.v[j + 1] * 3 - (j - a.vec_id) AS v FROM f a, range(64) AS u(j)")
def matrix_elementwise(t: Tables) -> DataFrame:
    """Three times a matrix less another."""
    a = _vectors(t).select(c("vec_id").alias("i"), F.posexplode("v").alias("j", "v")).withColumn("j", c("j").cast("long"))
    return I.elementwise(a, a.select("i", "j", (c("j") - c("i")).alias("v")), lambda x, y: x * 3 - y)


def _rule(seed: int):
    """Small whole weights one after another."""
    at = 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        out = (np.arange(at, at + n, dtype=np.int64) * (seed + 2) + seed) % 5 - 2
        at += n
        return out

    return take


def _images(t: Tables, side: int = 32) -> DataFrame:
    """Embeddings repeated to images of three channels, in small whole numbers."""
    pixel = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8).cast("long"))
    return t.embeddings.select("vec_id", F.flatten(F.array_repeat(pixel, side * side * 3 // 64)).alias("v"))


@G.add()
def alexnet_forward(t: Tables) -> DataFrame:
    """Inner widths by 16. Beyond SQL; a test compares the layers with loops in plain Python."""
    return I.apply_model(_images(t), ["vec_id"], "v", I.alexnet(_rule(1), 16), (32, 32, 3), "y", "long")


@G.add()
def vgg16_forward(t: Tables) -> DataFrame:
    """All widths whole. Images have 16 fraction bits, weights are the rule's numbers by 64. Beyond SQL; a test compares the layers with loops in plain Python."""
    rule = _rule(2)
    model = I.vgg16(lambda n: rule(n).astype(np.int8), bits=6)
    rows = dealt(t.embeddings, [], MODEL_ROWS).select("vec_id", F.transform("embedding", lambda x: fixed(x.cast("double"))).alias("v"))
    images = rows.select("vec_id", F.flatten(F.array_repeat("v", 32 * 32 * 3 // 64)).alias("v"))
    return I.apply_model(images, ["vec_id"], "v", model, (32, 32, 3), "y", "long")


@G.add(f"""WITH {_FIXED}, p AS (SELECT vec_id AS user_id, list_transform(range(3), lambda j: greatest(CAST(list_sum(list_transform(range(64), lambda k: v[k + 1] * ((3 * k + 5 * j) % 7 - 3))) AS BIGINT), 0)) AS y FROM f),
a AS (SELECT *, amount > 10000 AS above, coalesce(lag(amount > 10000) OVER (PARTITION BY user_id ORDER BY t, amount), false) AS before FROM happenings),
s AS (SELECT DISTINCT user_id, max(CASE WHEN above AND NOT before THEN t END) OVER (PARTITION BY user_id ORDER BY t, amount) AS session, above FROM a),
n AS (SELECT user_id, count(*) AS sessions FROM s WHERE above GROUP BY ALL),
j AS (SELECT label, sessions, y FROM n JOIN p USING (user_id) JOIN embeddings ON vec_id = user_id)
SELECT CAST(label AS BIGINT) AS label, count(*) AS patients, CAST(sum(CASE WHEN y[1] > 655360 THEN sessions ELSE 0 END) // greatest(sum(CASE WHEN y[1] > 655360 THEN 1 ELSE 0 END), 1) AS BIGINT) AS first, CAST(sum(CASE WHEN y[2] > 655360 THEN sessions ELSE 0 END) // greatest(sum(CASE WHEN y[2] > 655360 THEN 1 ELSE 0 END), 1) AS BIGINT) AS second,
CAST(sum(CASE WHEN y[3] > 655360 THEN sessions ELSE 0 END) // greatest(sum(CASE WHEN y[3] > 655360 THEN 1 ELSE 0 END), 1) AS BIGINT) AS third FROM j GROUP BY ALL""")
def multiworkload(t: Tables) -> DataFrame:
    """Classes of patients' images, sessions of high readings, and the mean number of sessions for each group and class."""
    model = I.Model([I.FullyConnected(_dense(3)), I.ReLU()])
    told = I.apply_model(_vectors(t), ["vec_id"], "v", model, (64,), "y", "long").withColumnRenamed("vec_id", "user_id")
    runs = windows.threshold_session(happenings(t), ["user_id"], "amount", "t", 10_000, "session").select("user_id", "session").distinct()
    counts = runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
    groups = t.embeddings.select(c("vec_id").alias("user_id"), c("label").cast("long").alias("label"))
    rows = counts.join(told, "user_id").join(groups, "user_id")
    mean = []
    for k, name in enumerate(("first", "second", "third")):
        sure = flag(c("y")[k] > 655_360)
        mean.append(idiv(F.sum(sure * c("sessions")), F.greatest(F.sum(sure), F.lit(1).cast("long"))).alias(name))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("patients"), *mean)


QUERIES, SQL = G.queries, G.sql
