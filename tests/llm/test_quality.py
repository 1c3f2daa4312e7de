"""Quality scores: held-out accuracy, forbidden inputs, the linear-time identity, awkward rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from runtally.llm import factorisation
from tests.llm.cases import awkward, empty, prose

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_inputs(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = factorisation.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    hidden = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    a = sorted((r["doc_id"], r["score"]) for r in factorisation.quality(docs, labels).collect())
    assert a == sorted((r["doc_id"], r["score"]) for r in factorisation.quality(other, hidden).collect())


def test_identity():
    rng = np.random.default_rng(1)
    machine = factorisation.Machine(0.3, rng.standard_normal(factorisation.WIDTH), rng.standard_normal((factorisation.WIDTH, factorisation.FACTORS)) * 0.1)
    ids, x = factorisation.features([prose(1, 30)], [100])
    pairs = sum(machine.factors[a] @ machine.factors[b] * p * q for n, (a, p) in enumerate(zip(ids[0], x[0])) for b, q in list(zip(ids[0], x[0]))[:n])
    assert abs(machine.margins(ids, x)[0] - (0.3 + machine.linear[ids[0]] @ x[0] + pairs)) < 1e-9


def test_awkward(spark):
    df = awkward(spark, "score label quality key")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None), (7, 0), (77, 1)], "doc_id long, quality int")
    rows = factorisation.quality(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = factorisation.quality(df, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    assert factorisation.quality(empty(spark), labels).count() == 0
