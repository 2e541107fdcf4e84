"""Mixing where ids are missing or repeated, ranges of keys, and clashing column names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import op02_quality_rules, op06_mixing as mixing
from cohortlens.llm.common import stored

SCHEMA = "doc_id long, text string, source string"


def rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "c1", "d#"], k=rng.randint(1, 9))) for _ in range(40)]
    return [(rng.choice([None, None, 1, 2, i]), texts[i % 40], rng.choice(["x", "x", "x", "y"])) for i in range(200)]


def sized(df):
    return stored(df.select("*", mixing.words().alias("size"), mixing.quality().alias("quality"), mixing.tie().alias("tie")), "test")


def test_the_same_sample_for_any_partitioning(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = []
    for parts in (1, 3, 7):
        got = mixing.sample(sized(df.orderBy(F.rand(parts)).repartition(parts)))
        assert got.where("source = 'x' AND epochs = 1").count() > 0 and got.where("source = 'y' AND epochs > 1").count() > 0
        found.append(Counter((r.doc_id, r.text, r.source, r.epochs) for r in got.collect()))
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == 200
    # Of two sources one gives a part of itself: a fraction is sampled.
    assert len({e for (_, _, s, e) in found[0] if s == "x"}) == 2


def test_sums_meet_the_targets_without_ids(spark):
    df = spark.createDataFrame([(None, t, s) for _, t, s in rows()], SCHEMA)
    got = mixing.sample(sized(df)).collect()
    for source in ("x", "y"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.epochs for r in mine) - mine[0].target) <= max(r.size for r in mine)


@pytest.mark.parametrize("quality", [0.1, 1.0])
def test_ranges_are_even_at_any_quality(spark, monkeypatch, quality):
    df = spark.range(20_000).select("id", F.lit("x").alias("source"), F.lit(1).cast("long").alias("size"), F.lit(quality).alias("quality"))
    sizes = []
    keep = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda d, name: sizes.extend(r.n for r in keep(d, name).collect()) or keep(d, name) if name == "ranges" else keep(d, name))
    got = mixing.sample(df, doc_id="id")
    assert got.count() == 20_000 and len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_columns_of_the_input_stay(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({n: F.lit("mine") for n in ("key", "range", "upto", "before", "s", "r", "key_", "target", "epochs", "source_size")})
    got = mixing.sample(sized(df))
    assert {r["upto"] for r in got.collect()} == {"mine"} and {"key", "range", "before", "s", "r", "key_"} <= set(got.columns)
    assert got.where("cast(target as string) = 'mine'").count() == 0 and len(got.columns) == len(set(got.columns))


def test_quality_votes_keep_equally_named_columns(spark, docs):
    names = {f"vote_{r.name}": F.lit("mine") for r in op02_quality_rules.RULES} | {"p_good": F.lit("mine"), "kept": F.lit("mine")}
    features = op02_quality_rules.with_features(docs.withColumns(names))
    model = op02_quality_rules.fit_label_model(features)
    got = op02_quality_rules.with_verdict(features, model).collect()
    assert all(r[n] == "mine" for r in got for n in names if n.startswith("vote_")) and {type(r.kept) for r in got} == {bool}
