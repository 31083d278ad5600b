"""Edges between symbols, folded by keys before they meet what declares them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depweave.operators import edges as E

from .conftest import rows
from .test_pairs import shuffled


@pytest.mark.parametrize("kinds", ["several", "shared", "own"])
def test_symbol_edges_of_any_keys(spark, monkeypatch, kinds):
    """Keys with several symbols, several keys with one symbol, and a symbol for each key."""
    rng = random.Random(2)
    name = {"several": lambda k, d, o: f"s{k}{rng.randrange(3)}", "shared": lambda k, d, o: f"s{ord(k) % 2}", "own": lambda k, d, o: f"s{k}"}[kinds]
    declared = []
    for o in range(40):
        k, d = rng.choice("abcdef"), rng.choice("xyz")
        declared.append((k, name(k, d, o), d, o))
    seen = [(rng.choice([*"abcdefg", None]), rng.choice("xyzw"), rng.choice([*"abcdefg", None]), rng.choice(["call", "Call ", None]), rng.choice(["low", None]), i, rng.choice(["f", "g", None]), rng.choice([0, 3]), rng.choice(["t", None])) for i in range(600)]
    first, here = {}, {}
    for k, s, d, o in declared:
        first.setdefault(k, s)
        here.setdefault((k, d), s)
    want, sample = Counter(), {}
    for s, d, t, kind, conf, i, file, line, text in seen:
        a, b = here.get((s, d), first.get(s)), first.get(t)
        if a is None or b is None or a == b:
            continue
        key = a, b, (kind or "reference").strip().lower(), conf or "high"
        want[key] += 1
        if (file, line or None, text) != (None, None, None):
            sample.setdefault(key, (file, line or None, text))
    obs = spark.createDataFrame(seen, "source_symbol_key string, source_document_id string, target_symbol_key string, reference_kind string, confidence string, ordinal long, file string, line int, snippet string")
    decl = spark.createDataFrame(declared, "symbol_key string, symbol_id string, document_id string, ordinal long")
    expected = sorted(((*k, n, *sample.get(k, (None, None, None))) for k, n in want.items()), key=repr)
    for most in (E.BROADCAST_KEYS, 0):
        monkeypatch.setattr(E, "BROADCAST_KEYS", most)
        assert rows(E.symbol_edges(obs, decl)) == expected


def test_observations_are_dealt_twice(spark):
    n = 100_000
    text = lambda x: F.sha2(x.cast("string"), 256)
    obs = spark.range(n).select(F.concat(F.lit("o"), F.col("id") % 1000).alias("source_symbol_key"), F.lit("d").alias("source_document_id"), F.concat(F.lit("p"), F.floor(F.col("id") / 1000)).alias("target_symbol_key"), F.lit("call").alias("reference_kind"), F.lit("low").alias("confidence"), F.col("id").alias("ordinal"), F.lit("f").alias("file"), F.lit(1).alias("line"), text(F.col("id")).alias("snippet"))
    keys = obs.select(F.col("source_symbol_key").alias("symbol_key")).union(obs.select("target_symbol_key")).distinct()
    decl = keys.select("symbol_key", F.concat(F.lit("s"), "symbol_key").alias("symbol_id"), F.lit("d").alias("document_id"), F.lit(1).alias("ordinal"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.symbol_edges(obs, decl)
        got = shuffled(spark, found)
        assert found.count() == n and got < 2.5 * 75 * n, got / n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
