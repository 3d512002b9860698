"""Packed files through Spark's data source interface: round trips, several files, and files that are none."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.sources import binary, packed


def source(spark, kind):
    spark.dataSource.register(packed.PackedVectors)
    return spark.read.format("packed_vectors").option("kind", kind)


def write(rows, kind, path, mode="append"):
    rows.write.format("packed_vectors").option("kind", kind).mode(mode).save(str(path))


def same(a, b):
    key = lambda rows: sorted(map(str, rows.collect()))
    return key(a) == key(b)


def rows_of(spark, kind):
    v = lambda i: [float(np.float32(x)) for x in np.sin(np.arange(8) + i)]
    if kind == "store":
        rows = [(f"é{i}.md", (-1) ** i * i * 10**15, v(i)) for i in range(20)]
    elif kind == "cells":
        header = json.dumps({"dim": 8, "n_lists": 3, "n_probe": 2, "iterations": 5})
        rows = [(None, c, v(c), header) for c in range(3)] + [(f"n{i}", i % 3, v(i), header) for i in range(9)]
    elif kind == "graph":
        header = json.dumps({"dim": 8, "m": 4, "m0": 8, "ef_construction": 20, "ef_search": 10, "max_level": 1, "entry": 0, "state": 7})
        rows = [(f"n{i}", i, i % 2, v(i), [[(i + 1) % 6], [0]][: i % 2 + 1], header) for i in range(6)]
    else:
        header = json.dumps({"dim": 8, "bits": 3, "prod": True, "rotation_seed": 42, "sketch_seed": 43})
        rows = [(f"f{i}", i, 1.5, bytes([i, 1]), 0.25, bytes([i]), header) for i in range(5)]
    return spark.createDataFrame(rows, packed.SCHEMAS[kind])


@pytest.mark.parametrize("kind", list(packed.SCHEMAS))
def test_round_trip(spark, tmp_path, kind):
    rows = rows_of(spark, kind).coalesce(1)
    source(spark, kind)
    write(rows, kind, tmp_path / "p")
    back = source(spark, kind).load(str(tmp_path / "p"))
    assert same(rows, back) and back.rdd.getNumPartitions() == 1
    assert [f.suffix for f in (tmp_path / "p").iterdir()] == [".bin"]


def test_tasks_write_files_of_their_own(spark, tmp_path):
    rows = rows_of(spark, "store")
    source(spark, "store")
    write(rows.repartition(4), "store", tmp_path / "p")
    assert same(rows, source(spark, "store").load(str(tmp_path / "p"))) and len(list((tmp_path / "p").iterdir())) > 1
    write(rows.where("hash > 0").coalesce(1), "store", tmp_path / "p", "overwrite")
    assert same(rows.where("hash > 0"), source(spark, "store").load(str(tmp_path / "p")))
    (tmp_path / "one.bin").write_bytes(binary.store_bytes([("a", 1, [1.0])], 1))
    assert source(spark, "store").load(str(tmp_path / "one.bin")).first()["file"] == "a"


def test_faults(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(b"nope")
    for kind in packed.SCHEMAS:
        with pytest.raises(Exception, match="not a"):
            source(spark, kind).load(str(tmp_path / "bad.bin")).collect()
    with pytest.raises(Exception, match="unknown kind"):
        source(spark, "other").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="in one partition"):
        write(rows_of(spark, "graph").where(F.col("node") > 0).coalesce(1), "graph", tmp_path / "g")
    assert not (tmp_path / "g").exists() or not list((tmp_path / "g").glob("*.bin"))
