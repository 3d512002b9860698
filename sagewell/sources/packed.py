"""Packed store and index files as a Spark data source, for reading and writing.

    spark.dataSource.register(PackedVectors)
    spark.read.format("packed_vectors").option("kind", "store").load(path)
    rows.write.format("packed_vectors").option("kind", "store").mode("append").save(path)

Kinds are `store` (embeddings of files), `cells` (an inverted file), `graph` (a layered graph) and `codes` (quantised
vectors). Files are found by pyarrow, so that the path may be in any store that it knows and all executors reach. Each
file is a partition, as its entries can only be found one after the other; each task that writes makes a file of its
own, which is moved to its place when all tasks are done, so that a job that breaks off leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import binary

SCHEMAS = {
    "store": "file string, hash bigint, embedding array<float>",
    "cells": "id string, cell int, embedding array<float>, header string",
    "graph": "id string, node int, level int, embedding array<float>, links array<array<int>>, header string",
    "codes": "file string, hash bigint, norm float, packed binary, residual_norm float, signs binary, header string",
}


def _found(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def entries(kind: str, blob: bytes) -> Iterator[tuple]:
    """Rows of a file's bytes. The centroids of cells are rows without an id."""
    if kind == "store":
        for file, h, v in binary.parse_store(blob):
            yield file, h, v.tolist()
    elif kind == "cells":
        params, centroids, rows = binary.parse_cells(blob)
        header = json.dumps(params)
        for cell, c in enumerate(centroids):
            yield None, cell, c.tolist(), header
        for name, cell, v in rows:
            yield name, cell, v.tolist(), header
    elif kind == "graph":
        params, nodes = binary.parse_graph(blob)
        header = json.dumps(params)
        for node, (name, level, v, links) in enumerate(nodes):
            yield name, node, level, v.tolist(), links, header
    else:
        params, found = binary.parse_compressed(blob)
        header = json.dumps(params)
        for e in found:
            yield e["file"], e["hash"], e["norm"], bytes(e["packed"]), e.get("residual_norm"), bytes(e["signs"]) if "signs" in e else None, header


def packed(kind: str, rows: list) -> bytes:
    """A file's bytes from rows of its schema; headers are those of the first row."""
    if kind == "store":
        if len({len(r["embedding"]) for r in rows}) != 1:
            raise ValueError("vectors of one length make a store")
        return binary.store_bytes([(r["file"], r["hash"], r["embedding"]) for r in rows], len(rows[0]["embedding"]))
    params = json.loads(rows[0]["header"])
    if kind == "cells":
        centroids = sorted((r["cell"], r["embedding"]) for r in rows if r["id"] is None)
        if [c for c, _ in centroids] != list(range(len(centroids))) or any(not 0 <= r["cell"] < len(centroids) for r in rows):
            raise ValueError("an index's centroids and rows must be in one partition")
        return binary.cells_bytes(np.array([v for _, v in centroids], np.float32), [(r["id"], r["cell"], r["embedding"]) for r in rows if r["id"] is not None], params["n_probe"], params["iterations"])
    if kind == "graph":
        nodes = sorted(rows, key=lambda r: r["node"])
        if [r["node"] for r in nodes] != list(range(len(nodes))):
            raise ValueError("a graph's nodes must be in one partition")
        return binary.graph_bytes(params, [(r["id"], r["level"], r["embedding"], [list(x) for x in r["links"]]) for r in nodes])
    return binary.compressed_bytes(params, [{c: r[c] for c in ("file", "hash", "norm", "packed", "residual_norm", "signs")} for r in rows])


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[File]:
        store, at = _found(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        return [File(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        with _found(self.path)[0].open_input_file(partition.path) as f:
            yield from entries(self.kind, f.read())


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.beside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        rows = list(iterator)  # a file says first how many entries it has
        if not rows:
            return Written(None)
        store, at = _found(self.path)
        store.create_dir(f"{at}/{self.beside}")
        name = f"part-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{at}/{self.beside}/{name}") as out:
            out.write(packed(self.kind, rows))
        return Written(name)

    def commit(self, messages: list) -> None:
        store, at = _found(self.path)
        store.create_dir(at)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            if m and m.name:
                store.move(f"{at}/{self.beside}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, at = _found(self.path)
        if store.get_file_info(f"{at}/{self.beside}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.beside}")


class PackedVectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_vectors"

    def _kind(self) -> str:
        kind = self.options.get("kind", "store")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._kind())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._kind(), overwrite)
