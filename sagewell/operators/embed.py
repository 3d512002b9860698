"""Embedders by name, the hash embedder, and keeping a table of embeddings in step with its files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the hash embedder.
BUCKETS = 256
#: 64-bit FNV-1a offset basis and prime, reduced modulo 256 (fixed values).
FNV_OFFSET, FNV_PRIME = 0x25, 0xB3

Embedder = Callable[[list[str]], np.ndarray]


def fnv_bucket(token: bytes) -> int:
    """64-bit FNV-1a modulo 256: the low byte follows from low bytes alone."""
    h = FNV_OFFSET
    for b in token:
        h = (h ^ b) * FNV_PRIME & 0xFF
    return h


def hash_embedder() -> Embedder:
    """Counts of white-space tokens by hash bucket, brought to unit length."""
    memo: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS))
        if len(memo) > 200_000:
            memo.clear()
        for i, t in enumerate(texts):
            for w in t.split():
                if w not in memo:
                    memo[w] = fnv_bucket(w.encode())
                out[i, memo[w]] += 1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def pooled_embedder(tokenize: Callable[[str], list[int]], token_model: Callable[[np.ndarray, np.ndarray], np.ndarray], max_tokens: int = 256, micro_batch: int = 32) -> Callable[[], Embedder]:
    """A factory of embedders around a model of tokens: texts are cut to max_tokens, put together with others of
    about their length in batches of micro_batch, and the vectors of their tokens are averaged and normalised.

    tokenize(text) gives token numbers; token_model(ids, mask) takes matrices of texts x places and gives vectors
    for every place, of which those outside the mask don't count. A text without tokens has the zero vector.
    """

    def factory() -> Embedder:
        def embed(texts: list[str]) -> np.ndarray:
            ids = [tokenize(t)[:max_tokens] for t in texts]
            order, out = sorted(range(len(ids)), key=lambda i: len(ids[i])), None
            for at in range(0, len(order), micro_batch):
                some = order[at : at + micro_batch]
                size = np.array([len(ids[i]) for i in some])
                mask = np.arange(max(1, size.max())) < size[:, None]
                padded = np.zeros(mask.shape, np.int64)
                padded[mask] = [x for i in some for x in ids[i]]
                total = (np.asarray(token_model(padded, mask), float) * mask[:, :, None]).sum(1)
                mean = total / np.maximum(size, 1)[:, None]
                out = np.zeros((len(texts), mean.shape[1])) if out is None else out
                length = np.linalg.norm(mean, axis=1, keepdims=True)
                out[some] = np.divide(mean, length, out=np.zeros_like(mean), where=length > 0)
            return np.zeros((0, 0)) if out is None else out

        return embed

    return factory


_factories: dict[str, Callable[[], Embedder]] = {"hash": hash_embedder}


def register_embedder(name: str, factory: Callable[[], Embedder]) -> None:
    """factory() is called once per task and gives a function of a list of texts to a matrix."""
    _factories[name] = factory


#: Names that settings of old have for embedders (fixed values).
OLD_NAMES = {"all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2"}


def embedder_name(name: str) -> str:
    return OLD_NAMES.get(name, name)


def known_embedder(name: str) -> bool:
    return embedder_name(name) in _factories


def embed_texts(df: DataFrame, text: str, embedder: str = "hash", out: str = "embedding", batch: int = 256) -> DataFrame:
    """Adds an embedding column; batches of texts pass through the embedder. Null texts are empty."""
    if embedder not in _factories:
        raise ValueError(f"no embedder {embedder!r}; known: {', '.join(sorted(_factories))}")
    factory, names, at = _factories[embedder], df.columns, df.columns.index(text)

    def work(batches):
        embed = factory()
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                m = embed([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))], names=[*names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(work, f"{schema}, `{out}` array<float>")


def content_hash(text):
    return F.xxhash64(text)


def sync_plan(store: DataFrame, files: DataFrame) -> DataFrame:
    """What a sync has to do: file, action keep | embed | drop. store: file, hash; files: file, content."""
    now = files.select("file", content_hash(F.col("content")).alias("new_hash"))
    both = store.select("file", F.col("hash").alias("old_hash")).join(now, "file", "full_outer")
    action = F.when(F.col("new_hash").isNull(), "drop").when(F.col("old_hash") == F.col("new_hash"), "keep").otherwise("embed")
    return both.select("file", action.alias("action"))


def sync(store: DataFrame, files: DataFrame, embedder: str = "hash") -> DataFrame:
    """The store brought up to date: vanished files go, only new or changed ones are embedded again."""
    now = files.select("file", "content", content_hash(F.col("content")).alias("hash"))
    kept = store.join(now.select("file", "hash"), ["file", "hash"], "left_semi").select("file", "hash", "embedding")
    new = embed_texts(now.join(kept.select("file"), "file", "left_anti"), "content", embedder)
    return kept.unionByName(new.select("file", "hash", "embedding"))


def upsert(store: DataFrame, rows: DataFrame, key: str = "file") -> DataFrame:
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(store: DataFrame, keys: DataFrame, key: str = "file") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")
