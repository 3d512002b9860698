"""The recall, learn and consolidate plans, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import age_days, attention_score, calibrate
from ..operators.chunking import paragraph_chunks
from ..operators.embed import embed_texts, embedder_name, known_embedder
from ..operators.knn import exact_topk
from ..functions.tables import pinned
from ..operators.lifecycle import associate_all, containing, decay_candidates, inbox, link, promote
from ..operators.metrics import even_sample, similarity_range, space_statistics
from ..operators.rerank import expand_references, rerank, within_budget
from .config import Config


def recall(queries: DataFrame, memories: DataFrame, memory_vectors: DataFrame, now: str, chunks: DataFrame | None = None, chunk_vectors: DataFrame | None = None, profile: dict | None = None, config: Config | None = None) -> DataFrame:
    """Answers many queries at once.

    queries: id, embedding; memories: file, name, type, description, body, strength, created_at,
    source, refs; vectors: id (file or chunk id), embedding; chunks: chunk_id, file, content. Memory
    hits come before code hits; the first memory hit's vector adds code near to it that wasn't found
    yet. Rows: query_id, rank, file, type, name, description, body, score; references follow their memory.
    """
    cfg, profile = config or Config(), profile or {}
    known = memories.select(F.col("file").alias("id"))
    hits = exact_topk(memory_vectors.join(known, "id", "left_semi"), queries, cfg.get("recall.memory_hits"), "id", "embedding").withColumn("pos", F.col("rank"))
    if chunk_vectors is not None:
        code = exact_topk(chunk_vectors, queries, cfg.get("recall.code_hits"), "id", "embedding").withColumn("pos", F.col("rank") + 1000)
        first = hits.where("rank = 1").select("query_id", "id").join(memory_vectors, "id").select(F.col("query_id").alias("id"), "embedding")
        seeded = exact_topk(chunk_vectors, first, cfg.get("recall.seed_hits"), "id", "embedding").join(code.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("pos", F.col("rank") + 2000)
        hits = hits.unionByName(code).unionByName(seeded)
    signals = memories.select(F.col("file").alias("id"), F.col("strength").cast("double").alias("strength"), age_days(F.col("created_at"), now).alias("age_days"), "source", F.size("refs").alias("ref_count"))
    candidates = hits.drop("rank").withColumnRenamed("score", "cosine").join(signals, "id", "left").withColumn("source_file", F.regexp_replace("id", r":\d+:\d+$", ""))
    ranking = pinned(rerank(candidates, profile.get("similarity_floor", 0.30), profile.get("semantic_confidence", 0.5)))  # read thrice below: embedding and search run once
    told = memories.select(F.col("file").alias("id"), "type", "name", "description", "body", "refs")
    if chunks is not None:
        told = told.unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("code").alias("type"), F.col("chunk_id").alias("name"), F.col("file").alias("description"), F.col("content").alias("body"), F.array().cast("array<string>").alias("refs")))
    full = ranking.join(told, "id").withColumn("size", F.octet_length("body"))
    kept = within_budget(full, "size", cfg.get("recall.budget"), cfg.get("recall.min_results"))
    out = kept.select("query_id", "rank", F.lit(0).alias("hop"), F.col("id").alias("file"), "type", "name", "description", "body", F.col("final_score").alias("score"))
    if cfg.get("recall.expand_refs"):
        hops = expand_references(kept.select("query_id", F.col("id").alias("file"), "refs"), memories, most=cfg.get("recall.max_ref_expansions"), max_bytes=cfg.get("consolidation.max_memory_tokens") * 4)
        placed = hops.join(kept.select("query_id", F.col("id").alias("via"), "rank"), ["query_id", "via"])
        out = out.unionByName(placed.select("query_id", "rank", (F.col("pos") + 1).alias("hop"), F.col("ref").alias("file"), "type", "name", "description", "body", "score"))
    return out


def reflect(index: DataFrame, memories: DataFrame) -> DataFrame:
    """Index rows with their memories' signals; zero strength and zero accesses are left out as unknown."""
    known = memories.select("file", F.when(F.col("strength") > 0, F.col("strength")).alias("strength"), F.when(F.col("access_count") > 0, F.col("access_count")).alias("access_count"), "last_accessed", "source")
    return index.select("title", "file", "summary").join(known, "file", "left")


def recall_text(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Where vectors find nothing: substring hits of each query's text, each scoring 0.5. Queries (id, text)
    are a stated set; one scan of the index serves a block of them."""
    asked = queries.select(F.col("id").alias("query_id"), F.lower("text").alias("asked")).where("asked is not null")
    texts = [r[0] for r in asked.select("asked").distinct().collect()]
    hits = containing(index, texts, ["title", "summary"], "asked").withColumn("score", F.lit(0.5))
    return hits.join(asked, "asked").drop("asked")


def recall_asked(asked: DataFrame, index: DataFrame, memories: DataFrame, memory_vectors: DataFrame | None, now: str, config: Config | None = None, offline: bool = False, **rest) -> tuple[DataFrame, str]:
    """recall() for texts (id, text) with the settings' embedder, or recall_text() where there is none: offline, with
    the provider `none`, without vectors, or where the provider isn't registered. Says which in the second place."""
    cfg = config or Config()
    provider = cfg.get("embedding.provider")
    if offline or provider == "none" or memory_vectors is None or not known_embedder(provider):
        return recall_text(asked, index), "text"
    vectors = embed_texts(asked, "text", embedder_name(provider)).select("id", "embedding")
    return recall(vectors, memories, memory_vectors, now, config=cfg, **rest), "vectors"


def learn(files: DataFrame, now: str, config: Config | None = None, embedder: str = "hash") -> dict[str, DataFrame]:
    """Chunks, their vectors, the space's profile and the inbox of files (file, content)."""
    cfg = config or Config()
    chunks = paragraph_chunks(files, "file", "content", cfg.get("code.max_lines"), cfg.get("code.min_lines"), cfg.get("code.overlap"))
    vectors = embed_texts(chunks.select(F.col("chunk_id").alias("id"), "content"), "content", embedder).select("id", "embedding")
    sample = even_sample(vectors, "id")
    shape = space_statistics(sample.withColumn("label", F.lit(0))).crossJoin(similarity_range(sample))
    profile = shape.select("anisotropy", "similarity_range", *(c.alias(n) for n, c in calibrate(F.col("anisotropy"), F.col("similarity_range")).items()), F.col("n").alias("sample_size"))
    items = chunks.select(F.col("chunk_id").alias("id"), "content", F.lit("learn").alias("source"), attention_score(F.col("content"), F.col("start_line"), F.col("end_line")).alias("attention_score"), F.lit(now).alias("created_at"), F.struct("file", "start_line", "end_line", F.lit("code").alias("kind")).alias("file_source"), F.xxhash64("chunk_id").alias("arrival"))
    return {"chunks": chunks, "vectors": vectors, "profile": profile, "inbox": inbox(items, cfg.get("inbox.capacity"))}


def consolidate(memories: DataFrame, vectors: DataFrame, items: DataFrame, now: str, config: Config | None = None, embedder: str = "hash", dry_run: bool = False) -> dict[str, DataFrame]:
    """The store after one cycle: memories, vectors, a log of what was done, and how many rows were embedded
    and indexed again (rebuilt); nothing is written here.

    Associations use the vectors of the cycle before; decay sees what was just promoted; then the memories
    that are left make the rows of the next index: those promoted in this cycle, or without a vector, are embedded,
    the others keep their vectors. A dry run says what would be
    promoted and what would go, and leaves memories and vectors as they are.
    """
    cfg = config or Config()
    new = promote(items, cfg.get("consolidation.max_memory_tokens") * 4).withColumn("last_accessed", F.lit(None).cast("string"))
    columns = ["file", "name", "type", "description", "body", "strength", "created_at", "last_accessed", "access_count", "source", "refs"]
    merged = memories.select(columns).join(new.select("file"), "file", "left_anti").unionByName(new.select(columns))
    decay = lambda rows: decay_candidates(rows, now, cfg.get("consolidation.decay_days"), cfg.get("consolidation.protected_access_count"))
    promoted = new.select(F.lit("promote").alias("action"), "file")
    if dry_run:
        return {"memories": memories, "vectors": vectors, "log": promoted.union(decay(merged).select(F.lit("decay"), "file")), "rebuilt": promoted.limit(0).select("action", F.lit(0).cast("long").alias("rows"))}
    pairs = associate_all(vectors, cfg.get("consolidation.merge_threshold"), 10, "id", "embedding")
    linked = link(merged, pairs)
    gone = decay(linked)
    left = pinned(linked.join(gone.select("file"), "file", "left_anti"))
    # what was embedded before and wasn't promoted anew stays as it is; only the others are embedded
    same = vectors.join(left.select(F.col("file").alias("id")), "id", "left_semi").join(new.select(F.col("file").alias("id")), "id", "left_anti").select("id", "embedding")
    changed = left.select(F.col("file").alias("id"), "body").join(same.select("id"), "id", "left_anti")
    again = same.unionByName(embed_texts(changed, "body", embedder).select("id", F.col("embedding").cast(dict(vectors.dtypes)["embedding"]).alias("embedding")))
    counted, indexed = changed.agg(F.count("*").alias("rows")), left.agg(F.count("*").alias("rows"))
    log = promoted.union(pairs.select(F.lit("associate"), F.concat_ws(" ", "a", "b"))).union(gone.select(F.lit("decay"), "file"))
    return {"memories": left, "vectors": again, "log": log, "rebuilt": counted.select(F.lit("embed").alias("action"), "rows").union(indexed.select(F.lit("index"), "rows"))}
