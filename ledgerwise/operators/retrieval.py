"""Text chunks, hashed vectors, nearest neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

DIMENSIONS, CHUNK = 256, 800


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHUNK, cut: str = r"\n\s*\n", glue: str = "\n\n") -> DataFrame:
    """id, chunk number, chunk: paragraphs packed in order while they fit in `size` characters; a longer one stands alone."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), cut), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        fits = F.length(acc["open"]) + F.length(p) + len(glue) <= size + len(glue)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(glue), p))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.when((acc["open"] == "") | fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(closed.alias("done"), p.alias("open")))

    packed = F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return docs.select(id_col, F.posexplode(packed).alias("chunk_no", "chunk"))


def ingest(files: DataFrame, kind: str) -> DataFrame:
    """file, text to id ({kind}-{stem}-{i}) and document of each chunk."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return chunks(files, "file").select(F.format_string(f"{kind}-%s-%d", stem, "chunk_no").alias("id"), F.col("chunk").alias("document"))


def context(question: DataFrame, platform: DataFrame, domain: DataFrame, most: tuple[int, int] = (4, 2)) -> DataFrame:
    """query_id and the documents nearest to each question (id, document), of both collections (id, document), as one text."""
    q = sparse_vectors(question, "id", "document")
    found = None
    for order, (docs, k) in enumerate(zip((platform, domain), most)):
        near = nearest_texts(q, sparse_vectors(docs, "id", "document"), k).join(docs, "id").select("query_id", F.struct(F.lit(order).alias("o"), "rank", "document").alias("d"))
        found = near if found is None else found.unionByName(near)
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["document"]), "\n\n").alias("context"))


class Collection:
    """Documents and their vectors in the shared folder; rows are added, counted, and searched."""

    def __init__(self, spark, name: str, folder: str | None = None):
        from ..sources.store import shared_dir

        self.spark, self.path = spark, f"{folder or shared_dir(spark)}/ledgerwise/{name}-{uuid.uuid4().hex if folder is None else 'collection'}"

    def add(self, docs: DataFrame) -> None:
        """Rows of id and document."""
        docs.select("id", "document").write.mode("append").parquet(f"{self.path}/documents")
        sparse_vectors(docs, "id", "document").write.mode("append").parquet(f"{self.path}/vectors")

    def count(self) -> int:
        return self.spark.read.parquet(f"{self.path}/documents").count()

    def query(self, questions: DataFrame, n: int) -> DataFrame:
        """query_id, id, score, rank, document of the min(n, count) documents nearest to each question (id, document); those that share no word score 0."""
        docs = self.spark.read.parquet(f"{self.path}/documents")
        near = nearest_texts(sparse_vectors(questions, "id", "document"), self.spark.read.parquet(f"{self.path}/vectors"), n)
        rest = questions.select(F.col("id").alias("query_id")).join(F.broadcast(docs.orderBy("id").limit(2 * n).select("id"))).join(near.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"))
        return top_k(near.select("query_id", "id", "score").unionByName(rest), "query_id", n).join(docs, "id")


def sparse_vectors(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, dim, weight: word counts hashed to DIMENSIONS places, of unit length."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), " ")).alias("w")).where("w <> ''")
    dim = (F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("bigint") % DIMENSIONS).cast("int")
    count = words.groupBy("id", dim.alias("dim")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy("id")))
    return count.select("id", "dim", (F.col("n") / norm).alias("weight"))


def dense(vectors: DataFrame) -> DataFrame:
    """id, vector of DIMENSIONS weights."""
    each = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    return each.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0))).alias("vector"))


def packed(vectors: DataFrame) -> DataFrame:
    """id, and the dims and weights of each sparse vector as arrays."""
    each = vectors.groupBy("id").agg(F.collect_list(F.struct("dim", "weight")).alias("v"))
    return each.select("id", F.col("v.dim").alias("dims"), F.col("v.weight").alias("weights"))


def nearest_texts(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of the k closest of sparse docs to each sparse query (id, dim, weight); documents that share no word with a query aren't near it."""
    return _nearest(packed(queries), packed(docs), k, other=False, least=0.0)


def top_k(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each group, ties by id, ranked; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "id", "score", "rank")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank by cosine of dense arrays (id, vector), each other than itself."""
    return _nearest(queries, vectors, k, other=True)


#: Queries that one pass over the vectors takes, at most about: 32 MB of 256 weights.
QUERIES = 16_384


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, other: bool, least: float | None = None) -> DataFrame:
    """Queries go out in blocks of about QUERIES, each a pass over all vectors; a task multiplies blocks and sends its k best of each query.

    other: a query's own id is left out. least: scores must be above it.
    """
    kinds = [dict(x.dtypes)["id"] for x in (queries, vectors)]
    blocks = -(-queries.count() // QUERIES)
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        part = vectors.select(queries.columns).mapInArrow(_scores(queries.sparkSession.sparkContext.broadcast(rows), k, other, least), f"query_id {kinds[0]}, id {kinds[1]}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(found, "query_id", k)


def _scores(shared, k: int, other: bool, least: float | None):
    import numpy as np
    import pyarrow as pa

    def units(t) -> np.ndarray:
        """The unit vectors of a table or batch: arrays of one length, or dims and weights."""
        lists = [t.column(c) for c in range(1, t.num_columns)]
        lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in lists]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        if len(lists) == 1:
            m = flat[0].astype(float).reshape(len(t), -1) if len(t) else np.zeros((0, 0))
        else:
            m = np.zeros((len(t), DIMENSIONS))
            m[np.repeat(np.arange(len(t)), np.diff(lists[0].offsets.to_numpy())), flat[0]] = flat[1]
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def best(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of the k best, ties by id."""
        near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
        return near[np.lexsort((ids[near], -score[near]))[:k]]

    def run(batches):
        asked = shared.value.column("id").to_pylist()
        q = units(shared.value)
        held = [([], []) for _ in asked]
        for b in batches:
            if not len(b) or not asked:
                continue
            own = np.array(b.column(0).to_pylist())
            score = np.round(q @ units(b).T, 6)
            for i, s in enumerate(score):
                keep = np.ones(len(s), bool) if least is None else s > least
                if other:
                    keep &= own != asked[i]
                s, mine = np.concatenate([held[i][0], s[keep]]), np.concatenate([held[i][1], own[keep]]) if len(held[i][1]) else own[keep]
                at = best(s, mine)
                held[i] = (s[at], mine[at])
        out = [(a, x, float(v)) for a, (s, ids) in zip(asked, held) for v, x in zip(s, ids.tolist() if len(ids) else [])]
        schema = pa.schema([("query_id", pa.scalar(asked[0]).type if asked else pa.int64()), ("id", pa.scalar(out[0][1]).type if out else pa.int64()), ("score", pa.float64())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return run
