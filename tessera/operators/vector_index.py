"""An approximate vector index: cells around fitted centres, short codes within them, exact scores for the best codes.

build_vector_index() fits centres and codebooks on a bounded sample and stores every vector in the cell of its nearest
centre, with a code of one byte for each part of what the centre leaves over. A search opens the cells nearest to each
query, compares codes there by table, and scores the best candidates exactly by their stored vectors. How many cells it
takes to hold most of the nearest vectors is read off the sample: few where vectors cluster, more than half of them where
they do not, and then the codes, a sixteenth of a vector's bytes, save the work. A miss is possible; the tests measure it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bm25 import ranked
from .search import QUERY_BLOCK, Nearest, dot, unit

#: Vectors that centres and codebooks are fitted on, those with the smallest hashes of their ids.
SAMPLE = 20_000
LEAST_CELLS, MOST_CELLS = 16, 4096
#: Parts of a vector, and values of a part's code.
PARTS, CODES = 16, 256
ROUNDS = 12
#: Vectors of a cell in one file, about.
FILE_VECTORS = 2_000_000
#: Share of a vector's nearest ones that should lie in the cells opened for it; as many are opened as the sample asks for.
IN_CELLS = 0.97
FORMAT = 2


_MANIFEST = "path string, id_type string, probes int"


def _fit(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of the points by Lloyd's rounds; centres that nothing is near to move to the worst placed points."""
    draw = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = _nearest(points, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        centres[lost] = points[np.argsort(-far)[: len(lost)]]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its squared distance."""
    d = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    near = d.argmin(1)
    return near, d[np.arange(len(points)), near]


@dataclass
class Codebooks:
    """centres: a row a cell; books: the code values of each part, over the dimensions bounds[p] : bounds[p + 1]."""

    centres: np.ndarray
    books: list[np.ndarray]
    bounds: list[int]

    @staticmethod
    def fit(points: np.ndarray, cells: int) -> Codebooks:
        centres = _fit(points, cells, 1)
        rest = points - centres[_nearest(points, centres)[0]]
        bounds = np.linspace(0, points.shape[1], min(PARTS, points.shape[1]) + 1).astype(int).tolist()
        return Codebooks(centres, [_fit(rest[:, lo:hi], CODES, 2 + n) for n, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))], bounds)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point, and its code."""
        cell, _ = _nearest(points, self.centres)
        rest = points - self.centres[cell]
        parts = [_nearest(rest[:, lo:hi], book)[0] for lo, hi, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)]
        return cell, np.stack(parts, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, part, code): what a code value adds to a query's product with a vector."""
        parts = [queries[:, lo:hi] @ book.T for lo, hi, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)]
        return np.stack([np.pad(p, ((0, 0), (0, CODES - p.shape[1]))) for p in parts], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column; a zero vector stays."""
    n = len(column)
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _probes(books: Codebooks, points: np.ndarray, k: int = 20, asked: int = 200) -> int:
    """How many cells have to be opened so that a share of IN_CELLS of the k nearest of some points lies in them."""
    queries = points[:asked]
    near = np.argsort(-(queries @ points.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(_opened(books, queries, len(books.centres)), axis=1)
    depth = np.sort(np.take_along_axis(place, _nearest(points, books.centres)[0][near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(IN_CELLS * len(depth)))]) + 1


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    codebooks: Codebooks
    id_type: str
    probes: int

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, vector array<float>, code binary, cell int").parquet(f"{self.path}/vectors")


def build_vector_index(vectors: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
    """Store vectors(id, vector) below folder. Rows without a vector are left out; all vectors have one length.

    SAMPLE vectors are fitted on, whatever the size of the table; every vector is stored. A cell of many vectors is
    dealt to several files by their ids.
    """
    spark, vectors = vectors.sparkSession, vectors.where("vector is not null and id is not null").select("id", F.col("vector").cast("array<float>").alias("vector"))
    n = vectors.count()
    cells = cells or int(min(MOST_CELLS, max(LEAST_CELLS, 2 * n**0.5)))
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    points = _matrix(some.column("vector").combine_chunks())
    books = Codebooks.fit(points, cells) if len(points) else Codebooks(np.zeros((1, 1)), [np.zeros((1, 1))], [0, 1])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, code = books.encode(_matrix(batch.column("vector")))
                yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "vector", "code", "cell"])

    id_type = dict(vectors.dtypes)["id"]
    placed = vectors.mapInArrow(run, f"id {id_type}, vector array<float>, code binary, cell int").withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(1 + n // len(books.centres) // FILE_VECTORS * 4)))
    path = f"{folder}/{uuid.uuid4().hex}"
    placed.repartition("cell", "_slice").drop("_slice").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    flat = [("centres", books.centres)] + [(f"book{i}", b) for i, b in enumerate(books.books)]
    fitted = [(name, i, row.tolist()) for name, rows in flat for i, row in enumerate(rows)]
    spark.createDataFrame(fitted, "name string, i int, row array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
    probes = _probes(books, points) if len(points) else 1
    spark.createDataFrame([(path, id_type, probes)], _MANIFEST).coalesce(1).write.json(f"{folder}/manifest")
    return open_vector_index(spark, folder)


def open_vector_index(spark: SparkSession, folder: str) -> VectorIndex | None:
    """The index in folder, or None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        path, id_type, probes = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").first()
    except AnalysisException:
        return None
    rows = spark.read.parquet(f"{path}/codebooks").orderBy("name", "i").collect()  # MOST_CELLS centres and PARTS codebooks
    of = {name: np.array([r["row"] for r in rows if r["name"] == name]) for name in {r["name"] for r in rows}}
    books = [of[f"book{i}"] for i in range(len(of) - 1)]
    return VectorIndex(spark, path, Codebooks(of["centres"], books, np.cumsum([0, *(b.shape[1] for b in books)]).tolist()), id_type, probes)


def approximate_top_k(index: VectorIndex, queries: DataFrame, k: int = 20, probes: int | None = None, rescored: int = 4) -> DataFrame:
    """(qid, rank, id, score) as dense_top_k gives them, from the cells nearest to each of queries(qid, qvec).

    probes cells are opened, as many as the sample asked for if not given. Of their vectors the best rescored * k by code are scored exactly. Queries, a stated set, are taken in blocks; a
    block's vectors and tables go to all tasks, and only cells that one of them opens are read.
    """
    queries = queries.where("qvec is not null")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    types = f"qid {dict(queries.dtypes)['qid']}, id {index.id_type}, score double, cell int"
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        asked = part.select("qid", unit("qvec").alias("v")).collect()  # QUERY_BLOCK rows or so
        if not asked:
            continue
        points = np.array([r["v"] for r in asked], float)
        opened = _opened(index.codebooks, points, probes or index.probes)
        cells = sorted(set(opened.ravel().tolist()))
        found = index.rows().where(F.col("cell").isin(cells)).select("cell", "id", "code").mapInArrow(_by_code([r["qid"] for r in asked], points, opened, index.codebooks, rescored * k), types)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        near = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rescored * k).select("qid", "cell", "id")
        exact = near.join(index.rows().where(F.col("cell").isin(cells)).select("cell", "id", "vector"), ["cell", "id"]).join(F.broadcast(part.select("qid", "qvec")), "qid")
        scores = exact.select("qid", "id", F.round(F.greatest(F.lit(0.0), 1 - (1 - dot(unit("vector"), unit("qvec"))) / 2), 6).alias("score"))
        best = ranked(scores, k)
        out = best if out is None else out.unionByName(best)
    return index.spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, rank long, id {index.id_type}, score double") if out is None else out


def _opened(books: Codebooks, points: np.ndarray, probes: int) -> np.ndarray:
    """The cells of each query whose centres are nearest."""
    d = (books.centres**2).sum(1) - 2 * points @ books.centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :probes]


def _by_code(qids: list, points: np.ndarray, opened: np.ndarray, books: Codebooks, k: int):
    asking: dict[int, list[int]] = {}
    for q, cells in enumerate(opened.tolist()):
        for c in cells:
            asking.setdefault(c, []).append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, base = books.tables(points), points @ books.centres.T
        best = Nearest(len(qids), k, 0.0)
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for c in np.unique(cell).tolist():
                at, q = np.flatnonzero(cell == c), asking.get(c)
                if q:
                    score = base[q, c][None, :] + sum(tables[q, p][:, code[at, p]].T for p in range(tables.shape[1]))
                    best.add(np.array(q), ids[at], score, c)
        q, ids, score, cell = best.rows()
        yield pa.record_batch([pa.array([qids[x] for x in q]) if len(q) else pa.array([], pa.array(qids).type), pa.array(ids), pa.array(score), pa.array(cell.astype(np.int32))], names=["qid", "id", "score", "cell"])

    return run
