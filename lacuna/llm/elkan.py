"""Vector codes: vectors are cut into parts, each part becomes the index of its codebook's nearest entry; codebooks are learned by Elkan's form of Lloyd's rounds.

Every part keeps an upper bound of the distance to its entry and a lower bound of the distance to each entry, written with its vector from round to round. An entry is
compared with a part only if the bounds and half the distance between entries don't rule it out strictly; what is compared is compared in whole numbers, so ties and
results are those of plain Lloyd rounds. When entries move, bounds shift by the way they moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder
from .common import join_hot, materialise, small_batches, small_slices, table

#: Whole units of a component of 1.
SCALE = 1024
#: What bounds are widened by, well beyond the rounding of a double's square root.
SLACK = 1e-9
#: Greatest stored lower bound; bounds are stored in units that keep the greatest distance below it.
TOP = 65_535

Books = np.ndarray  # (parts, entries, components of a part), whole numbers


def square_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every row of x to every entry; in doubles, where no sum can reach 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 2**53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots."""
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def above(squares: np.ndarray) -> np.ndarray:
    """Upper bounds of the roots."""
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def first_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, upper bound, lower bounds) of each row; ties go to the lower index."""
    d = square_distances(x, entries)
    at = d.argmin(1)
    return at, above(d[np.arange(len(x)), at]), below(d)


class Step:
    """One round for one part's codebook: bounds shift by how far entries moved, and what they don't rule out is compared."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved
        self.half = 0.5 * below(square_distances(entries, entries))
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(1)

    def __call__(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(index, upper, lower, number of distances computed). An entry is left out only where it is farther for certain, so equal distances are always compared."""
        at, upper, lower = at.copy(), upper + self.moved[at], np.maximum(0, lower - self.moved[None, :])
        open_ = np.flatnonzero(upper >= self.nearest[at])
        own = ((x[open_] - self.entries[at[open_]]) ** 2).sum(1)
        upper[open_] = above(own)
        still = upper[open_] >= self.nearest[at[open_]]
        open_, own, compared = open_[still], own[still], len(own)
        reach = upper[open_, None]
        row, entry = np.nonzero((lower[open_] <= reach) & (self.half[at[open_]] <= reach))
        d = np.empty(len(row), np.int64)
        for lo in range(0, len(row), 1 << 16):  # keeps what is gathered small
            part = slice(lo, lo + (1 << 16))
            d[part] = ((x[open_[row[part]]] - self.entries[entry[part]]) ** 2).sum(1)
        lower[open_[row], entry] = below(d)
        # of each row's distances, its own entry's among them, the least; then the least index
        rows, ds, entries = np.concatenate((np.arange(len(open_)), row)), np.concatenate((own, d)), np.concatenate((at[open_], entry))
        order = np.lexsort((entries, ds, rows))
        best = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        at[open_], upper[open_] = entries[best], above(ds[best])
        return at, upper, lower, compared + len(row)


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def _list(values: np.ndarray) -> pa.Array:
    """A list column from a matrix."""
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(values).ravel()))


def _assign(books: Books, moved: np.ndarray | None, unit: float, last: bool):
    """mapInArrow over (columns to pass on..., x[, at, upper, lower]): the assignment to `books`, with bounds or, in the last round, with the error."""
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = None if moved is None else [Step(books[p], moved[p]) for p in range(parts)]
        for batch in small_slices(batches, 2048):
            if not len(batch):
                continue
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = _vectors(named["x"], parts)
            n = len(x)
            at, upper, lower = np.empty((n, parts), np.int32), np.empty((n, parts)), np.empty((n, parts, entries), np.uint16)
            if steps is not None:
                old_at, old_upper = (_vectors(named[c], parts)[:, :, 0] for c in ("at", "upper"))
                old_lower = np.frombuffer(b"".join(named["lower"].to_pylist()), np.uint16).reshape(n, parts, entries)
            for p in range(parts):
                found = first_assignment(x[:, p], books[p]) if steps is None else steps[p](x[:, p], old_at[:, p], old_upper[:, p], old_lower[:, p] * unit)
                at[:, p], upper[:, p], lower[:, p] = found[0], found[1], np.minimum(found[2] / unit, TOP)
            passed = batch.columns[: batch.schema.names.index("x")]
            if last:
                error = ((x - books[np.arange(parts), at]) ** 2).sum((1, 2))
                new = {"codes": _list(at), "error": pa.array(error)}
            else:
                new = {"x": named["x"], "at": _list(at), "upper": _list(upper), "lower": pa.array([r.tobytes() for r in lower], pa.binary())}
            yield pa.RecordBatch.from_arrays([*passed, *new.values()], [*batch.schema.names[: len(passed)], *new])

    return run


def _sums(parts: int, entries: int):
    """mapInArrow over (x, at): of each task, the number and the componentwise sums of every entry's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x, at = _vectors(batch.column(0), parts), _vectors(batch.column(1), parts)[:, :, 0]
            if total is None:
                total = np.zeros((parts, entries, x.shape[2] + 1), np.int64)
            for p in range(parts):
                np.add.at(total[p, :, 0], at[:, p], 1)
                np.add.at(total[p, :, 1:], at[:, p], x[:, p])
        if total is not None:
            p, e = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), _list(total[p, e])], ["p", "e", "s"])

    return run


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def compress(df: DataFrame, id_col: str, vector_col: str, carry: dict[str, Column] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Books]:
    """((id, carried columns, codes array<int>, error long) of every kept row, the learned codebooks).

    Components become floor(1024 * x). Rows without a whole vector (is_whole) are left out, and so are vectors of another length than that of the least id's. The vectors
    of the `entries` least ids (null ids last, ties by components; all, if there are fewer) are the first codebooks; `rounds` times parts go to their nearest entry, ties to the lower index, and each entry that has
    parts becomes the floor of their mean; then parts are assigned once more. error is the sum of the last squared distances. Repeated ids are rows of their own; an empty table has no
    codes and empty codebooks. A length that `parts` doesn't divide, and components whose squared distances don't fit a long, raise ValueError.

    Bounds are a table of 2 bytes an entry and part with each vector, rewritten in every round (the old one is deleted then); what a round moves over the network are sums, one
    row for each entry, part and task. Codebooks and their sums are all that reaches the driver.
    """
    spark, carry = df.sparkSession, carry or {}
    small_batches(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE))
    kept = df.where(is_whole(F.col(vector_col))).select(F.col(id_col).alias("id"), *[c.alias(name) for name, c in carry.items()], F.col(vector_col).alias("v"), whole.alias("x"))
    least = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    size = len(least[0]["x"]) if least else 0
    if size % parts:
        raise ValueError(f"{parts} equal parts don't make {size} components")
    kept = materialise(kept.where(F.size("v") == size).withColumn("_most", F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).drop("v"))
    facts = kept.agg(F.count(F.lit(1)).alias("n"), F.max("_most").alias("most")).first()
    most = math.ceil((facts.most or 0) * SCALE) + 1
    if 4 * size * most * most >= 2**63 or most * max(1, facts.n) >= 2**63:
        raise ValueError(f"components of up to {facts.most} are too large for squared distances in 64 bits")
    at, kept = kept.schema, kept.drop("_most")
    told = ", ".join(f"`{c}` {at[c].dataType.simpleString()}" for c in ("id", *carry))
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect() if size else []
    books = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy() if seeds else np.zeros((parts, 0, 0), np.int64)
    if not seeds:  # no row, or vectors without components
        return kept.select("id", *carry, F.array_repeat(F.lit(0), parts).alias("codes"), F.lit(0).cast("long").alias("error")), books
    unit = max(1.0, 2 * most * math.sqrt(size / parts) / TOP)
    bounds = f"{told}, x array<long>, at array<int>, upper array<double>, lower binary"
    state, path, moved = kept, None, None
    for _ in range(rounds):
        new = new_folder(spark, "bounds")
        state.mapInArrow(_assign(books, moved, unit, False), bounds).write.parquet(new)
        if path:
            _delete(spark, path)
        path, state = new, spark.read.schema(bounds).parquet(new)
        sums = state.select("x", "at").mapInArrow(_sums(parts, len(seeds)), "p int, e int, s array<long>")
        sums = sums.select("p", "e", F.posexplode("s").alias("i", "v")).groupBy("p", "e", "i").agg(F.sum("v").alias("v")).collect()  # a codebook's worth
        total = np.zeros((parts, len(seeds), size // parts + 1), np.int64)
        for r in sums:
            total[r.p, r.e, r.i] = r.v
        count = total[:, :, :1]
        fresh = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
        books, moved = fresh, above(((fresh - books) ** 2).sum(2))
    coded = materialise(state.mapInArrow(_assign(books, moved, unit, True), f"{told}, codes array<int>, error long"))
    if path:
        _delete(spark, path)
    return coded, books


def books_digest(books: Books) -> str:
    """SHA-256 (hex) of all components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of embeddings with a whole vector.

    Labels are equal as texts are; null labels are one group. A frequent label's rows stay spread: sums by label are one row a label and task.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", {"by": label})
    sums = materialise(coded.groupBy("by").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return join_hot(coded, total, sums, "by", "n").select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    part = f"v[t.p * len(v) // {parts} + 1:(t.p + 1) * len(v) // {parts}]"
    out = [f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, CAST(t.p AS INTEGER) AS p, {part} AS v FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, CAST(r - 1 AS INTEGER) AS e, v FROM x WHERE r <= {entries})"""]
    near = "SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, b.e, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS d FROM x JOIN {} b USING (p)) GROUP BY r, p"
    for i in range(rounds):
        out.append(f"""a{i} AS MATERIALIZED ({near.format(f"b{i}")}),
m{i} AS (SELECT p, e, list(c ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS c FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS i FROM a{i} JOIN x USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (p, e))""")
    out.append(f"""z AS ({near.format(f"b{rounds}")}), c AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (r), s""")
    return ",\n".join(out)


ORACLE_SQL = _oracle()
