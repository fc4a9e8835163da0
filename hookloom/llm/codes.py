"""Vector codes from product codebooks, fitted over all rows with Drake-Hamerly adaptive bounds.

Components become integers and all arithmetic is exact, so codes do not depend on how rows
are partitioned. A vector is cut into equal parts, each with a codebook of its position.
Fitting alternates between assigning every part to its nearest entry and replacing entries
by the floored means of their parts; sums per entry are combined before their shuffle, and
only codebooks (parts x entries x width integers) come to the driver.

Bounds. Each part carries its entry with an upper bound on its distance, its ``b`` next closest
entries with ordered lower bounds, and one outer lower bound for all entries not listed. When
entries move, bounds give way by whole-number moves rounded up, so they stay valid
without regard to floating point. A part whose upper bound lies under its first lower bound keeps its
entry untested. Otherwise its own distance is computed in integers, and, still uncertain,
those of the listed entries up to the first bound beyond it; if even the outer bound is reached,
all of them. Ties are never settled by bounds, only by distances and then by index. ``b`` shrinks to what nearly
all uncertain parts needed (Drake), counted over the whole table in each round; it changes work, never results.

State is written to the shared folder after each round, in two folders taken in turn.

Defined cases. Vectors that are null, empty, or hold a null or non-finite component are dropped, and so are
those of another length than the kept vector of the smallest id, which fit no codebook. Fewer ids than
entries give smaller codebooks. A repeated id starts an entry once, from its smallest vector;
every repeated row is coded. A null id comes after all others. A length that is no multiple of
the parts, and components of 2^16 and more, whose squares could leave 64 bits, raise an error. An empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.session import localize_if_small, shared_dir, stage_table

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
# Components stay below this, so that squared distances of a whole vector fit into 64 bits.
MAX_COMPONENT = float(1 << 16)
# Entries listed at first, as a share of all; later lists serve this share of uncertain parts.
FIRST_LISTED, SERVED = 2, 0.99

STATE = "vec_id long, label long, vector array<int>, code binary, upper binary, listed binary, lower binary, needed array<long>"
FAR = np.iinfo(np.uint16).max


def kept_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and the integer ``vector`` of usable rows."""
    value = F.col(f"`{vector}`")
    usable = value.isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    large = F.raise_error(F.lit(f"vector components must be under {MAX_COMPONENT:.0f}"))

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < MAX_COMPONENT, F.floor(x * scale).cast("int")).otherwise(large)

    return embeddings.select(
        F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"),
        F.when(usable, F.transform(value, whole)).alias("vector"),
    ).filter("vector IS NOT NULL")


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` cut from the vectors of the smallest ids."""
    seeds = vectors.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(
        F.asc_nulls_last("vec_id")
    ).limit(entries).collect()
    if not seeds:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    length = len(seeds[0].vector)
    if length % parts:
        raise ValueError(f"vectors of {length} components can not be cut into {parts} parts")
    same = [row.vector for row in seeds if len(row.vector) == length]
    if len(same) < len(seeds):  # some of the smallest ids fit no codebook; others take their place
        return first_codebooks(vectors.filter(F.size("vector") == length), parts, entries)
    return np.array(same, dtype=np.int64).reshape(len(same), parts, -1).transpose(1, 0, 2).copy()


def _binary(matrix: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    data = np.ascontiguousarray(matrix)
    width = data.itemsize * int(np.prod(data.shape[1:]))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape).copy()


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Whole square roots, rounded up or down, exactly."""
    root = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root + (root * root < squares) if up else root


def _squares(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances ``[row, part, entry]``."""
    return np.stack([
        np.square(vectors[:, p, None, :] - books[p][None]).sum(axis=2) for p in range(books.shape[0])
    ], axis=1)


def _ranked(squares: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """Entry, its distance rounded up, the next entries and lower bounds, from all squared distances ``[point, entry]``."""
    order = np.argsort(squares, axis=1, kind="stable")
    near = np.take_along_axis(squares, order[:, :listed + 2], axis=1)
    lower = _roots(near[:, 1:], up=False)
    lower = np.pad(lower, ((0, 0), (0, listed + 1 - lower.shape[1])), constant_values=FAR)
    return order[:, 0], _roots(near[:, 0], up=True), order[:, 1:listed + 1], np.minimum(lower, FAR)


def settle(
    points: np.ndarray, books: np.ndarray, part: np.ndarray, code: np.ndarray, upper: np.ndarray,
    near: np.ndarray, lower: np.ndarray,
) -> np.ndarray:
    """Bring ``code``, ``upper``, ``near`` and ``lower`` of points up to date, in place.

    Bounds must hold for ``books``. ``lower[:, i]`` bounds entry ``near[:, i]`` and all after it,
    the last bounds all entries not listed. Returns how many entries of its list each point
    needed: -1 settled by bounds alone, b + 1 all entries.
    """
    listed = near.shape[1]
    needed = np.full(len(points), -1)
    doubtful = np.flatnonzero(upper >= lower[:, 0])
    if not len(doubtful):
        return needed
    own = np.square(points[doubtful] - books[part[doubtful], code[doubtful]]).sum(axis=1)
    upper[doubtful] = _roots(own, up=True)
    # The first bound strictly beyond the point's own distance; listed + 1 if there is none.
    bounds = lower[doubtful].astype(np.int64)
    beyond = bounds * bounds > own[:, None]
    needed[doubtful] = np.where(beyond.any(axis=1), beyond.argmax(axis=1), listed + 1)
    for depth in range(1, listed + 1):
        at = np.flatnonzero(needed == depth)
        if len(at):
            candidates = np.concatenate([code[at, None], near[at, :depth]], axis=1)
            squares = np.square(points[at, None, :] - books[part[at, None], candidates]).sum(axis=2)
            rank = np.lexsort((candidates, squares), axis=1)
            candidates = np.take_along_axis(candidates, rank, axis=1)
            squares = np.take_along_axis(squares, rank, axis=1)
            code[at], upper[at] = candidates[:, 0], _roots(squares[:, 0], up=True)
            near[at[:, None], np.arange(depth)] = candidates[:, 1:]
            # A bound also covers what comes later in the list.
            found = np.minimum(_roots(squares[:, 1:], up=False), lower[at, depth, None])
            lower[at[:, None], np.arange(depth)] = found
    at = np.flatnonzero(needed == listed + 1)
    for position in np.unique(part[at]):
        some = at[part[at] == position]
        squares = np.square(points[some, None, :] - books[position][None]).sum(axis=2)
        code[some], upper[some], near[some], lower[some] = _ranked(squares, listed)
    return needed


def first_assignment(books: np.ndarray, listed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State of rows whose parts are compared with all entries."""
    parts, width = books.shape[0], books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
                squares = _squares(vectors, books).reshape(-1, books.shape[1])
                code, upper, near, lower = _ranked(squares, listed)
                yield _state(batch, parts, code, upper, near, lower, np.zeros(listed + 3, dtype=np.int64))

    return assign


def next_assignment(
    books: np.ndarray, moves: np.ndarray, held: int, listed: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State after entries moved by at most ``moves``; lists are cut from ``held`` entries to ``listed``."""
    parts, width = books.shape[0], books.shape[2]
    farthest = moves.max(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, width)
            part = np.tile(np.arange(parts), batch.num_rows)
            code = _matrix(batch.column("code"), np.uint8, parts).reshape(-1).astype(np.int64)
            upper = _matrix(batch.column("upper"), np.uint32, parts).reshape(-1).astype(np.int64)
            near = _matrix(batch.column("listed"), np.uint8, parts, held).reshape(-1, held)[:, :listed].astype(np.int64)
            lower = _matrix(batch.column("lower"), np.uint16, parts, held + 1).reshape(-1, held + 1).astype(np.int64)
            # The bound after the kept list covers all that was cut off; it gives way by the largest move.
            lower = lower[:, :listed + 1]
            lower[:, :listed] -= moves[part[:, None], near]
            lower[:, listed] -= farthest[part]
            lower = np.maximum(np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1], 0)
            upper += moves[part, code]
            needed = settle(points, books, part, code, upper, near, lower)
            counts = np.bincount(needed + 1, minlength=listed + 3)
            yield _state(batch, parts, code, upper, near, lower, counts)

    return assign


def _state(
    batch: pa.RecordBatch, parts: int, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray,
    counts: np.ndarray,
) -> pa.RecordBatch:
    """A batch of state; its first row carries the batch's counts of needed entries."""
    rows = batch.num_rows
    needed = pa.array([counts.tolist()] + [None] * (rows - 1), type=pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("vec_id"), batch.column("label"), batch.column("vector"),
            _binary(code.astype(np.uint8).reshape(rows, parts)),
            _binary(np.minimum(upper, np.iinfo(np.uint32).max).astype(np.uint32).reshape(rows, parts)),
            _binary(near.astype(np.uint8).reshape(rows, -1)), _binary(lower.astype(np.uint16).reshape(rows, -1)), needed,
        ],
        names=["vec_id", "label", "vector", "code", "upper", "listed", "lower", "needed"],
    )


def _sums(parts: int, entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Component sums and counts per part and entry of a task, as one flat array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
                codes = _matrix(batch.column("code"), np.uint8, parts)
                for p in range(parts):
                    total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p, :, :width], codes[:, p], vectors[:, p])
        yield pa.RecordBatch.from_pylist([{"sums": total.ravel().tolist()}], schema=pa.schema([("sums", pa.list_(pa.int64()))]))

    return add


def refit(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means of the assigned parts; unused entries stay."""
    parts, entries, width = books.shape
    summed = state.select("vector", "code").mapInArrow(_sums(parts, entries, width), "sums array<long>").select(
        F.posexplode("sums").alias("at", "value")
    ).groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(parts * entries * (width + 1), dtype=np.int64)
    for row in summed:
        flat[row["at"]] = row["value"]
    total = flat.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def served_list(state: DataFrame, listed: int, entries: int) -> int:
    """How long lists should be to serve nearly all parts that bounds alone left uncertain."""
    counts = state.filter("needed IS NOT NULL").select(F.posexplode("needed").alias("at", "parts"))
    by_need = {row["at"] - 1: row["parts"] for row in counts.groupBy("at").agg(F.sum("parts").alias("parts")).collect()}
    uncertain = [by_need.get(depth, 0) for depth in range(1, listed + 2)]
    reached = np.cumsum(uncertain) >= SERVED * sum(uncertain)
    return int(min(listed, max(1, entries // 8, int(reached.argmax()) + 1 if reached.any() else 1)))


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame | None]:
    """Codebooks after all rounds, and the rows with their codes under them (None without rows)."""
    books = first_codebooks(vectors, parts, entries)
    if not books.shape[1]:
        return books, None
    if entries > 256:
        raise ValueError("codes hold at most 256 entries")
    rows = vectors.filter(F.size("vector") == parts * books.shape[2])
    base = f"{shared_dir(vectors.sparkSession).rstrip('/')}/hookloom/codes-{uuid.uuid4().hex}"
    listed = min(max(1, books.shape[1] // FIRST_LISTED), books.shape[1] - 1)
    state = stage_table(rows.mapInArrow(first_assignment(books, listed), STATE), "codes", f"{base}/0")
    for number in range(1, rounds + 1):
        moved = refit(state, books)
        moves = _roots(np.square(moved - books).sum(axis=2), up=True)
        books = moved
        if moves.any():
            # A round reads one folder and writes the other.
            wanted = served_list(state, listed, books.shape[1]) if number > 1 and listed else listed
            assign = next_assignment(books, moves, listed, wanted)
            state, listed = stage_table(state.mapInArrow(assign, STATE), "codes", f"{base}/{number % 2}"), wanted
    return books, state


def coded_vectors(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` in hex and the integer squared ``error`` of each row."""
    parts, _, width = books.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
                codes = _matrix(batch.column("code"), np.uint8, parts)
                error = sum(np.square(vectors[:, p] - books[p][codes[:, p]]).sum(axis=1) for p in range(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes]), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return state.select("vec_id", "label", "vector", "code").mapInArrow(
        measure, "vec_id long, label long, code string, error long"
    )


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(embeddings: DataFrame) -> DataFrame:
    """Codes, errors, errors summed over equal labels, and the digest of all codebooks."""
    books, state = fit_codebooks(kept_vectors(embeddings))
    if state is None:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return embeddings.sparkSession.createDataFrame([], schema)
    coded = coded_vectors(state, books)
    # A label may hold most rows: its sum is combined first, then meets the rows where they are
    # if all labels' sums are small, or in a join that adaptive execution may split.
    sums = stage_table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-labels")
    local = localize_if_small(sums)
    joined = coded.join(sums if local is None else F.broadcast(local), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by comparing every part with every entry in each round."""
    steps = ["""WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), points AS MATERIALIZED (
  SELECT rid, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS p FROM kept, range(8) r(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c
  FROM points JOIN (SELECT rid, vec_id FROM kept ORDER BY vec_id LIMIT 16) s USING (rid)
)"""]
    distance = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
  FROM (SELECT rid, points.part, entry, {distance} AS d FROM points JOIN b{r} USING (part)) GROUP BY rid, part
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS c FROM (
    SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r} JOIN points USING (rid, part))
      GROUP BY part, entry, i)) GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry
)""")
    steps.append(f"""coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) FROM (
          SELECT part, entry, array_to_string(c, ',') AS x FROM b{ROUNDS})) AS codebooks_sha256
FROM coded JOIN kept USING (rid)""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


OP13_SQL = _oracle()
