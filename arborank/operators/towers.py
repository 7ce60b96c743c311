"""CF-23: two towers, one for readers and one for items, trained by a pairwise ranking loss.

A tower is a linear map, layer normalisation, GELU and a second linear map; a score is the cosine of both outputs. Each step sends the weights to the tasks of one
mini-batch, sums their gradients there and adds the totals up in rounds; the driver only moves the weights. Triples lie in blocks with each vector that they name once, so
a vector moves, and goes through its tower, once a block and not once a triple.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import doubles
from ..sources.storage import shared_dir, written
from .dense import mapped, rows_of, task_sums

NAMES = ("w1", "b1", "gain", "shift", "w2", "b2")
Weights = dict[str, np.ndarray]
#: Triples of a block, at most, and rows that go through a tower at once.
BLOCK_TRIPLES, TOWER_ROWS = 250_000, 8_192
SHAPE = "batch int, users binary, items binary, n_users int, n_items int, u_at binary, p_at binary, n_at binary"
#: erf and its slope at points STEP apart, up to where it is 1.
STEP = 1 / 512
POINTS = np.arange(int(6 / STEP) + 1) * STEP
KNOTS, SLOPES = np.array([math.erf(x) for x in POINTS]), 2 / math.sqrt(math.pi) * np.exp(-(POINTS**2))


def erf(x: np.ndarray) -> np.ndarray:
    """By four terms of the series from the nearest point, which leaves out less than 1e-15."""
    far = np.minimum(np.abs(x), 6.0)
    k = np.rint(np.nan_to_num(far) / STEP).astype(np.int64)
    at = POINTS[k]
    d = far - at
    series = d * (1 - d * (at - d * ((2 * at**2 - 1) / 3 - d * at * (2 * at**2 - 3) / 6)))
    return np.sign(x) * (KNOTS[k] + SLOPES[k] * series)


def start(width: int, out: int, draw: np.random.Generator) -> Weights:
    side = 1 / math.sqrt(width)
    return {"w1": draw.uniform(-side, side, (width, width)), "b1": draw.uniform(-side, side, width), "gain": np.ones(width), "shift": np.zeros(width), "w2": draw.uniform(-side, side, (width, out)), "b2": draw.uniform(-side, side, out)}


def forward(p: Weights, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The outputs at length 1, and what backward() needs."""
    x = np.asarray(x, np.float64)
    z = x @ p["w1"] + p["b1"]
    dev = np.sqrt(z.var(1, keepdims=True) + 1e-5)
    n = (z - z.mean(1, keepdims=True)) / dev
    a = n * p["gain"] + p["shift"]
    share = 0.5 * (1 + erf(a / math.sqrt(2)))
    h = a * share
    y = h @ p["w2"] + p["b2"]
    size = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return y / size, (x, dev, n, a, share, h, y / size, size)


def backward(p: Weights, kept: tuple, up: np.ndarray) -> Weights:
    """The gradients of the weights, summed over the rows, from those of the outputs."""
    x, dev, n, a, share, h, y, size = kept
    dy = (up - y * (up * y).sum(1, keepdims=True)) / size
    dh = dy @ p["w2"].T
    da = dh * (share + a * np.exp(-(a**2) / 2) / math.sqrt(2 * math.pi))
    dn = da * p["gain"]
    dz = (dn - dn.mean(1, keepdims=True) - n * (dn * n).mean(1, keepdims=True)) / dev
    return {"w1": x.T @ dz, "b1": dz.sum(0), "gain": (da * n).sum(0), "shift": da.sum(0), "w2": h.T @ dy, "b2": dy.sum(0)}


def outputs(p: Weights, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(p["b2"]))), *[forward(p, x[k : k + TOWER_ROWS])[0] for k in range(0, len(x), TOWER_ROWS)]])


def slopes_of(p: Weights, x: np.ndarray, up: np.ndarray) -> Weights:
    """backward() of many rows, some at a time."""
    total = {k: np.zeros_like(p[k]) for k in NAMES}
    for k in range(0, len(x), TOWER_ROWS):
        own = backward(p, forward(p, x[k : k + TOWER_ROWS])[1], up[k : k + TOWER_ROWS])
        total = {name: total[name] + own[name] for name in NAMES}
    return total


def added(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values by their places, of which there are n."""
    return np.column_stack([np.bincount(to, values[:, d], n) for d in range(values.shape[1])])


def block_slopes(user: Weights, item: Weights, users: np.ndarray, items: np.ndarray, u: np.ndarray, p: np.ndarray, n: np.ndarray, temperature: float) -> tuple[float, Weights, Weights]:
    """Sums over the triples, places u in users and p, n in items, of ln(1 + exp((s(neg) - s(pos)) / temperature)) and of its gradients.

    The gradients from a row's triples are added up before they go back through its tower, once.
    """
    made, shown = outputs(user, users), outputs(item, items)
    a, apart = made[u], shown[p] - shown[n]
    gap = (a * apart).sum(1) / temperature
    pull = (-1 / (1 + np.exp(np.clip(gap, -50, 50))) / temperature)[:, None]
    up = added(p, pull * a, len(items)) - added(n, pull * a, len(items))
    return float(np.logaddexp(0, -gap).sum()), slopes_of(user, users, added(u, pull * apart, len(users))), slopes_of(item, items, up)


def loss_and_slopes(user: Weights, item: Weights, u: np.ndarray, p: np.ndarray, n: np.ndarray, temperature: float) -> tuple[float, Weights, Weights]:
    """block_slopes() of triples whose vectors lie in the rows of u, p and n."""
    at = np.arange(len(u))
    return block_slopes(user, item, u, np.concatenate([p, n]), at, at, at + len(u), temperature)


@dataclass(frozen=True)
class Towers:
    user: Weights
    item: Weights
    losses: list[float]

    def users(self, rows: DataFrame, key: str = "user_id") -> DataFrame:
        """key, v: what the readers' tower makes of profiles (key, v)."""
        return mapped(rows, [key], ["v"], {"v": lambda x, p=self.user: forward(p, x)[0]})

    def items(self, rows: DataFrame, key: str = "item_id") -> DataFrame:
        return mapped(rows, [key], ["v"], {"v": lambda x, p=self.item: forward(p, x)[0]})


def as_bytes(rows: DataFrame) -> DataFrame:
    """id, v: the vectors of rows (id, v) as the bytes of their numbers, written once. Null vectors go."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([v.tobytes() for v in rows_of(x.column(1))], pa.binary())], ["id", "v"])

    return written(rows.filter("v is not null").mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, v binary"), "bytes")


def examples(triples: DataFrame, profiles: DataFrame, items: DataFrame, batches: int) -> str:
    """Writes the triples (user_id, pos, neg) in blocks of one mini-batch, dealt by hash; gives the path. profiles: user_id, v; items: item_id, v.

    A block is one row: the matrices of its users and of its items, and each triple's places in them. Triples lie in ranges by user, so a user is in one block of a
    mini-batch, or in several if there are many triples. Those without a profile or an item's vector are left out. Items keep their kind of number, floats or doubles.
    """
    spark = triples.sparkSession
    batch = F.pmod(F.xxhash64("user_id", "pos", "neg"), F.lit(batches)).cast("int")
    rows = written(triples.select("user_id", "pos", "neg", batch.alias("batch")).dropna(), "triples")
    kinds = {s: rows.schema[c].dataType.simpleString() for s, c in (("u", "user_id"), ("i", "pos"))}
    limit = BLOCK_TRIPLES

    def packed(held: list[pa.Table], block: int, number: int) -> pa.RecordBatch:
        part = pa.concat_tables(held)
        users = part.column("user_id").combine_chunks().dictionary_encode()
        named = pa.concat_arrays([*part.column("pos").chunks, *part.column("neg").chunks]).dictionary_encode()
        at = [x.indices.to_numpy(zero_copy_only=False).astype(np.int32) for x in (users, named)]
        ids = [pa.ListArray.from_arrays(pa.array([0, len(x.dictionary)], pa.int32()), x.dictionary) for x in (users, named)]
        places = [pa.array([x.tobytes()], pa.binary()) for x in (at[0], at[1][: len(part)], at[1][len(part) :])]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([number], pa.int32()), *ids, *places], ["block", "batch", "u_ids", "i_ids", "u_at", "p_at", "n_at"])

    def pack(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, now, block = [], 0, None, TaskContext.get().partitionId() << 32
        for x in given:
            numbers = x.column(3).to_numpy()
            while len(numbers):
                # the rows of the same mini-batch, as far as the block has room
                first = numbers[0]
                if held and (first != now or have >= limit):
                    yield packed(held, block, now)
                    held, have, block = [], 0, block + 1
                n = min(int(np.searchsorted(numbers, first, "right")), limit - have)
                held.append(pa.Table.from_batches([x.slice(0, n)]))
                have, now, numbers, x = have + n, int(first), numbers[n:], x.slice(n)
        if held:
            yield packed(held, block, now)

    order = ["batch", "user_id", "pos", "neg"]
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // limit)), *order).sortWithinPartitions(*order)
    blocks = written(ranges.mapInArrow(pack, f"block long, batch int, u_ids array<{kinds['u']}>, i_ids array<{kinds['i']}>, u_at binary, p_at binary, n_at binary"), "blocks")
    none = lambda kind: F.lit(None).cast(kind)
    asked = {s: blocks.select("block", F.explode(f"{s}_ids").alias("id")) for s in "ui"}
    users = asked["u"].join(as_bytes(profiles.select(F.col("user_id").alias("id"), doubles("v").alias("v"))), "id").select("block", F.col("id").alias("u"), none(kinds["i"]).alias("i"), "v")
    named = asked["i"].join(as_bytes(items.select(F.col("item_id").alias("id"), "v")), "id").select("block", none(kinds["u"]).alias("u"), F.col("id").alias("i"), "v")
    kept = ["batch", "users", "items", "n_users", "n_items", "u_at", "p_at", "n_at"]

    def meet(there: pa.Table, here: pa.Table) -> pa.Table:
        row, places, made, sizes = {c: here.column(c)[0] for c in here.column_names}, {}, [], []
        for s in "ui":
            own = there.filter(pc.is_valid(there.column(s)))
            place = pc.index_in(row[f"{s}_ids"].values, value_set=own.column(s).combine_chunks())
            places[s] = place.fill_null(-1).to_numpy(zero_copy_only=False)
            made, sizes = [*made, b"".join(own.column("v").to_pylist())], [*sizes, own.num_rows]
        at = [places[s][np.frombuffer(row[f"{c}_at"].as_py(), np.int32)] for s, c in (("u", "u"), ("i", "p"), ("i", "n"))]
        known = np.logical_and.reduce([x >= 0 for x in at])
        if not known.any():
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=kept)
        columns = [here.column("batch"), *[pa.array([x], pa.binary()) for x in made], *[pa.array([n], pa.int32()) for n in sizes]]
        return pa.table([*columns, *[pa.array([x[known].astype(np.int32).tobytes()], pa.binary()) for x in at]], names=kept)

    path = shared_dir(spark, "batches")
    full = users.unionByName(named).groupBy("block").cogroup(blocks.withColumnRenamed("block", "own").groupBy("own")).applyInArrow(meet, SHAPE)
    full.write.partitionBy("batch").parquet(path)
    return path


def train(triples: DataFrame, profiles: DataFrame, items: DataFrame, out: int | None = None, batches: int = 4, epochs: int = 3, rate: float = 0.01, temperature: float = 0.2, decay: float = 1e-5, seed: int = 42) -> Towers:
    """Adam over the mini-batches. Gives the towers and each epoch's mean loss; without triples the towers stay as drawn."""
    spark = triples.sparkSession
    items = items.filter(F.col("v").isNotNull())
    first = items.select(F.size("v")).first()
    width = first[0] if first else 1
    draw = np.random.default_rng(seed)
    both = [start(width, out or width, draw), start(width, out or width, draw)]
    shapes = [x.shape for p in both for x in (p[k] for k in NAMES)]
    flat = np.concatenate([p[k].ravel() for p in both for k in NAMES])

    def parted(values: np.ndarray) -> list[Weights]:
        cuts = np.split(values, np.cumsum([math.prod(s) for s in shapes])[:-1])
        each = [x.reshape(s) for x, s in zip(cuts, shapes, strict=True)]
        return [dict(zip(NAMES, each[:6], strict=True)), dict(zip(NAMES, each[6:], strict=True))]

    path = examples(triples, profiles, items, batches)
    rows = spark.read.schema(SHAPE).parquet(path)
    kind = np.float32 if items.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    there = sorted(r.batch for r in rows.select("batch").distinct().collect())  # `batches` rows at most
    m, v, step, losses = np.zeros(len(flat)), np.zeros(len(flat)), 0, []
    for _ in range(epochs if there else 0):
        seen, total = 0.0, 0.0
        for batch in there:
            user, item = parted(flat)

            def slopes(part: pa.RecordBatch, user: Weights = user, item: Weights = item) -> np.ndarray:
                total = 0.0
                for row in (part.slice(k, 1).to_pylist()[0] for k in range(part.num_rows)):
                    at = [np.frombuffer(row[c], np.int32) for c in ("u_at", "p_at", "n_at")]
                    users, shown = np.frombuffer(row["users"]).reshape(row["n_users"], -1), np.frombuffer(row["items"], kind).reshape(row["n_items"], -1)
                    loss, du, di = block_slopes(user, item, users, shown, *at, temperature)
                    total = total + np.concatenate([[len(at[0]), loss], *[g[k].ravel() for g in (du, di) for k in NAMES]])
                return total

            sums = task_sums(rows.filter(F.col("batch") == batch).drop("batch"), slopes)
            grad = sums[2:] / sums[0] + decay * flat
            seen, total, step = seen + sums[0], total + sums[1], step + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        losses.append(total / seen)
    return Towers(*parted(flat), losses)
