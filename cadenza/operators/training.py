"""Data-parallel training of the two-tower and click-rate networks.

Each step broadcasts the weights (small arrays), every task adds up the gradients of
its examples in Arrow batches, Spark sums them in a tree (as whole numbers, so in any order), and the
driver takes one step of Adam. So the driver sees weights and gradients, never examples. An epoch has a step for
each of its parts, which a hash deals; a validation set picks the best epoch's
weights, and with a folder each epoch's state is stored, from which a run goes on."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .ranking import Din

Layers = list[tuple[np.ndarray, np.ndarray]]


def layers(sizes: tuple[int, ...], seed: int = 42) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal((a, b)) * math.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def forward(net: Layers, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Output of ReLU layers (the last one linear) and each layer's input."""
    seen = []
    for i, (w, b) in enumerate(net):
        seen.append(x)
        x = x @ w + b
        if i < len(net) - 1:
            x = np.maximum(x, 0)
    return x, seen


def backward(net: Layers, seen: list[np.ndarray], g: np.ndarray) -> tuple[Layers, np.ndarray]:
    """Gradients of the weights and of the input from that of the output."""
    out: Layers = []
    for i in range(len(net) - 1, -1, -1):
        x = seen[i].reshape(-1, seen[i].shape[-1])
        flat = g.reshape(-1, g.shape[-1])
        out.append((x.T @ flat, flat.sum(0)))
        g = g @ net[i][0].T
        if i:
            g = g * (seen[i] > 0)
    return out[::-1], g


def unit(x: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    n = np.linalg.norm(x, axis=-1, keepdims=True) + 1e-8
    y = x / n
    return y, lambda g: (g - y * (g * y).sum(-1, keepdims=True)) / n


def tower_loss(nets: list[Layers], user: np.ndarray, item: np.ndarray, others: np.ndarray, heat: float = 0.1) -> tuple[float, list[Layers]]:
    """InfoNCE of each positive item [n, d] against the others [n, k, d]."""
    u, su = forward(nets[0], user)
    items = np.concatenate([item[:, None], others], axis=1)
    v, sv = forward(nets[1], items)
    (u, back_u), (v, back_v) = unit(u), unit(v)
    score = (u[:, None] * v).sum(-1) / heat
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(p[:, 0] + 1e-12).sum())
    p[:, 0] -= 1
    g = p / heat
    gu, _ = backward(nets[0], su, back_u((g[:, :, None] * v).sum(1)))
    gv, _ = backward(nets[1], sv, back_v(g[:, :, None] * u[:, None]))
    return loss, [gu, gv]


def click_loss(nets: list[Layers], candidate: np.ndarray, history: np.ndarray, label: float) -> tuple[float, list[Layers]]:
    """Cross entropy of one example; history [h, d]."""
    pairs = np.concatenate([history, np.broadcast_to(candidate, history.shape)], axis=1)
    a, sa = forward(nets[0], pairs)
    w = np.exp(a[:, 0] - a.max())
    w /= w.sum()
    interest = w @ history
    z, sz = forward(nets[1], np.concatenate([interest, candidate])[None])
    p = 1 / (1 + math.exp(-float(z[0, 0])))
    gz, gx = backward(nets[1], sz, np.array([[p - label]]))
    gw = history @ gx[0, : len(interest)]
    ga, _ = backward(nets[0], sa, (w * (gw - w @ gw))[:, None])
    return -math.log(max(1e-12, p if label else 1 - p)), [ga, gz]


def click_losses(nets: list[Layers], candidate: np.ndarray, history: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, list[Layers]]:
    """Sums of click_loss over examples; history holds the rows of all, `size` (above 0) of each."""
    first, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    a, sa = forward(nets[0], np.concatenate([history, candidate[row]], axis=1))
    w = np.exp(a[:, 0] - np.maximum.reduceat(a[:, 0], first)[row])
    w /= np.add.reduceat(w, first)[row]
    z, sz = forward(nets[1], np.concatenate([np.add.reduceat(w[:, None] * history, first), candidate], axis=1))
    p = 1 / (1 + np.exp(-z[:, 0]))
    gz, gx = backward(nets[1], sz, (p - label)[:, None])
    gw = (history * gx[row, : history.shape[1]]).sum(1)
    ga, _ = backward(nets[0], sa, (w * (gw - np.add.reduceat(w * gw, first)[row]))[:, None])
    return float(-np.log(np.maximum(1e-12, np.where(label != 0, p, 1 - p))).sum()), [ga, gz]


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, size)


def _flat(nets: list[Layers]) -> np.ndarray:
    return np.concatenate([x.ravel() for net in nets for layer in net for x in layer])


def _shaped(flat: np.ndarray, like: list[Layers]) -> list[Layers]:
    out, i = [], 0
    for net in like:
        own: Layers = []
        for layer in net:
            pair = []
            for x in layer:
                pair.append(flat[i : i + x.size].reshape(x.shape))
                i += x.size
            own.append(tuple(pair))
        out.append(own)
    return out


def save_weights(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Arrays as a table (name, shape, x)."""
    rows = [(n, list(x.shape), np.asarray(x, float).ravel().tolist()) for n, x in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, x array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.x).reshape(r.shape) for r in spark.read.parquet(path).collect()}  # as large as the model


def named(nets: list[Layers]) -> dict[str, np.ndarray]:
    """The arrays of nets by net, layer and w or b, as save_weights takes them."""
    return {f"{i}/{j}/{'wb'[k]}": x for i, net in enumerate(nets) for j, layer in enumerate(net) for k, x in enumerate(layer)}


def unnamed(arrays: dict[str, np.ndarray]) -> list[Layers]:
    nets: dict[int, dict[int, dict[str, np.ndarray]]] = {}
    for name, x in arrays.items():
        i, j, k = name.split("/")
        nets.setdefault(int(i), {}).setdefault(int(j), {})[k] = x
    return [[(layer["w"], layer["b"]) for _, layer in sorted(net.items())] for _, net in sorted(nets.items())]


CHUNK = 64  # examples that are multiplied together
FIXED = float(1 << 24)  # sums of gradients are in these parts of one, so their order is of no account


def packed(examples: DataFrame, columns: list[str], key: list[str], folder: str, size: int = CHUNK) -> DataFrame:
    """Examples in lists of about `size` (column chunk), dealt by a hash of their key and in its order, as a table.
    What a network learns from them doesn't depend on how they are spread over tasks."""
    n = examples.count()
    part = F.pmod(F.xxhash64(*key), F.lit(max(1, n // size))).alias("part")
    listed = F.array_sort(F.collect_list(F.struct(*key, *columns)))
    chunks = examples.groupBy(part).agg(F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("chunk"))
    chunks.select("chunk").write.mode("overwrite").parquet(folder)
    return examples.sparkSession.read.parquet(folder)


TOGETHER = 128  # chunks that share a dictionary of vectors
RUN = 1024  # examples of a user that are dealt together


def packed_ids(examples: DataFrame, columns: list[str], key: list[str], tables: dict[str, DataFrame], folder: str, size: int = CHUNK, runs: bool = False) -> DataFrame:
    """As packed(), with the same chunks, but examples hold ids, singly or in lists, where a column is one of tables (id, vec): a vector is
    sent and kept once for each TOGETHER chunks, not for each example. runs: examples are dealt by the
    first of the key, RUN at a time, for those of a user share vectors, and cut into chunks in order of the key.
    All ids must be in the tables."""
    spark, n = examples.sparkSession, examples.count()
    parts = max(1, n // size)
    buckets = -(-parts // TOGETHER)
    place = F.row_number().over(W.partitionBy(key[0]).orderBy(*key[1:])) - 1
    if runs:
        dealt = examples.withColumns({"part": F.lit(0).cast("long"), "bucket": F.pmod(F.xxhash64(key[0], F.floor(place / RUN)), F.lit(buckets))})
    else:
        dealt = examples.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts))).withColumn("bucket", F.col("part") % buckets)
    kinds, lists = sorted({id(x): x for x in tables.values()}), {c for c, t in examples.dtypes if t.startswith("array")}
    place = {c: kinds.index(id(x)) for c, x in tables.items()}
    vecs = []
    for k, x in enumerate(kinds):
        table = next(t for t in tables.values() if id(t) == x)
        asked = F.explode(F.flatten(F.array(*(F.col(c) if c in lists else F.array(c) for c in tables if place[c] == k)))).alias("id")
        vecs.append(dealt.select(F.col("bucket").alias("b"), asked).distinct().join(table.toDF("id", "vec"), "id").select("b", F.lit(k).alias("kind"), F.col("id").cast("long").alias("id"), "vec"))
    names = [f"{c}_{x}" for c in columns for x in (("at", "n") if c in lists else ("at",))]
    order = [(x, "ascending") for x in ("part", *key)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(order)
        part = left["part"].to_numpy()
        first = np.arange(0, left.num_rows, size) if runs else np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out = {"sizes": np.diff(np.append(first, left.num_rows))}
        kind, ids, ms = right["kind"].to_numpy(), [], []
        for k in range(len(kinds)):
            some = right.filter(pa.array(kind == k)).sort_by("id")
            ids.append(some["id"].to_numpy())
            ms.append(some["vec"].combine_chunks().flatten().to_numpy().tobytes())
        for c in columns:
            x = left[c].combine_chunks()
            if c in lists:
                out[f"{c}_n"] = x.value_lengths().to_numpy()
                x = x.flatten()
            out[f"{c}_at"] = np.searchsorted(ids[place[c]], x.to_numpy()) if c in place else x.to_numpy()
        return pa.table({**{c: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for c, x in out.items()}, "ms": pa.array([ms], pa.list_(pa.binary())), "counts": pa.array([[len(x) for x in ids]], pa.list_(pa.int32()))})

    kind = ", ".join(f"{c} array<int>" for c in ("sizes", *(x for c in columns for x in ([f"{c}_n", f"{c}_at"] if c in lists else [f"{c}_at"]))))
    tasks = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = dealt.select("bucket", "part", *key, *(c for c in columns if c not in key)).repartition(tasks, "bucket")
    right = reduce(DataFrame.unionByName, vecs).repartition(tasks, "b")
    chunks = left.groupBy("bucket").cogroup(right.groupBy("b")).applyInArrow(run, f"{kind}, ms array<binary>, counts array<int>")
    fields = [F.struct(*(F.col(x) for x in names if x.rsplit("_", 1)[0] == c), F.lit(place.get(c, -1)).alias("place")).alias(c) for c in columns]
    chunks.select("sizes", "ms", "counts", *fields).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def _unpacked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The chunks of packed_ids() with their vectors."""
    columns = b.schema.names[3:]
    for r in range(b.num_rows):
        row = {c: b.column(c)[r] for c in b.schema.names}
        ms = [np.frombuffer(m.as_buffer()).reshape(n.as_py(), -1) for m, n in zip(row["ms"], row["counts"], strict=True)]
        seen = {c: (row[c]["place"].as_py(), row[c][f"{c}_at"].values.to_numpy(), np.append(0, np.cumsum(row[c][f"{c}_n"].values.to_numpy())) if f"{c}_n" in row[c] else None) for c in columns}
        start = 0
        for n in row["sizes"].values.to_numpy().tolist():
            out = []
            for place, at, ends in seen.values():
                a, z = (start, start + n) if ends is None else (ends[start], ends[start + n])
                x = at[a:z]
                if place >= 0:
                    m = ms[place][x]
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
                else:
                    x = pa.array(x)
                out.append(x if ends is None else pa.ListArray.from_arrays(pa.array(ends[start : start + n + 1] - a, pa.int32()), x))
            yield pa.RecordBatch.from_arrays(out, names=columns)
            start += n


def _gradients(examples: DataFrame, flat: np.ndarray, nets: list[Layers], gradient: Callable) -> np.ndarray:
    """The sums of gradients, and last of losses and examples, in whole parts of FIXED."""
    shared = examples.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = _shaped(shared.value, nets), np.zeros(shared.value.size + 2, np.int64)
        for b in batches:
            lists = [pa.RecordBatch.from_struct_array(x.values) for x in b.column(0)] if b.schema.names == ["chunk"] else _unpacked(b) if b.schema.names[0] == "sizes" else [b]
            for x in lists:
                loss, part, n = gradient(now, x)
                total += np.append(np.rint(np.append(_flat(part), loss) * FIXED).astype(np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "x"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t["x"])
        return pa.table({"slot": t["slot"].slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    found = examples.mapInArrow(run, "slot int, x binary").groupBy("slot").applyInArrow(add, "slot int, x binary").collect()  # 16 rows at most
    shared.unpersist()
    total = sum((np.frombuffer(r.x, np.int64) for r in found), np.zeros(len(flat) + 2, np.int64))
    return np.append(total[:-1] / FIXED, total[-1])


def fit(examples: DataFrame, nets: list[Layers], gradient: Callable, epochs: int = 10, rate: float = 0.01, decay: float = 0.0, steps: int = 1, valid: DataFrame | None = None, folder: str | None = None) -> tuple[list[Layers], list[float]]:
    """Trained nets and the mean loss of each epoch (of `valid`, if that is given; then the
    nets are those of its best epoch). gradient(nets, batch) gives (loss, gradients,
    examples) of an Arrow batch; the learning rate falls as a cosine. folder: where each
    epoch's state is kept; a later call goes on behind the last one."""
    spark, flat = examples.sparkSession, _flat(nets)
    m, v, losses, best, first = np.zeros_like(flat), np.zeros_like(flat), [], flat, 0
    if folder is not None:
        for first in range(epochs, 0, -1):
            try:
                state = load_weights(spark, f"{folder}/epoch-{first}")
            except AnalysisException:
                continue
            flat, m, v, best, losses = state["flat"], state["m"], state["v"], state["best"], state["losses"].tolist()
            break
        else:
            first = 0
    part = F.pmod(F.xxhash64(*examples.columns), F.lit(steps))
    for epoch in range(first, epochs):
        seen = np.zeros(2)
        for s in range(steps):
            summed = _gradients(examples.where(part == s) if steps > 1 else examples, flat, nets, gradient)
            seen += summed[-2:]
            g, at = summed[:-2] / max(1.0, summed[-1]), epoch * steps + s + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
            flat = flat * (1 - step * decay) - step * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-8)
        if valid is not None:
            seen = _gradients(valid, flat, nets, gradient)[-2:]
        losses.append(float(seen[0] / max(1.0, seen[1])))
        if valid is None or losses[-1] == min(losses):
            best = flat
        if folder is not None:
            save_weights(spark, {"flat": flat, "m": m, "v": v, "best": best, "losses": np.array(losses)}, f"{folder}/epoch-{epoch + 1}")
    return _shaped(best, nets), losses


TOWER, CLICK = ["user", "item", "others"], ["candidate", "history", "label"]  # what examples hold


def _columns(examples: DataFrame, columns: list[str]) -> DataFrame:
    if "sizes" in examples.columns:
        return examples.select("sizes", "ms", "counts", *columns)
    return examples.select("chunk") if "chunk" in examples.columns else examples.select(*columns)


def with_vectors(positives: DataFrame, negatives: DataFrame, users: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, song_id, user, item, others): what towers learn from. A user's negatives, the first k,
    are looked up and listed once for each user, not for each positive."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("song_id"))
    few = negatives.select("user_id", "song_id").withColumn("n", place).where(F.col("n") <= k)
    vec = vectors.select("song_id", "vec")
    others = few.join(vec, "song_id").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("song_id", "vec"))), lambda x: x["vec"]).alias("others"))
    met = positives.select("user_id", "song_id").distinct().join(vec.withColumnRenamed("vec", "item"), "song_id")
    return met.join(users.select("user_id", F.col("vec").alias("user")).join(others, "user_id"), "user_id").select("user_id", "song_id", *TOWER)


def with_ids(positives: DataFrame, negatives: DataFrame, users: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """As with_vectors(), with the ids of vectors: user, item, others."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("song_id"))
    few = negatives.select("user_id", "song_id").withColumn("n", place).where(F.col("n") <= k)
    known = vectors.select("song_id")
    others = few.join(known, "song_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list("song_id")).alias("others"))
    met = positives.select("user_id", "song_id").distinct().join(known, "song_id", "left_semi").join(users.select("user_id"), "user_id", "left_semi")
    return met.join(others, "user_id").select("user_id", "song_id", F.col("user_id").alias("user"), F.col("song_id").alias("item"), "others")


def with_history_ids(examples: DataFrame, vectors: DataFrame) -> DataFrame:
    """As with_histories(), with the ids of vectors: candidate, history. Songs without a vector are listed
    for each user; no song of an example's history is a row of a shuffle. examples are read twice."""
    known = vectors.select("song_id")
    asked = examples.select("user_id", F.explode("hist").alias("song_id")).where("song_id IS NOT NULL").distinct()
    lacking = asked.join(known, "song_id", "left_anti").groupBy("user_id").agg(F.collect_set("song_id").alias("lacking"))
    met = examples.join(known, "song_id", "left_semi").join(lacking, "user_id", "left")
    history = F.filter("hist", lambda x: x.isNotNull() & ~F.coalesce(F.array_contains("lacking", x), F.lit(False)))
    return met.select("user_id", "song_id", F.col("song_id").alias("candidate"), history.alias("history"), "label").where(F.size("history") > 0)


def with_histories(examples: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, song_id, label, candidate, history): what a click-rate model learns from, of din_examples.
    Songs without a vector are left out of histories; examples whose song has none go."""
    vec = vectors.select("song_id", "vec")
    places = examples.select("user_id", "song_id", "label", F.posexplode("hist").alias("at", "h")).where("h IS NOT NULL").join(vec.toDF("h", "v"), "h")
    lists = places.groupBy("user_id", "song_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("history"))
    return lists.join(vec.withColumnRenamed("vec", "candidate"), "song_id").select("user_id", "song_id", *CLICK)


def fit_towers(examples: DataFrame, size: int, epochs: int = 10, hidden: tuple[int, ...] = (512, 256, 256), seed: int = 42, rate: float = 0.01, valid: DataFrame | None = None, **more) -> tuple[list[Layers], list[float]]:
    """Towers of examples (user array, item array, others array of arrays)."""

    def gradient(nets, b: pa.RecordBatch):
        counts = b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        total, loss = [[(np.zeros_like(w), np.zeros_like(c)) for w, c in net] for net in nets], 0.0
        for k in np.unique(counts[counts > 0]).tolist():
            user, item, others = (c.take(pa.array(np.flatnonzero(counts == k))) for c in b.columns)
            part, g = tower_loss(nets, _matrix(user, size), _matrix(item, size), _matrix(others.flatten(), size).reshape(-1, k, size))
            loss += part
            total = [[(a + c, b2 + d) for (a, b2), (c, d) in zip(x, y, strict=True)] for x, y in zip(total, g, strict=True)]
        return loss, total, int(np.count_nonzero(counts))

    nets = [layers((size, *hidden), seed), layers((size, *hidden), seed + 1)]
    return fit(_columns(examples, TOWER), nets, gradient, epochs, rate, valid=None if valid is None else _columns(valid, TOWER), **more)


def fit_din(examples: DataFrame, size: int, epochs: int = 10, seed: int = 42, rate: float = 0.01, valid: DataFrame | None = None, **more) -> tuple[Din, list[float]]:
    """A click-rate model of examples (candidate array, history array of arrays, label)."""

    def gradient(nets, b: pa.RecordBatch):
        counts = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(counts)
        if not len(at):
            return 0.0, [[(np.zeros_like(w), np.zeros_like(c)) for w, c in net] for net in nets], 0
        candidate, history, label = (c.take(pa.array(at)) for c in b.columns)
        loss, g = click_losses(nets, _matrix(candidate, size), _matrix(history.flatten(), size), counts[at], label.to_numpy(zero_copy_only=False).astype(float))
        return loss, g, len(at)

    model = Din(size, seed)
    nets, losses = fit(_columns(examples, CLICK), [model.attention, model.click], gradient, epochs, rate, valid=None if valid is None else _columns(valid, CLICK), **more)
    model.attention, model.click = nets
    return model, losses


def tower(net: Layers) -> Callable[[Column], Column]:
    """A trained tower as a function of a column of vectors, in Arrow batches."""
    @pandas_udf("array<double>")
    def encoded(v: pd.Series) -> pd.Series:
        y, _ = unit(forward(net, np.stack(v.to_list()))[0])
        return pd.Series(list(y))

    return encoded


def accuracy(rates: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of examples that a rate of at least one half gets right."""
    met = rates.join(labels, ["user_id", "song_id"])
    return met.agg(F.count("*").alias("n"), F.avg(((F.col("ctr") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
