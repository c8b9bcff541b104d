"""Quality scores by positive-unlabelled learning with a non-negative risk.

A linear model g over byte statistics minimises

    prior * E_pos[l(g)] + max(0, E_all[l(-g)] - prior * E_pos[l(-g)]) + ridge,   l(z) = (1 - z)^2 / 4

from trusted positives (labelled 1, outside the held-out fold), unlabelled web text (every
document, labels unseen) and an estimated class prior. With the squared loss the risk is a
function of second moments alone, so one pass over all documents gathers a few small matrices a
partition; nothing is sampled and no text reaches the driver.

The prior is estimated from positives and unlabelled scores, without negatives: no share of all
documents above a threshold can be less than the prior times the share of positives above it, so
the least ratio of the two, over thresholds that at least half of the positives pass (shares of fewer
scatter), estimates the prior. To keep fitted rows out of it, positives are halved by a hash of the id: a model fitted on one half is
counted on the other half and on the documents outside the first; both ways are averaged.

The raw value g is turned into a probability by a logistic curve fitted on at most
CALIBRATION_ROWS labelled rows outside the held-out fold.

Features: square roots of byte frequencies and of hashed byte-pair frequencies, the share of
words that repeat the word before, and the length.
Null and empty texts have the features of an empty text and so get a score too. Ids, language
and source are never features. Repeated ids are scored row by row; where labels repeat an id,
each label counts. Without usable positives the prior is 0.5, and so is every score. An empty
table gives no rows. Other columns are kept, but one named like the new column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, Texts, Workspace, ids_type, prepare, slices

PAIR_BINS = 256
WIDTH = 1 + 130 + PAIR_BINS + 2 + 3
RIDGE = 1e-3
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Scores are counted in bins for the prior: the squared loss draws them to -1 and 1.
SCORE_BINS, SCORE_REACH = 3000, 3.0
#: The least share of positives above a threshold that is looked at.
LEAST_SHARE = 0.5


#: ASCII bytes stand for themselves; of others only the two halves of a character are told apart.
_FOLDED = np.array([b if b < 128 else 128 + (b >= 0xC2) for b in range(256)], dtype=np.uint8)


def features(texts: Texts) -> np.ndarray:
    """One row per text: constant, byte and byte-pair shares (square roots), repeats, length."""
    n, data = len(texts), texts.data
    lengths = np.diff(texts.offsets)
    out = np.zeros((n, WIDTH))
    out[:, 0] = 1.0
    if len(data):
        # 32 bits serve: a slice has at most SLICE_BYTES bytes and as many texts, or one text
        small = np.int32 if n * PAIR_BINS < 2**31 else np.int64
        owner = np.repeat(np.arange(n, dtype=small), lengths)
        cell = owner * small(130)
        cell += _FOLDED[data]
        single = np.bincount(cell, minlength=n * 130).reshape(n, 130)
        cell = owner[:-1] * small(PAIR_BINS)
        cell += data[:-1] * np.uint8(31) + data[1:] * np.uint8(7)  # modulo PAIR_BINS: bytes wrap around
        double = np.bincount(cell[owner[:-1] == owner[1:]], minlength=n * PAIR_BINS).reshape(n, PAIR_BINS)
        del owner, cell
        size = np.maximum(lengths, 1)[:, None]
        out[:, 1:131] = np.sqrt(single / size)
        out[:, 131 : 131 + PAIR_BINS] = np.sqrt(double / size)
        starts, ends, ranges = texts.words()
        if len(starts) > 1:
            words = Spans(data).hashes(starts, ends)
            holder = np.repeat(np.arange(n), np.diff(ranges))
            again = (words[1:] == words[:-1]) & (holder[1:] == holder[:-1])
            share = np.bincount(holder[1:][again], minlength=n) / np.maximum(np.diff(ranges), 1)
            out[:, 131 + PAIR_BINS], out[:, 132 + PAIR_BINS] = share, np.sqrt(share)
    scale = np.log1p(lengths) / 10.0
    out[:, -3], out[:, -2], out[:, -1] = scale, scale * scale, lengths == 0
    # half precision is how features are written; scores from texts and from tables agree
    return out.astype(np.float16).astype(np.float64)


def feature_table(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of every document, written once for fitting and scoring.

    A row is under a kilobyte whatever the length of its text, so that labels are joined and
    scores made without moving or reading the texts again.
    """
    named = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for t in slices(batch.column(1)) for r in features(t).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return ws.save(named.mapInArrow(work, f"doc_id {ids_type(named)}, x binary"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype=np.float16).reshape(-1, WIDTH).astype(np.float64)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    slope: float
    shift: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def minimise_risk(prior: float, all_a: np.ndarray, all_m: np.ndarray, pos_a: np.ndarray, pos_m: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights of the least non-negative risk, from mean second and first moments.

    max(0, n) is the most of t * n over t from 0 to 1, and for each t the risk is a convex quadratic
    in the weights. Where the negative part is not below zero at t = 1, that is the minimum; else the
    minimum lies where the negative part is zero, at a t found by halving.
    """
    eye = np.eye(len(all_m)) * ridge
    eye[0, 0] = ridge * 1e-3

    def at(t: float) -> np.ndarray:
        return np.linalg.solve(0.5 * (prior * (1 - t) * pos_a + t * all_a) + eye, 0.5 * (prior * (1 + t) * pos_m - t * all_m))

    def negative(w: np.ndarray) -> float:
        return 0.25 * (1 + 2 * w @ all_m + w @ all_a @ w) - prior * 0.25 * (1 + 2 * w @ pos_m + w @ pos_a @ w)

    w = at(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        w = at(middle)
        low, high = (middle, high) if negative(w) >= 0 else (low, middle)
    return w


_TRIANGLE = np.triu_indices(WIDTH)
_KINDS = ("all", "pos0", "pos1")


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray]]:
    """Weight and sums (upper triangle of products, then features) of all rows and of positives by half."""
    tri = _TRIANGLE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, plain, weight = np.zeros((3, WIDTH, WIDTH)), np.zeros((3, WIDTH)), np.zeros(3)
        for batch in batches:
            x, ones, half = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            # a null id has no label, so a null half is never looked at
            for k, mine in enumerate((np.ones(len(x), bool), (ones > 0) & (half == 0), (ones > 0) & (half == 1))):
                w = np.ones(len(x)) if k == 0 else ones[mine]
                part = x if k == 0 else x[mine]
                if len(part):
                    products[k] += (part * w[:, None]).T @ part
                    plain[k] += w @ part
                    weight[k] += w.sum()
        flat = [np.concatenate([products[k][tri], plain[k]]).tobytes() for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(_KINDS), pa.array(weight), pa.array(flat, pa.binary())], names=["kind", "weight", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            for kind, w, flat in zip(*(c.to_pylist() for c in batch.columns)):
                have = total.setdefault(kind, [0.0, 0.0])
                have[0] += w
                have[1] = have[1] + np.frombuffer(flat)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([v[0] for v in total.values()]), pa.array([v[1].tobytes() for v in total.values()], pa.binary())],
                names=["kind", "weight", "sums"],
            )

    schema = "kind string, weight double, sums binary"
    part = rows.mapInArrow(gather, schema)
    # three small matrices a task, added in rounds before the driver gets one set
    for ways in (256, 16, 1):
        part = part.repartition(F.spark_partition_id() % ways).mapInArrow(merge, schema)
    total = {k: (0.0, np.zeros(len(tri[0]) + WIDTH)) for k in _KINDS}
    for r in part.collect():
        w, s = total[r["kind"]]
        total[r["kind"]] = (w + r["weight"], s + np.frombuffer(bytes(r["sums"])))
    return total


def _mean(sums: tuple[float, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean products (whole matrix) and mean features."""
    w, s = sums
    a, n = np.zeros((WIDTH, WIDTH)), len(_TRIANGLE[0])
    a[_TRIANGLE] = s[:n] / w
    return a + np.triu(a, 1).T, s[n:] / w


def bounded_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The least ratio of the shares above a threshold, from two histograms of scores."""
    u, p = (np.cumsum(x[::-1]) / x.sum() for x in (unlabelled, positive))
    seen = p >= LEAST_SHARE
    return float((u[seen] / p[seen]).min())


def _estimated_prior(table: DataFrame, known: DataFrame, half: Column, sums: dict[str, tuple[float, np.ndarray]], every: tuple[np.ndarray, np.ndarray]) -> float:
    """The class prior from scores of positives and of all documents, each half judged by the other's model."""
    halves = [k for k in (0, 1) if sums[f"pos{k}"][0] and sums[f"pos{1 - k}"][0]]
    if not halves:
        return 0.5
    models = [minimise_risk(0.5, *every, *_mean(sums[f"pos{k if k in halves else halves[0]}"])) for k in (0, 1)]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            at = [np.clip((x @ w + SCORE_REACH) * (SCORE_BINS / 2 / SCORE_REACH), 0, SCORE_BINS - 1).astype(np.int32) for w in models]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, at)], names=["doc_id", "bin0", "bin1"])

    # two small numbers a document are joined to the labels, not its features
    placed = table.select("doc_id", "x").mapInArrow(bins, f"doc_id {ids_type(table)}, bin0 int, bin1 int")
    placed = placed.join(known.where("ones > 0"), "doc_id", "left").withColumn("half", half)
    seen = np.zeros((4, SCORE_BINS))
    for k in halves:
        fitted = F.col("ones").isNotNull() & (F.col("half") == k)
        counted = placed.where(~fitted).groupBy(F.col(f"bin{k}").alias("bin")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("ones"), F.lit(0)).alias("p")
        )
        for r in counted.collect():  # at most SCORE_BINS rows
            seen[2 * k, r["bin"]], seen[2 * k + 1, r["bin"]] = r["n"], r["p"]
    found = []
    for k in halves:
        apart, n_fit = seen[2 * k].sum(), seen[2 * (1 - k) + 1].sum()  # documents outside the fitted half, and in it
        if seen[2 * k + 1].sum():
            found.append((min(bounded_prior(seen[2 * k], seen[2 * k + 1]), 1.0) * apart + n_fit) / (apart + n_fit))
    return min(max(float(np.mean(found)), 0.01), 0.99) if found else 0.5


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def _logistic_curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the smoothed labels (as in Platt's method)."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - target) + 1e-3 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learns from documents(id, text) and labels(doc_id, quality 0/1)."""
    ws = Workspace(spark, "quality")
    model = fit_features(feature_table(ws, docs, id_col, text_col), labels)
    ws.drop("features")
    return model


def fit_features(table: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from a feature table (doc_id, x) and labels(doc_id, quality 0/1)."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.sum("quality").alias("ones"), F.count("*").alias("labels_"))
    )
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = table.join(known, "doc_id", "left").select("x", F.coalesce("ones", F.lit(0)).alias("ones"), half.alias("half"))
    sums = _moments(rows)
    if not sums["pos0"][0] + sums["pos1"][0]:
        return QualityModel(np.zeros(WIDTH), 0.0, 0.0, 0.5)
    every, positive = _mean(sums["all"]), _mean((sums["pos0"][0] + sums["pos1"][0], sums["pos0"][1] + sums["pos1"][1]))
    prior = _estimated_prior(table, known, half, sums, every)
    weights = minimise_risk(prior, *every, *positive)
    raw_model = QualityModel(weights, 1.0, 0.0, prior)
    # at most CALIBRATION_ROWS ids: small enough to be broadcast, so the features are not moved again
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    few = table.join(F.broadcast(some), "doc_id")
    raws = _rate(few, raw_model, raw=True, keep=["doc_id", "ones", "labels_"])
    got = raws.toPandas().sort_values("doc_id")
    raw = np.concatenate([got["value"], got["value"]])
    label = np.concatenate([np.ones(len(got)), np.zeros(len(got))])
    count = np.concatenate([got["ones"], got["labels_"] - got["ones"]]).astype(int)
    slope, shift = _logistic_curve(np.repeat(raw, count), np.repeat(label, count))
    return QualityModel(weights, slope, shift, prior)


def _rate(df: DataFrame, model: QualityModel, raw: bool, keep: list[str], of: str = "x") -> DataFrame:
    """The kept columns and value: the model over a column of features, or of texts. A kept column of texts is sent once."""
    fields, from_text = [df.schema[c] for c in keep], df.schema[of].dataType.simpleString() == "string"
    sent = keep if of in keep else [*keep, of]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.raw if raw else model.score
        for batch in batches:
            source = batch.column(sent.index(of))
            parts = [rate(features(t)) for t in slices(source)] if from_text else [rate(_matrix(source))]
            got = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got)], names=[*keep, "value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", value double"
    return df.select(*sent).mapInArrow(work, schema)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one column more: the probability of label 1."""
    prepare(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    of = names[at]
    if plain.schema[of].dataType.simpleString() != "string":
        plain, of = plain.withColumn("_text", F.col(of).cast("string")), "_text"
    rated = _rate(plain, model, raw=False, keep=names, of=of)
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c.lower() != out.lower()]
    return rated.select(*kept, F.col("value").alias(out))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "quality")
    table = feature_table(ws, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit_features(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = _rate(table, model, raw=False, keep=["doc_id"]).withColumnRenamed("value", "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
