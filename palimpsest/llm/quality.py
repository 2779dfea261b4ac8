"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts. Training uses at most SAMPLE_ROWS labelled rows (those with the smallest hashes of
their id), so what reaches the driver is bounded; scoring covers every row. The trees are flattened into arrays of feature,
threshold, left and right child and value, through which numpy moves all rows of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.blocks import free_names, lean, slices, small_batches
from palimpsest.llm.ngram_join import word_edges, word_hashes

SAMPLE_ROWS = 20_000
REJECT_BELOW = 0.3
FOLDS = 5
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "symbol_share", "stop_share", "digit_share", "high_share", "blank_share",
    "line_share", "repeat_share", "distinct_share", "pair_share", "top_share", "bare_share",
)

LETTER, UPPER, DIGIT, STOP, BLANK_, SYMBOL, HIGH = (np.zeros(256, bool) for _ in range(7))
UPPER[65:91] = True
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
DIGIT[48:58] = True
STOP[list(b".,;:?'\"()-")] = True
BLANK_[[32, 9, 10, 11, 12, 13]] = True
HIGH[128:] = True
SYMBOL[:128] = ~(LETTER | DIGIT | STOP | BLANK_)[:128]
#: What is counted of a text's bytes, as flags of each byte; bytes of equal flags are one kind, so a text's kinds are counted at once.
COUNTED = {"letter": LETTER, "upper": UPPER, "digit": DIGIT, "stop": STOP, "blank": BLANK_, "symbol": SYMBOL, "high": HIGH, "line": np.arange(256) == 10}
KINDS, _at = np.unique(np.column_stack(list(COUNTED.values())), axis=0, return_inverse=True)
KIND_OF = _at.ravel().astype(np.int64)
WORDY = (LETTER | DIGIT).astype(np.uint8)


def _by_text(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per text; 0 for a text with none."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts + counts] - total[starts]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text of a slice. An empty text has zeros only."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.bincount(KIND_OF[data] + np.repeat(np.arange(n) * len(KINDS), size), minlength=n * len(KINDS)).reshape(n, len(KINDS))
    counted = dict(zip(COUNTED, (kinds @ KINDS.astype(np.int64)).T, strict=True))
    share = lambda what: counted[what] / np.maximum(size, 1)
    words, doc = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    # letters of each word, to find words without any
    inner = np.maximum(count - 1, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    pairs = words[:-1] * np.uint64(3) + words[1:] if len(words) else words
    distinct, pair_kinds, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (f, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        if c:
            ordered = np.sort(words[f : f + c])
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            distinct[i] = len(new)
            top[i] = np.diff(np.append(new, c)).max()
            p = np.sort(pairs[f : f + c - 1])
            pair_kinds[i] = 1 + (p[1:] != p[:-1]).sum() if c > 1 else 0
    w = np.maximum(count, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(count), (size - counted["blank"]) / w, share("upper") / np.maximum(share("letter"), 1e-9), share("symbol"), share("stop"), share("digit"), share("high"), share("blank"),
        share("line"), _by_text(same, first, count) / w, distinct / w, pair_kinds / inner, top / w, _bare_words(data, offsets) / w,
    ]).astype(np.float32)


def _bare_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text that have neither letter nor digit."""
    starts, ends = word_edges(data, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    # Of each word and what follows it the word's part; the last end may be that of the data.
    spans = np.column_stack([starts, ends]).ravel()
    bare = np.maximum.reduceat(WORDY[data], spans[: len(spans) - (spans[-1] == len(data))])[::2] == 0
    return np.bincount(np.searchsorted(offsets, starts[bare], "right") - 1, minlength=len(offsets) - 1)


@dataclass
class Trees:
    """Boosted trees as arrays; a leaf points at itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least_rows: int = 20, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the logistic loss: per level one histogram of gradients per node, feature and bin, best split by gain."""
    n, width = x.shape
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(prior / (1 - prior)))
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        i = len(flat["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            flat[k].append(v)
        return i

    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
        code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        margin = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            where = np.full(n, node(0.0))
            roots.append(int(where[0]))
            level = [int(where[0])]
            for _ in range(depth):
                after: list[int] = []
                for at in level:
                    rows = np.flatnonzero(where == at)
                    g, h = grad[rows], hess[rows]
                    gs, hs = g.sum(), h.sum()
                    best = (1e-6, -1, -1)
                    for j in range(width):
                        if not len(edges[j]):
                            continue
                        c = code[rows, j]
                        k = len(edges[j]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g, h, None))
                        ok = (nl >= least_rows) & (len(rows) - nl >= least_rows)
                        gain = np.where(ok, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), 0)
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (float(gain[b]), j, b)
                    _, j, b = best
                    if j < 0:
                        continue
                    kids = [node(0.0), node(0.0)]
                    flat["feature"][at], flat["threshold"][at], flat["left"][at], flat["right"][at] = j, float(edges[j][b]), *kids
                    where[rows] = np.where(code[rows, j] <= b, kids[0], kids[1])
                    after += kids
                level = after
            ids, back = np.unique(where, return_inverse=True)
            leaf = -rate * np.bincount(back, grad) / (np.bincount(back, hess) + ridge)
            for i, v in zip(ids.tolist(), leaf.tolist(), strict=True):
                flat["value"][i] = v
            margin += leaf[back]
    array = lambda k, t: np.array(flat[k], t)
    return Trees(base, np.array(roots, np.int64), array("feature", np.int64), array("threshold", np.float32), array("left", np.int64), array("right", np.int64), array("value", np.float64), depth)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is a multiple of ``folds`` (a null id: never)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def _statistic_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            x = statistics(data, offsets)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("label")[a:b], rows], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled rows outside the held-out fold.

    Labels with a null id or quality are ignored; of differing labels of an id the mean decides (a half counts as 1). Of rows that
    repeat an id one is used. Without labels of both kinds the score is the share of label 1, or a half without any.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    threshold = min(1 << 40, (1 << 41) * sample_rows // max(1, known.count()))  # about twice as many in all tasks together
    sample = known.where(F.col("h") < threshold).orderBy("h", "doc_id").limit(sample_rows).drop("h")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lean(_statistic_rows), f"doc_id {kind}, label int, x array<float>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).select("label", "x").toArrow()
    order = np.lexsort(np.array(found.column("x").to_pylist(), np.float32).T) if found.num_rows else np.zeros(0, int)
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))[order]
    return fit_trees(x, np.array(found.column("label").to_pylist(), np.float64)[order])


def _scorer(model, carry: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                columns = [batch.column(c)[a:b] for c in carry] + [pa.array(trees.score(statistics(data, offsets)))]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def with_score(docs: DataFrame, model: Trees, name: str) -> DataFrame:
    """``docs`` with a column ``name``, which it lacks: the model's probability of label 1. A null text counts as empty."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    return docs.mapInArrow(lean(_scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns, arrow)), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored as texts without words; very long ones are read whole. Equal texts have equal scores, so ties and
    repeated rows are scored alike; a null id is never held out. An empty table gives no rows. Other columns aren't read. Labels as in :func:`train`.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject_below).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns, under any names.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are as in :func:`quality_scores`. Without labels of both
    kinds all rows have one score, and all stay or all go.
    """
    (name,) = free_names(docs.columns, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) >= reject_below).select(*[F.col(f"`{c}`") for c in docs.columns])
