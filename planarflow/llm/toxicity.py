"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, toxic documents among it. The classifier is
linear over the presence of words and word beginnings, and is trained in numpy on the risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with the logistic loss, so that its output estimates the log-odds of the true class although no clean example is named; where
the second part turns negative, a step is taken that raises it again. The prior is the share of toxic ones among the labelled
rows that may be learned from, plus its standard error: too low a prior treats hidden positives as clean. The fit takes at most
POSITIVES and UNLABELLED documents, those of least hash, one text of each doc_id, however many rows and texts have it.
Their features stay on the executors: what reaches the driver is the counts of features that enough positives have, then the
chosen features of each document. Features of fewer than LEAST positives, or less than STANDS standard errors or TIMES more
frequent than chance, are not used, nor more than KEPT. Scoring reads every whole text, in a narrow pass; very long texts in windows.

Nulls and empty texts have no words, so they score what the bias says (the lowest score). Null labels are ignored; a document
labelled twice counts as toxic if any label says so. Without any confirmed example every score is the prior. Repeated rows get
equal scores and weigh once in the fit. Language, source and ids are never inputs. An empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, mix64, scratch, slices, small_batches, trim, views, windows, word_hashes

#: Bounds of the sample that is fitted; hashed features; features kept; score from which a document counts as toxic.
POSITIVES, UNLABELLED, BUCKETS, KEPT, REJECT = 6_000, 20_000, 1 << 20, 8_192, 0.7
#: Positives that must have a feature; how far it must be from chance.
LEAST, STANDS, TIMES = 4, 4, 2
#: Bytes of a word's beginning that are a feature besides the word.
HEAD = 5
DEFAULT_PRIOR = 0.05
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) of the words and their beginnings, sorted."""
    h, doc, starts, ends, data = word_hashes(texts, _APART)
    head = np.zeros(len(h), np.uint64)
    for k in range(HEAD):
        inside = starts + k < ends
        head = head * np.uint64(257) + np.where(inside, data[np.minimum(starts + k, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    longer = ends - starts > HEAD
    both = np.concatenate([h, mix64(head[longer] + np.uint64(1))]) & np.uint64(BUCKETS - 1)
    docs = np.concatenate([doc, doc[longer]]).astype(np.int64)
    pairs = np.unique(docs << 20 | both.astype(np.int64))
    return pairs >> 20, pairs & (BUCKETS - 1)


def _lower(text: memoryview | bytes) -> bytes:
    return str(text, "utf-8").lower().encode()


def sliced_features(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text numbers from first on, buckets) of slices of UTF-8 texts."""
    for a, b in slices(texts):
        if b - a == 1 and len(texts[a]) > 2 * SLICE_BYTES:
            found = np.zeros(BUCKETS, bool)
            for w in windows(texts[a]):
                found[word_features([_lower(w)])[1]] = True
            bucket = np.flatnonzero(found)
            yield a, b, np.zeros(len(bucket), np.int64), bucket
        else:
            yield a, b, *word_features([_lower(t) for t in texts[a:b]])


@dataclass
class ToxicityModel:
    """Weights of the kept buckets, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list) -> np.ndarray:
        """Scores of UTF-8 texts."""
        table = np.zeros(BUCKETS)
        table[self.buckets] = self.weights
        out = np.full(len(texts), self.bias)
        for a, b, doc, bucket in sliced_features(texts):
            out[a:b] += np.bincount(doc, weights=table[bucket], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int, kept: int = KEPT) -> np.ndarray:
    """The features that are far more frequent among the positives than chance allows, the clearest first; p and u count them."""
    expected = positives * (u + 1) / (unlabelled + 2)
    z = (p - expected) / np.sqrt(expected + 1)
    good = np.flatnonzero((p >= LEAST) & (z >= STANDS) & (p >= TIMES * expected))
    return good[np.argsort(-z[good], kind="stable")][:kept]


def counts(rows: list[np.ndarray], size: int = BUCKETS) -> np.ndarray:
    return np.bincount(np.concatenate(rows) if rows else np.zeros(0, np.int64), minlength=size)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, buckets: np.ndarray | None = None, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> ToxicityModel:
    """Train on the buckets of positive and of unlabelled documents, on the given ones or those that choose() takes."""
    if not pos or not unl:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    buckets = choose(counts(pos), counts(unl), len(pos), len(unl)) if buckets is None else buckets
    index = np.full(BUCKETS, -1)
    index[buckets] = np.arange(len(buckets))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        col = index[np.concatenate(docs)]
        return doc[col >= 0], col[col >= 0]

    (pd_, pc), (ud, uc) = rows(pos), rows(unl)
    n, m, k = len(pos), len(unl), len(buckets)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = np.bincount(pd_, w[pc], n) + b, np.bincount(ud, w[uc], m) + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_pos, as_neg_p, as_neg_u = -prior * sigmoid(-gp) / n, -prior * sigmoid(gp) / n, sigmoid(gu) / m
        if negative >= 0:
            dp, du = as_pos + as_neg_p, as_neg_u
        else:  # the unlabelled part is fitted beyond what the prior allows
            dp, du = -as_neg_p, -as_neg_u
        grad = np.r_[np.bincount(pc, dp[pd_], k) + np.bincount(uc, du[ud], k) + decay * w, dp.sum() + du.sum()]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(buckets, w, float(b))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    """Buckets and their digest for each distinct (positive, doc_id, print)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # as many as were chosen at most
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            new = [i for i, n in enumerate(names) if n not in seen and not seen.add(n)]
            batch = batch.take(pa.array(new, pa.int64()))
            for a, b, doc, bucket in sliced_features(views(batch.column(3))):
                bucket = bucket.astype(np.int32)
                ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                digests = pa.array([hashlib.sha256(bucket[u:v].tobytes()).hexdigest() for u, v in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), digests, pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket))], names=["positive", "doc_id", "print", "digest", "buckets"])
        trim()

    found = docs.select("positive", "doc_id", "print", "text").mapInArrow(run, f"positive boolean, doc_id {kind}, print long, digest string, buckets array<int>")
    return found.dropDuplicates(["positive", "doc_id", "print"])


def _kept(rows: DataFrame, buckets: np.ndarray) -> tuple[list[bool], list[np.ndarray]]:
    """Whether each document is positive, and the chosen buckets that it has; in an order that depends on the rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(BUCKETS, bool)
        chosen[buckets] = True
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            good = chosen[flat]
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            ends = np.r_[0, np.cumsum(good)][np.r_[0, ends]].astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[good], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["positive", "digest", "buckets"])
        trim()

    got = rows.select("positive", "digest", "buckets").mapInArrow(run, "positive boolean, digest string, buckets array<int>").toArrow()
    mark, name, cells = (got[c].to_pylist() for c in got.column_names)
    order = sorted(range(len(mark)), key=lambda i: (name[i], mark[i]))
    return [mark[i] for i in order], [np.array(cells[i], np.int64) for i in order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> ToxicityModel:
    """Learn from the labels of documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    if prior is None:
        share = toxic / n if n else 0.0
        prior = min(0.5, share + (share * (1 - share) / n) ** 0.5) if toxic else DEFAULT_PRIOR
    named = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    rows = named.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("print").alias("print"))
    chance = F.xxhash64("doc_id", "print", F.lit(7))
    with scratch():
        rows = cut(rows, "fit-rows")
        sure = rows.join(known.where("toxic = 1").select("doc_id"), "doc_id").select("doc_id", "print", F.lit(True).alias("positive")).orderBy(chance, "doc_id").limit(positives)
        rest = rows.select("doc_id", "print", F.lit(False).alias("positive")).orderBy(chance, "doc_id").limit(unlabelled)
        # At most positives + unlabelled pairs of 16 bytes, so the documents need no shuffle.
        chosen = F.broadcast(cut(sure.unionByName(rest), "fit-chosen"))
        got = cut(_features(named.join(chosen, ["doc_id", "print"])), "fit-features")
        # Positives with equal features count once.
        got = got.where("NOT positive").unionByName(got.where("positive").dropDuplicates(["digest"]))
        p, u = F.count_if("positive"), F.count_if(~F.col("positive"))
        sizes = got.agg(p, u).first()
        held = got.select("positive", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(p.alias("p"), u.alias("u")).where(F.col("p") >= LEAST).toArrow()
        bucket, p, u = (held[c].to_numpy() for c in ("bucket", "p", "u"))
        order = np.argsort(bucket)
        buckets = bucket[order][choose(p[order], u[order], *sizes)].astype(np.int64)
        mark, cells = _kept(got, buckets)
    return fit_nnpu([c for c, m in zip(cells, mark) if m], [c for c, m in zip(cells, mark) if not m], prior, buckets)


def with_score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """docs with the score of every whole text (0 to 1, higher: likelier toxic)."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = pa.array(model.scores(views(text)), pa.float64())
        trim()
        return out

    return docs.withColumn(column, score(F.col("text")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = with_score(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
