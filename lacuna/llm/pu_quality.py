"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk over trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, byte_class, filter_texts, join_narrow, least_hash_part, least_hash_rows, small_batches, table, text_slices, word_spans
from .toxicity import remainder
from .winnowing import gram_hashes

#: Trusted positives and unlabelled rows that the classifier is fitted on at most (those of least hash), and the score of an accepted text.
SAMPLE_ROWS, CUT = 20_000, 0.3
#: Bytes of the blocks whose worst share of each kind is a feature.
BLOCK = 512
#: Kinds of bytes: other, white space, lower, upper, digit, sentence marks, symbols, other marks, non-ASCII.
KINDS = np.zeros(256, np.uint8)
for _k, _set in enumerate(([0x20, *range(0x09, 0x0E)], range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b".,;:'\"()-", b"#*$%&|<>", b"!?~^=+_@\\/[]{}`", range(0x80, 0x100)), 1):
    KINDS[list(_set)] = _k
N_KINDS = 9
_NEWLINE = byte_class([0x0A])
_WORST = (3, 4, 6, 7)
NAMES = (["log_words", "word_length", "lines"] + [f"kind_{k}" for k in range(2, N_KINDS)] + [f"worst_{k}" for k in _WORST] + ["near_repeats", "worst_repeats", "repeated_grams"])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text: lengths, shares of byte kinds, the worst block's shares, and repetition."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(first)
    text = np.repeat(np.arange(n), size)
    # blocks of BLOCK bytes of one text; a text's last block may be short
    blocks = -(-size // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    block = first_block[text] + (np.arange(len(data)) - offsets[text]) // BLOCK
    by_block = np.bincount(block * N_KINDS + KINDS[data], minlength=first_block[-1] * N_KINDS).reshape(-1, N_KINDS)[: first_block[-1]]
    some = np.flatnonzero(size)
    heads = first_block[:-1][some]
    counts = np.zeros((n, N_KINDS))
    solid = np.maximum(by_block.sum(1) - by_block[:, 1], 1)
    worst = np.zeros((n, len(_WORST)))
    if len(some):
        counts[some] = np.add.reduceat(by_block, heads, axis=0)
        # a short last block says little: shares are of half a block at least
        worst[some] = np.maximum.reduceat(by_block[:, _WORST] / np.maximum(solid, BLOCK // 2)[:, None], heads, axis=0)
    chars = np.maximum(counts.sum(1) - counts[:, 1], 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = chars / np.maximum(words, 1)
    if len(some):
        out[some, 2] = np.add.reduceat(_NEWLINE[data].astype(np.int64), offsets[:-1][some]) / np.maximum(words[some], 1)
    out[:, 3:10] = counts[:, 2:] / chars[:, None]
    out[:, 10:14] = worst
    if len(starts):
        h = _word_keys(data, starts, ends)
        of = np.repeat(np.arange(n), words)
        again = np.zeros(len(h), bool)
        for lag in (1, 2, 3, 4):
            if len(h) > lag:
                again[lag:] |= (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        has = np.flatnonzero(words)
        out[has, 14] = np.add.reduceat(again.astype(np.int64), first[:-1][has]) / words[has]
        run = np.cumsum(np.concatenate(([0], again)))
        lo = np.arange(len(h))
        hi = np.minimum(lo + 64, first[of + 1])
        out[has, 15] = np.maximum.reduceat((run[hi] - run[lo]) / 64, first[:-1][has])
        grams = gram_hashes(h, 4)
        ok = of[: len(grams)] == of[3:] if len(grams) else np.zeros(0, bool)
        if ok.any():
            owner = of[: len(grams)][ok]
            key = grams[ok] ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            dup = np.zeros(len(key), bool)
            dup[order[1:]] = key[order[1:]] == key[order[:-1]]
            total = np.bincount(owner, minlength=n)
            out[:, 16] = np.bincount(owner, weights=dup, minlength=n) / np.maximum(total, 1)
    return out


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of each word: its length and hash sums of its bytes by their place."""
    place = np.arange(len(data), dtype=np.uint64)
    length = (ends - starts).astype(np.uint64)
    b = np.where(NOT_SPACE[data], data, 0).astype(np.uint64)
    b = (b * np.uint64(0xD6E8FEB86659FD93)) ^ (b << np.uint64(17))
    rank = place - np.repeat(np.concatenate(([0], starts)).astype(np.uint64), np.diff(np.concatenate(([0], starts, [len(data)]))))
    mixed = b * (rank * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    return np.add.reduceat(mixed, starts) + length * np.uint64(0xC2B2AE3D27D4EB4F)


def level(net: Network, positive: np.ndarray) -> float:
    """The output that scores 0.5: a thousandth of the trusted positives lie below it.

    An error of the prior moves all outputs alike, so the scale of scores is hung on the trusted rows.
    """
    return float(np.quantile(net(positive), 0.001))


def features(df: DataFrame) -> DataFrame:
    """(id, x) of df (id, text): the features of each row's whole text; of null and empty texts all 0."""
    small_batches(df.sparkSession)
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                x = text_features(data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["id", "x"])

    return df.select("id", "text").mapInArrow(run, f"id {kind}, x array<float>")


class Network:
    """One hidden layer over standardised, clipped features."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = np.median(x, 0)
        self.scale = np.maximum(x.std(0), 1e-3)
        d = x.shape[1]
        self.params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z, np.tanh(z @ self.params[0] + self.params[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.params[2] + self.params[3]

    def gradient(self, x: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
        z, h = self.hidden(x)
        back = by_output[:, None] * self.params[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ by_output, np.array([by_output.sum()])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 7) -> Network:
    """Minimises the non-negative unbiased risk (Kiryo et al., 2017) with logistic loss.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second part of a batch is negative its
    gradient is reversed, so that the network doesn't fit unlabelled positives as negatives.
    """
    net, rng = Network(np.concatenate([positive, unlabelled]), seed=seed), np.random.default_rng(seed)
    m, v, t = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params], 0
    steps = max(1, -(-max(len(positive), len(unlabelled)) // batch))
    for _ in range(max(rounds, -(-1500 // steps))):
        for _ in range(steps):
            p, u = positive[rng.integers(len(positive), size=batch)], unlabelled[rng.integers(len(unlabelled), size=batch)]
            gp, gu = net(p), net(u)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                by_p = (-prior * _sigmoid(-gp) - prior * _sigmoid(gp)) / batch
                by_u = _sigmoid(gu) / batch
            else:
                by_p, by_u = prior * _sigmoid(gp) / batch, -_sigmoid(gu) / batch
            grads = [a + b + 1e-4 * w for a, b, w in zip(net.gradient(p, by_p), net.gradient(u, by_u), net.params, strict=True)]
            t += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                net.params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives among unlabelled rows.

    A network tells positives from unlabelled rows on one half of each; on the other half, the share of unlabelled rows above a score, over that of positives,
    is at least the prior for every score and near it where only positives are left: the least such ratio (with
    a margin for small counts) is the estimate, as in best-bin estimation.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    net = fit_pu(positive[:half_p], unlabelled[:half_u], 0.5, rounds=20, seed=seed)
    p, u = np.sort(net(positive[half_p:])), np.sort(net(unlabelled[half_u:]))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    margin = np.sqrt(1 / len(p)) + np.sqrt(1 / len(u))
    return float(np.clip((above_u / above_p + margin / above_p).min() - margin, 0.05, 0.98))


class Judge:
    """Scores of texts: the network's output over the level that scores 0.5."""

    def __init__(self, net: Network | None, half: float = 0.0):
        self.net, self.half = net, half

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.net is None else _sigmoid(self.net(x) - self.half)

    def score(self, batch: pa.RecordBatch, column: int) -> np.ndarray:
        parts = [self(text_features(data, offsets)) for _, data, offsets in text_slices(batch, column)]
        return np.concatenate(parts) if parts else np.zeros(0)


def train_judge(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> Judge:
    """The classifier from positives that labels (id, quality) marks 1 outside the held-out fold, and unlabelled rows of all of df.

    Both samples hold at most sample_rows rows, those of least hash; with fewer than four of either every score is 0.5.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = labels.where((F.col("quality") == 1) & (remainder(F.col("id"), folds) != held_out)).select("id").distinct()
    # trusted ids of least hash are enough where texts have sample_rows of them: then what is sent doesn't grow with the labels
    near = least_hash_part(trusted, "id", 4 * sample_rows, 5)
    known = join_narrow(src, near, "id", "left_semi")
    if near is not trusted and known.limit(sample_rows).count() < sample_rows:
        known = join_narrow(src, trusted, "id", "left_semi")
    draw = lambda t: np.array([r.x for r in least_hash_rows(t, "id", sample_rows, 5, "x", then=features)], np.float64).reshape(-1, len(NAMES))
    positive, unlabelled = draw(known), draw(src)
    if min(len(positive), len(unlabelled)) < 4:
        return Judge(None)
    net = fit_pu(positive, unlabelled, estimate_prior(positive, unlabelled))
    return Judge(net, level(net, positive))


def quality(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score), one row per row of df; score in (0, 1), higher is likelier good.

    held_out: crc32(id) mod folds is held_out; the labels of such rows teach nothing. Whole texts are scored, null and empty ones as features of 0. The
    thousandth part of the trusted positives with the least output ends at 0.5.
    """
    judge = train_judge(df, labels, id_col, text_col, folds, held_out, sample_rows)
    src = df.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(judge.score(batch, 2))], ["id", "held_out", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, held_out boolean, score double")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, cut: float = CUT) -> DataFrame:
    """The rows of df whose score is at least cut, all columns as they are."""
    judge = train_judge(df, labels, id_col, text_col)
    return filter_texts(df, text_col, lambda: lambda batch, at: judge.score(batch, at) >= cut)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents; null and empty texts have features of 0, repeated rows stay, labels other than 1 teach nothing."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    found = quality(table(spark, sf_dir, "documents"), labels, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
