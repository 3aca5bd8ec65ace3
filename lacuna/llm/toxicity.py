"""Toxicity: class-conditional Kneser-Ney models over the characters of words, compared per length."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rawimage import located
from .common import filter_texts, free_name, join_narrow, least_hash_rows, materialise, small_batches, small_slices, store, table

#: Characters of an n-gram at most, and up to how many the counts are shared by both classes.
ORDER, SHARED = 4, 2
DISCOUNT = 0.9
#: Pads the start of a word and ends it; neither is a word character.
START, END = "\x02", "\x03"
#: What of a text's words is compared: windows of so many words (greatest mean log ratio), so many of its distinct words of greatest ratio (their mean),
#: and words over these ratios (their share, and the logarithm of their number).
WINDOWS, TOP, OVER = (1, 4, 16, 64), (2, 4), (1.0, 2.0, 3.0)
N_FEATURES = 1 + len(WINDOWS) + len(TOP) + 2 * len(OVER)
#: Entries of the models, or of words' ratios, that every task reads whole at most; models of more stay tables, which the words meet in joins.
MODEL_ROWS = 1_500_000
#: Labelled rows that the final calibration is fitted on at most, and the score that a toxic document should reach.
CALIBRATION_ROWS, CUT = 20_000, 0.7
#: Log ratio of a word that a text doesn't have.
ABSENT = -3.0
#: Remembered words per task.
CACHE = 400_000
#: Characters of a word that is its own key in tables; longer ones go by a digest.
KEY_CHARS = 40
WORD = re.compile(r"\w+")


#: Characters of a text that are split into words at a time, and distinct words that a counting task holds.
PIECE, HELD_WORDS = 1 << 20, 300_000
_NO_WORD = re.compile(r"\W")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in order, lower-cased, in lists of one piece of it each."""
    at = 0
    while at < len(text):
        border = _NO_WORD.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = border.start() if border else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(w, c if k == 0 else 0, c if k == 1 else 0) for k in (0, 1) for w, c in counts[k].items()]
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 50_000], strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["word", "c0", "c1"])
        for c in counts:
            c.clear()

    for batch in small_slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(set().union(*words_of(text or "")))
        if sum(map(len, counts)) > HELD_WORDS:
            yield from flush()
    yield from flush()


def word_counts(df: DataFrame) -> DataFrame:
    """(word, c0, c1) over all rows of df (text, label 0 or 1): in how many texts of each class each word stands.

    Texts, not occurrences, so that one text that repeats itself weighs no more than another.
    """
    return df.mapInArrow(_count, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def gram_counts(words: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """Per order n (gram, c0, c1, c): the counts of each class, and of both pooled. The top order counts occurrences; lower ones, as Kneser and Ney do, the distinct
    characters before the gram (pooled: in either class, each once), but for grams at a word's start, which nothing else precedes: those keep occurrences."""
    padded = F.concat(F.lit(START * (order - 1)), "word", F.lit(END))
    starts = F.sequence(F.lit(1), F.length("word") + 1)
    grams = words.select(F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"), "c0", "c1")
    at = materialise(grams.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).withColumn("c", F.col("c0") + F.col("c1")))
    occurrences, out, names = at, {order: at}, ("c0", "c1", "c")
    for n in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, n).alias("gram")
        each = lambda f: [f(c).alias(c) for c in names]
        occurrences = occurrences.select(shorter, *names).groupBy("gram").agg(*each(F.sum))
        kinds = out[n + 1].select(shorter, *[(F.col(c) > 0).cast("long").alias(c) for c in names]).groupBy("gram").agg(*each(F.sum))
        initial = F.col("gram").startswith(START)
        out[n] = materialise(kinds.where(~initial).unionByName(occurrences.where(initial)))
    return out


def _level(counts: DataFrame, lower: DataFrame | None, shared: bool, discount: float) -> DataFrame:
    """(gram, p0, p1, g0, g1): interpolated probabilities of the gram's last character, and its context's backoff weights.

    Below the lowest order stands an even chance of each character seen and of one that stands for all others, so that the probabilities after any context sum to 1.
    """
    if shared:
        counts = counts.select("gram", F.col("c").alias("c0"), F.col("c").alias("c1"))
    counts = counts.withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)"))
    tot = counts.groupBy("ctx").agg(*[F.sum(c).alias(f"t{c[1]}") for c in ("c0", "c1")], *[F.sum(F.least(F.col(c), F.lit(1))).alias(f"n{c[1]}") for c in ("c0", "c1")])
    at = counts.join(tot, "ctx")
    if lower is None:
        even = 1 / (counts.count() + 1)  # of the lowest order each gram is a character
        at = at.withColumn("b0", F.lit(even)).withColumn("b1", F.lit(even))
    else:
        below = lower.select(F.col("gram").alias("rest"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        at = at.withColumn("rest", F.expr("substring(gram, 2)")).join(below, "rest")
    weight = lambda k: F.when(F.col(f"t{k}") > 0, discount * F.col(f"n{k}") / F.col(f"t{k}")).otherwise(1.0)
    first = lambda k: F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - discount, F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0)
    return at.select("gram", "ctx", *[(first(k) + weight(k) * F.col(f"b{k}")).alias(f"p{k}") for k in (0, 1)], *[weight(k).alias(f"g{k}") for k in (0, 1)])


def levels(counts: dict[int, DataFrame], shared: int = SHARED, discount: float = DISCOUNT) -> dict[int, DataFrame]:
    """_level() of each order, from the lowest up."""
    out: dict[int, DataFrame] = {}
    for n in sorted(counts):
        out[n] = materialise(_level(counts[n], out.get(n - 1), n <= shared, discount))
    return out


def text_row(values: Sequence[float], distinct: Iterable[float]) -> list[float]:
    """The N_FEATURES numbers of a text with words: from the log ratios of its words in order, and of its distinct words."""
    all_, n = np.array(values), len(values)
    sums = np.concatenate(([0.0], np.cumsum(all_)))
    row = [sums[-1] / n]
    row += [(sums[min(k, n) :] - sums[: -min(k, n)]).max() / min(k, n) for k in WINDOWS]
    best = heapq.nlargest(max(TOP), distinct)
    best += [ABSENT] * (max(TOP) - len(best))
    row += [sum(best[:k]) / k for k in TOP]
    for least in OVER:
        above = int((all_ > least).sum())
        row += [above / n, np.log1p(above)]
    return row


class Model:
    """Log ratios (toxic to ordinary) of seen grams and of contexts' backoff weights, for words."""

    def __init__(self, ratios: dict[str, float], backoffs: dict[str, float], order: int, shared: int):
        self.ratios, self.backoffs, self.order, self.shared = ratios, backoffs, order, shared

    def word(self, word: str) -> float:
        """The sum over the word's characters (and its end) of log p(toxic) - log p(ordinary)."""
        text, total = START * (self.order - 1) + word + END, 0.0
        for end in range(self.order, len(text) + 1):
            for n in range(self.order, self.shared, -1):
                gram = text[end - n : end]
                found = self.ratios.get(gram)
                if found is not None:
                    total += found
                    break
                total += self.backoffs.get(gram[:-1], 0.0)
        return total

    def features(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Per text N_FEATURES numbers, all 0 without words: the mean log ratio of all words, then what WINDOWS, TOP and OVER say. A text shorter than a window is one."""
        out = np.zeros((len(texts), N_FEATURES))
        for i, text in enumerate(texts):
            values, distinct = array("d"), {}
            for words in words_of(text or ""):
                if len(cache) > CACHE:
                    cache.clear()
                for w in words:
                    v = cache.get(w)
                    if v is None:
                        v = cache[w] = self.word(w)
                    values.append(v)
                distinct.update((w, cache[w]) for w in set(words))
            if values:
                out[i] = text_row(values, distinct.values())
        return out

    def apply(self, df: DataFrame, what: Callable[[np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
        """df (text last) with `name` of Spark type `kind` for the text: what(features) of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, float] = {}
            for batch in small_slices(batches):
                found = what(self.features(batch.column(batch.num_columns - 1).to_pylist(), cache))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], name])

        return df.mapInArrow(run, _schema(df.drop("text"), name, kind))


@functools.lru_cache(maxsize=1)
def entries(path: str) -> dict[str, dict[str, float]]:
    """Per kind the numbers by key of a table (kind, key, value) that store() wrote. A worker reads it once and keeps the last one."""
    fs, root = located(path)
    out: dict[str, dict[str, float]] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if not info.base_name.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as f:
            for batch in pyarrow.parquet.ParquetFile(f).iter_batches(1 << 16):
                for kind, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.setdefault(kind, {})[key] = value
    return out


class StoredModel(Model):
    """As Model, with its entries in a table below the shared folder (see entries): workers read them there, so neither the driver nor what it sends holds any."""

    def __init__(self, path: str, order: int, shared: int):
        self.path, self.order, self.shared = path, order, shared

    ratios = functools.cached_property(lambda self: entries(self.path).get("ratio", {}))
    backoffs = functools.cached_property(lambda self: entries(self.path).get("backoff", {}))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ratios", "backoffs")}


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} {kind}"])


def word_key(word: str) -> str:
    return word if len(word) <= KEY_CHARS else START + hashlib.md5(word.encode()).hexdigest()


class TableModel:
    """As Model, where grams are more than can be sent: nothing is dropped, the distinct words' grams meet the tables in joins.

    tables has (n, gram, r) and (ctx, b) of each order above shared, from the top down.
    """

    def __init__(self, tables: list[tuple[int, DataFrame, DataFrame]], order: int, model_rows: int):
        self.tables, self.order, self.model_rows = tables, order, model_rows

    def word_values(self, words: DataFrame) -> DataFrame:
        """(key, c, v) of words (word, c), each word once: v is what Model.word gives."""
        padded = F.concat(F.lit(START * (self.order - 1)), "word", F.lit(END))
        key = F.when(F.length("word") <= KEY_CHARS, F.col("word")).otherwise(F.concat(F.lit(START), F.md5(F.col("word").cast("binary"))))
        grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(self.order)))
        placed = words.select(key.alias("key"), "c", F.posexplode(grams).alias("at", "gram"))
        told, value, found = placed.select("gram").distinct(), F.lit(0.0), []
        for n, ratios, backoffs in self.tables:
            gram = F.substring("gram", self.order - n + 1, n)
            told = told.withColumn("_g", gram).withColumn("_x", F.substring("_g", 1, n - 1))
            told = told.join(ratios.select(F.col("gram").alias("_g"), F.col("r").alias(f"_r{n}")), "_g", "left").join(backoffs.select(F.col("ctx").alias("_x"), F.col("b").alias(f"_b{n}")), "_x", "left").drop("_g", "_x")
            found.append(n)
        for n in reversed(found):
            value = F.coalesce(F.col(f"_r{n}"), F.coalesce(F.col(f"_b{n}"), F.lit(0.0)) + value)
        parts = placed.join(told.select("gram", value.alias("v")), "gram").groupBy("key", "c").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("parts"))
        return parts.select("key", "c", F.aggregate("parts", F.lit(0.0), lambda total, x: total + x["v"]).alias("v"))

    def apply(self, df: DataFrame, what: Callable[[np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
        """As Model.apply. Values of the words that stand in most texts, model_rows at most, are read by every task; a text's other words, none of which is in many texts, are
        joined with theirs by key, with the places where they stand."""
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
        words = word_counts(rows.select("text", F.lit(0).alias("label"))).select("word", F.col("c0").alias("c"))
        values = materialise(self.word_values(words))
        path = store(values.orderBy(F.desc("c"), "key").limit(self.model_rows).select(F.lit("word").alias("kind"), "key", F.col("v").alias("value")))

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = entries(path).get("word", {})
            for batch in small_slices(batches):
                out = []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    places: dict[str, list[int]] = {}
                    for at, w in enumerate(itertools.chain.from_iterable(words_of(text or ""))):
                        places.setdefault(word_key(w), []).append(at)
                    known = [k for k in places if k in sent]
                    out.append((row, None, [sent[k] for k in known], [places[k] for k in known]))
                    out += [(row, k, None, [at]) for k, at in places.items() if k not in sent]
                kinds = (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())))
                for lo in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[lo : lo + 4096], strict=True), kinds, strict=True)], ["_row", "key", "known", "places"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_slices(batches):
                x = np.zeros((len(batch), N_FEATURES))
                for i, parts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    distinct = [v for p in parts for v in p["known"]]
                    places = [at for p in parts for at in p["places"]]
                    if distinct:
                        ordered = [0.0] * sum(map(len, places))
                        for v, at in zip(distinct, places, strict=True):
                            for k in at:
                                ordered[k] = v
                        x[i] = text_row(ordered, distinct)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], what(x)], [*batch.schema.names[:-1], name])

        spelt = rows.select("_row", "text").mapInArrow(spell, "_row long, key string, known array<double>, places array<array<int>>")
        met = spelt.join(values.select("key", "v"), "key", "left").select("_row", F.struct(F.coalesce("known", F.array("v")).alias("known"), "places").alias("part"))
        parts = met.groupBy("_row").agg(F.collect_list("part").alias("parts"))
        back = rows.drop("text").join(parts, "_row").drop("_row")
        return back.mapInArrow(gather, _schema(back.drop("parts"), name, kind))


def train_models(labelled: DataFrame, order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT, model_rows: int = MODEL_ROWS) -> Model | TableModel:
    """The two models from all rows of labelled (text, label 0 or 1); see models_of."""
    return models_of(materialise(word_counts(labelled)), order, shared, discount, model_rows)


def models_of(words: DataFrame, order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT, model_rows: int = MODEL_ROWS) -> Model | TableModel:
    """The two models from words (word, c0, c1), each word once.

    Both classes have their own discounted counts above order `shared` and back off to one distribution of pooled counts below, so that what only
    one class has seen, or neither, is judged by common shorter pieces. Counting and all probabilities are DataFrame
    aggregations and joins; the tables that every task would read whole are measured first, and where they exceed model_rows they are joined. All
    counted grams are kept either way. No rows give ratios of 0.
    """
    tables = [t for n, t in levels(gram_counts(words, order), shared, discount).items() if n > shared]
    ratio = lambda a, b, name: (F.log(a) - F.log(b)).cast("float").cast("double").alias(name)
    told = [(t.select("gram", ratio(F.col("p1"), F.col("p0"), "r")), t.select("ctx", ratio(F.col("g1"), F.col("g0"), "b")).distinct()) for t in tables]
    if sum(t.count() for t in tables) > model_rows:
        return TableModel([(n, materialise(r), materialise(b)) for n, (r, b) in reversed([*enumerate(told, shared + 1)])], order, model_rows)
    parts = [t.toDF("key", "value").select(F.lit(kind).alias("kind"), "key", "value") for pair in told for kind, t in zip(("ratio", "backoff"), pair, strict=True)]
    return StoredModel(store(functools.reduce(DataFrame.unionByName, parts).repartition(8)), order, shared)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) of a logistic regression by Newton steps, classes weighted alike."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (p - y)) + l2 * w
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return mean, scale, w


def cut_for(scores: np.ndarray, y: np.ndarray) -> float:
    """The score whose cut gives the best F1 on labelled rows, midway to the next lower one."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], y[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # ties can't be parted
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6


class Scorer:
    """Features to a score in (0, 1) that passes `cut` where the calibration rows are parted best."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cut: float):
        self.fit = fit_logistic(x, y) if len(set(y.tolist())) == 2 else None
        self.shift, self.cut = 0.0, cut
        if self.fit:
            self.shift = np.log(cut / (1 - cut)) - cut_for(self._logit(x), y)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w = self.fit
        return np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.full(len(x), 0.5 * self.cut)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) + self.shift, -30, 30)))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; of '' for a null key."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Detector:
    """A model and the scorer of its features."""

    def __init__(self, model: Model | TableModel, scorer: Scorer):
        self.model, self.scorer = model, scorer

    def score(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        return self.scorer(self.model.features(texts, cache))

    def scores(self, df: DataFrame) -> DataFrame:
        """df (text last) with a score for the text."""
        scorer = self.scorer
        return self.model.apply(df, lambda x: pa.array(scorer(x)), "score", "double")


def train_detector(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, cut: float = CUT, folds: int = 3, held_out: int = 1, calibration_rows: int = CALIBRATION_ROWS, model_rows: int = MODEL_ROWS) -> Detector:
    """The detector from labels (id, toxic: 0 or 1; others and null don't count) of rows outside the held-out fold.

    For calibration, models of three quarters of the rows (by a hash of the id) judge the last quarter, calibration_rows rows of least
    hash at most, so that `cut` parts the classes best. The models that score are then those of all rows. A repeated id counts as often as it stands.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("id"), folds) != held_out)).select("id", F.col("toxic").cast("int").alias("label"))
    quarter = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4))
    taught = join_narrow(src, known, "id").select("id", "text", "label", quarter.alias("quarter"))
    counted = lambda apart: word_counts(taught.where((F.col("quarter") == 0) == apart).select("text", "label"))
    words = materialise(counted(False))
    model = models_of(words, model_rows=model_rows)
    features = lambda t, model=model: model.apply(t.select("id", "label", "text"), lambda x: pa.array(list(x), pa.list_(pa.float64())), "x", "array<double>")
    rows = least_hash_rows(taught.where("quarter = 0").select("id", "label", "text"), "id", calibration_rows, 3, "label", "x", then=features)
    both = words.unionByName(counted(True)).groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    model = models_of(materialise(both), model_rows=model_rows)
    return Detector(model, Scorer(np.array([r.x for r in rows]).reshape(len(rows), N_FEATURES), np.array([r.label for r in rows], float), cut))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, cut: float = CUT, folds: int = 3, held_out: int = 1, calibration_rows: int = CALIBRATION_ROWS, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id, held_out, score), one row per row of df; score in (0, 1), higher is likelier toxic.

    held_out: crc32(id) mod folds is held_out; the labels of such rows teach nothing (see train_detector). Whole texts are scored; null, empty and wordless ones
    have log ratio 0. Without labels of both classes every score is half of cut.
    """
    detector = train_detector(df, labels, id_col, text_col, cut, folds, held_out, calibration_rows, model_rows)
    src = df.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return detector.scores(src)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, cut: float = CUT, model_rows: int = MODEL_ROWS) -> DataFrame:
    """The rows of df whose score is under cut, all columns as they are."""
    detector = train_detector(df, labels, id_col, text_col, cut, model_rows=model_rows)
    if isinstance(detector.model, TableModel):
        at = free_name(df, "_at")
        rows = materialise(df.withColumn(at, F.monotonically_increasing_id()))
        kept = detector.scores(rows.select(F.col(at).alias("_at"), F.col(text_col).cast("string").alias("text"))).where(F.col("score") < cut)
        return rows.join(kept.select(F.col("_at").alias(at)), at).drop(at)

    def make():
        cache: dict[str, float] = {}
        return lambda batch, at: detector.score(batch.column(at).to_pylist(), cache) < cut

    return filter_texts(df, text_col, make)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents; null and wordless texts have a log ratio of 0, repeated rows stay, labels other than 0 and 1 teach nothing."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    found = toxicity(table(spark, sf_dir, "documents"), labels, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
