"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

The features are densities of a lexicon, how near its words stand to words of the second person, capitals, punctuation
and signs of obfuscation. The lexicon (words, and beginnings of words marked ``*``) is learned too: a term's weight is by
how much the log odds of label 1 rise in labelled texts that hold it, shrunk towards none by ``PRIOR`` texts. Features of
the texts that teach the trees come from the counts of the other folds, and the calibration from trees of other folds, so
neither sees its own labels.

Trees and lexicon are fitted on at most ``sample`` labelled rows, those of least md5 of the id; terms are counted and
features worked out by Spark, only the features of the sample (``sample`` rows) reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tellsift.llm.common import cut_lineage

SAMPLE, FOLDS, TERMS, PRIOR, LEAST = 30_000, 3, 3_000, 4.0, 3
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 48, 4.0
HIT, STRONG, NEAR, SPELLED = 1.5, 3.0, 5, 4
PREFIXES = range(4, 9)
#: Words a task remembers, and about how many it works on at once.
REMEMBERED, GROUP = 1 << 18, 1 << 17

# fixed values: words of the second person in English, French, Spanish and German
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur youre tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros "
    "vuestro du dich dir dein deine deinen deiner ihr euch euer eure".split()
)
#: Signs that stand for letters.
_FOLD = str.maketrans("013457@$!|", "oieastasil")
_PARTS = re.compile(r"[^\W_]+")
_LONG = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_MIXED = re.compile(r"[^\W\d_][\d@$*#%!|]+[^\W\d_]")
_TWICE = re.compile(r"([!?.,;:*#$%&])\1")
_SPACE = " \t\n\x0b\f\r"

FEATURES = (
    "log_words", "lexicon_sum", "lexicon_max", "hits", "hit_rate", "distinct_hits", "strong_rate", "hits_near_second_person", "second_person_rate",
    "capitals", "capital_words", "exclamations", "questions", "other_signs", "doubled_signs", "lengthened", "mixed", "disguised_hits", "spelled_out", "mean_letters",
)
# columns of a word's row
_WEIGHT, _TERM, _SECOND, _LETTERS, _UPPER, _CAPITAL, _EXCLAIM, _QUESTION, _OTHER, _DOUBLED, _LENGTHENED, _IS_MIXED, _DISGUISED, _LETTER = range(14)


def split(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    text = text or ""
    for gap in "\t\n\x0b\f\r":
        text = text.replace(gap, " ")
    return [w for w in text.split(" ") if w]


def terms(word: str) -> list[str]:
    """What the lexicon may know of a word: its runs of letters and digits and their beginnings."""
    out = []
    for part in [word.lower()] if word.isalpha() else _PARTS.findall(word.lower()):
        out.append(part[:64])
        out += [part[:k] + "*" for k in PREFIXES if k < len(part)]
    return out


class Words(dict):
    """From a word to its row in ``table``, for one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.number = lexicon, {term: i for i, term in enumerate(lexicon)}
        self.heads = {term[: PREFIXES[0]] for term in lexicon}
        self.table = np.zeros((0, 14), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        """Rows for the words that have none."""
        new = set(words) - self.keys()
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.table = np.concatenate([self.table, np.array([self.row(word) for word in new], dtype=np.float32)])

    def best(self, word: str) -> tuple[float, int]:
        if word.isalpha() and word.lower()[: PREFIXES[0]] not in self.heads:
            return 0.0, -1
        found = [t for t in terms(word) if t in self.lexicon]
        return max(((self.lexicon[t], self.number[t]) for t in found), default=(0.0, -1))

    def row(self, word: str) -> tuple:
        core = word.rstrip(".,;:!?")
        weight, term = self.best(core)
        lengthened = bool(_LONG.search(core))
        exclaim, question = word.count("!"), word.count("?")
        if core.isalpha():  # most words: no sign stands for a letter
            letters, upper = len(core), 0 if core.islower() else sum(map(str.isupper, core))
            other, doubled, mixed, disguised = len(word) - letters, len(word) - letters > 1 and bool(_TWICE.search(word)), False, False
            second = core.lower() in SECOND_PERSON
        else:
            letters, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
            other, doubled, mixed = len(word) - sum(map(str.isalnum, word)), bool(_TWICE.search(word)), bool(_MIXED.search(word))
            second = any(p in SECOND_PERSON for p in _PARTS.findall(word.lower()))
            disguised = False
        if weight < HIT and (lengthened or not core.isalpha()):
            folded = re.sub(r"[*_.\-]", "", word.translate(_FOLD))
            found = self.best(_LONG.sub(r"\1", folded))
            disguised = found[0] >= HIT
            weight, term = max((weight, term), found)
        return (
            weight, term, second, letters, upper, letters > 2 and upper == letters, exclaim, question, other - exclaim - question, doubled,
            lengthened, mixed, disguised, letters == 1 and len(word) == 1,
        )


def _spelled(words: list[str], single: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Runs of ``SPELLED`` or more single letters within a row: first and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    found = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while a < b:
            stop = min(b, int(np.searchsorted(row, row[a], "right")))
            if stop - a >= SPELLED:
                found.append((a, stop))
            a = stop
    return found


def features(texts: list[str | None], words: Words) -> np.ndarray:
    """One row of ``FEATURES`` for each text; zeros for a null or blank one."""
    out = np.zeros((len(texts), len(FEATURES)))
    lists = [split(t) for t in texts]
    size = np.array([len(x) for x in lists])
    if not size.sum():
        return out
    flat = [w for x in lists for w in x]
    words.learn(flat)
    ids = np.fromiter(map(words.__getitem__, flat), dtype=np.int64, count=len(flat))
    row = np.repeat(np.arange(len(texts)), size)
    table = words.table[ids]
    weight, term = table[:, _WEIGHT], table[:, _TERM].astype(np.int64)
    spelled = np.zeros(len(texts))
    for a, b in _spelled(flat, table[:, _LETTER] > 0, row):
        spelled[row[a]] += b - a
        found = words.best("".join(flat[a:b]))
        if found[0] > weight[a]:
            weight[a], term[a] = found
            table[a, _DISGUISED] = found[0] >= HIT
    total = lambda x: np.bincount(row, weights=x, minlength=len(texts))
    n = np.maximum(size, 1)
    hit, second = weight >= HIT, np.flatnonzero(table[:, _SECOND] > 0)
    near = np.zeros(len(flat), dtype=bool)
    at = np.flatnonzero(hit)
    if len(second) and len(at):
        k = np.searchsorted(second, at)
        for beside in (second[np.maximum(k - 1, 0)], second[np.minimum(k, len(second) - 1)]):
            near[at] |= (np.abs(beside - at) <= NEAR) & (row[beside] == row[at])
    kinds = np.unique(np.stack([row[at], term[at]]), axis=1)[0]
    some = np.flatnonzero(size)
    peak = np.zeros(len(texts))
    peak[some] = np.maximum.reduceat(weight, (np.cumsum(size) - size)[some])
    letters = total(table[:, _LETTERS])
    columns = (
        np.log1p(size), total(np.where(weight > 0, weight, 0)) / n, peak, np.log1p(total(hit)), total(hit) / n, np.log1p(np.bincount(kinds, minlength=len(texts))),
        total(weight >= STRONG) / n, np.log1p(total(near)), total(table[:, _SECOND]) / n, total(table[:, _UPPER]) / np.maximum(letters, 1),
        *(total(table[:, c]) / n for c in (_CAPITAL, _EXCLAIM, _QUESTION, _OTHER, _DOUBLED, _LENGTHENED, _IS_MIXED, _DISGUISED)), spelled / n, letters / n,
    )
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Boosted trees of equal depth: of each tree the features and limits of its inner nodes, level by level, and its leaves."""

    base: float
    chosen: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for chosen, limits, leaves in zip(self.chosen, self.limits, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, chosen[node]] > limits[node])
            out += leaves[node - len(chosen)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over histograms of at most ``BINS`` values a feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    # most rows may share one value; the others are told apart by their own quantiles
    edges = [np.unique(np.concatenate([e, np.quantile(x[x[:, j] != 0, j], np.linspace(0, 1, BINS + 1)[:-1]) if (x[:, j] != 0).any() else e])) for j, e in enumerate(edges)]
    bins = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rate = (y.sum() + 0.5) / (n + 1)
    margin = np.full(n, np.log(rate / (1 - rate)))
    trees = Trees(float(margin[0]) if n else 0.0, *(np.zeros((TREES, 2**DEPTH - 1), t) for t in (np.int64, float)), np.zeros((TREES, 2**DEPTH)))
    cell = binned + np.arange(width) * bins
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            index = (cell + ((node - first) * width * bins)[:, None]).ravel()
            sums = [np.bincount(index, np.repeat(v, width), many * width * bins).reshape(many, width, bins) for v in (g, h)]
            left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            gain = sum(a * a / (b + LEAF) for a, b in ((left[0], left[1]), (whole[0] - left[0], whole[1] - left[1])))
            best = gain.reshape(many, -1).argmax(axis=1)
            feature, cut = best // (bins - 1), best % (bins - 1)
            for k in range(many):
                e = edges[feature[k]]
                trees.chosen[t, first + k] = feature[k]
                trees.limits[t, first + k] = e[cut[k]] if cut[k] < len(e) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), trees.chosen[t, node]] > trees.limits[t, node])
        leaf = node - (2**DEPTH - 1)
        sums = [np.bincount(leaf, v, 2**DEPTH) for v in (g, h)]
        trees.leaves[t] = -RATE * sums[0] / (sums[1] + LEAF)
        margin += trees.leaves[t, leaf]
    return trees


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and rising heights, between which values are interpolated."""
    values, place = np.unique(x, return_inverse=True)
    weight = np.bincount(place).astype(float)
    blocks: list[list[float]] = []
    for v, w, s in zip(values, weight, np.bincount(place, weights=y)):
        blocks.append([w, s, v * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    w, s, at = np.array(blocks).T
    return at / w, s / w


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    places: np.ndarray
    heights: np.ndarray
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.interp(self.trees.margin(x), self.places, self.heights)


def _grouped(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of runs of rows with about ``GROUP`` words."""
    found = texts.to_pylist()
    at = 0
    while at < len(found):
        stop, size = at, 0
        while stop < len(found) and size < 6 * GROUP:
            size += len(found[stop] or "")
            stop += 1
        yield at, found[at:stop]
        at = stop


def _term_counts(rows: DataFrame) -> DataFrame:
    """``term, fold, toxic, n``: labelled texts that hold the term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)
        known: dict[str, list[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (fold, toxic), found in counts.items():
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array(list(found), pa.string()), "fold": pa.array([fold] * len(found), pa.int32()),
                    "toxic": pa.array([toxic] * len(found), pa.int32()), "n": pa.array(list(found.values()), pa.int64()),
                })
            counts.clear()

        for batch in batches:
            for text, fold, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held: set[str] = set()
                for word in set(split(text)):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = terms(word)
                    held.update(found)
                counts[fold, toxic].update(held)
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield from out()
                if len(known) > REMEMBERED:
                    known.clear()
        yield from out()

    return rows.mapInArrow(work, "term string, fold int, toxic int, n long").groupBy("term").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{t}_{f}") for f in range(FOLDS) for t in (0, 1)]
    )


def _weight(ones: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    odds = (ones + PRIOR * rate) / (all_ - ones + PRIOR * (1 - rate))
    return np.log(odds) - np.log(rate / (1 - rate))


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on rows with label 0 or 1; others are left out. Equal texts belong to one fold. Without rows of both labels the
    score of every text is the share of label 1 (0 without rows)."""
    rows = labelled.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.where(F.col("_label").isin(0, 1))
    order = F.md5(F.concat_ws("|", F.col("_key").cast("string"), F.lit("toxicity")))
    many = rows.count()
    if many > sample:
        keyed = rows.select("_key", order.alias("_order")).orderBy("_order", "_key").limit(sample).agg(F.max("_order")).first()[0]
        rows = rows.where(order <= keyed)
    rows = cut_lineage(rows.select(F.col("_text"), F.pmod(F.crc32(F.col("_text").cast("binary")), F.lit(FOLDS)).cast("int").alias("_fold"), "_label"))
    found = rows.groupBy("_fold", "_label").count().collect()
    size = np.zeros((FOLDS, 2))
    for fold, toxic, n in found:
        size[fold, toxic] = n
    all_, ones = size.sum(), size[:, 1].sum()
    rate = float(ones / all_) if all_ else 0.0
    if not 0 < rate < 1:
        return Model({}, None, np.zeros(1), np.zeros(1), rate)

    total = lambda t: reduce(lambda a, b: a + b, [F.col(f"n{t}_{f}") for f in range(FOLDS)])
    odds = (total(1) + PRIOR * rate) / (total(0) + PRIOR * (1 - rate))
    counted = _term_counts(rows).where(total(1) >= LEAST).withColumn("_odds", odds).where(F.col("_odds") > 2 * rate / (1 - rate))
    counted = counted.orderBy(F.desc("_odds"), F.desc("n1_0"), "term").limit(TERMS).drop("_odds").toArrow().to_pydict()
    n = {t: np.array([counted[f"n{t}_{f}"] for f in range(FOLDS)], dtype=float).reshape(FOLDS, -1) for t in (0, 1)}
    lexicons = []
    for fold in range(FOLDS + 1):
        others = np.arange(FOLDS) != fold
        one, every = n[1][others].sum(axis=0), (n[0] + n[1])[others].sum(axis=0)
        share = size[others, 1].sum() / max(size[others].sum(), 1)
        weight = _weight(one, every, min(max(share, 1e-4), 1 - 1e-4))
        lexicons.append({t: float(w) for t, w in zip(counted["term"], weight) if w > 0})
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(lexicon) for lexicon in shared.value[:FOLDS]]
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fold in range(FOLDS):
                own = batch.filter(pa.array(folds == fold))
                for at, texts in _grouped(own.column(0)):
                    x = features(texts, words[fold])
                    yield pa.RecordBatch.from_pydict({
                        "fold": own.column(1).slice(at, len(texts)), "label": own.column(2).slice(at, len(texts)), "x": pa.array(list(x), pa.list_(pa.float64())),
                    })

    learned = rows.mapInArrow(work, "fold int, label int, x array<double>").toArrow()
    x = np.array(learned["x"].to_pylist()).reshape(-1, len(FEATURES))
    y, fold = learned["label"].to_numpy().astype(float), learned["fold"].to_numpy()
    order_ = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order_], y[order_], fold[order_]
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        margin[fold == f] = boost(x[fold != f], y[fold != f]).margin(x[fold == f]) if (fold != f).any() else 0
    return Model(lexicons[-1], boost(x, y), *isotonic(margin, y), rate)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Whole texts are scored; a null or blank text has the features of a text without words. Rows are judged each for
    itself, equal texts alike; other columns of the input are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model.lexicon)
        for batch in batches:
            for at, texts in _grouped(batch.column(len(keep))):
                if len(words) > REMEMBERED:
                    words = Words(model.lexicon)
                found = np.clip(model.score(features(texts, words)), 0, 1)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(work, T.StructType(fields))
