"""Quality rules: text statistics, fixed limits, and a decision list learned by sequential covering.

All work is DataFrame expressions. The statistics of a text are worked out inside its row. Rules are
learned from a written table of the labelled rows' statistics: each step asks Spark for the counts of
good and bad rows behind every candidate threshold at once, and only those counts, a fixed number, reach
the driver. A rule is grown as a conjunction of thresholds on the growing rows, pruned on the others, and
the list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tellsift.llm.common import SPACE, cut_lineage, whole_row, words
from tellsift.operators.common import computed

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Statistics per text that rules may ask about; counts as shares, so that they mean the same in any length.
RATIOS = ("mean_chars", "symbol_share", "dup_line_share", "repeat_share", "n_words")
QUANTILES = [i / 32 for i in range(1, 32)] + [0.985, 0.995]


def _sorted_windows(hashes: Column) -> Column:
    """(hash, place) of the windows in order of hash, for a text in which some hash occurs again; else none."""
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(repeats, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_places(placed: str) -> Column:
    """Places, in order, of the windows whose hash stands beside an equal one in the column ``placed``."""
    at = lambda i: F.get(F.col(placed), i)["h"]
    again = F.filter(
        F.col(placed),
        lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def _covered(starts: str) -> Column:
    """Words covered by windows at the places in the column ``starts``: a window adds what the one before left."""
    added = F.transform(
        F.col(starts), lambda x, i: F.least(x - F.coalesce(F.get(F.col(starts), i - 1), F.lit(-WINDOW)), F.lit(WINDOW))
    )
    return F.aggregate(added, F.lit(0), lambda s, x: s + x)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to ``df``.

    Words: ``[^\\x20\\x09-\\x0D]+``. word_chars: their code points. n_symbols: characters of ``#*$%&|<>``.
    n_dup_lines: lines that hold a word and equal an earlier line. n_repeat_words: words in 5-word windows
    found twice or more in the text, the first included. Null, empty and blank texts: all 0. Windows are
    compared by 64-bit hash. Columns of ``df`` with these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    base = computed(df, _words=words(F.col(text)), _lines=lines)
    hashes = F.when(
        F.size("_words") > WINDOW - 1,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<long>"))
    base = computed(base, _hashes=hashes)
    base = computed(base, _placed=_sorted_windows(F.col("_hashes")))
    base = computed(base, _starts=_repeated_places("_placed"))
    length = F.char_length(whole)
    return base.select(
        *[f"`{c}`" for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(whole, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered("_starts").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Fewer than 10 words, or over 20 % of the words repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_chars": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / n, "repeat_share": F.col("n_repeat_words") / n, "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Threshold:
    """``feature`` above (or not above) ``value``."""

    feature: str
    above: bool
    value: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


@dataclass
class DecisionList:
    """Rules in order; each rejects the rows for which all its thresholds hold. Others are kept."""

    rules: list[tuple[Threshold, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            verdict = F.when(_all(rule), False) if verdict is None else verdict.when(_all(rule), False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def _all(rule) -> Column:
    out = F.lit(True)
    for threshold in rule:
        out = out & threshold.holds()
    return out


def _counts(rows: DataFrame, conditions: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows behind each condition, in one pass."""
    sums = [F.count_if(c & (F.col("_bad") == flag)) for c in conditions for flag in (True, False)]
    got = rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
    return [(got[2 * i], got[2 * i + 1]) for i in range(len(conditions))]


def learn_rules(
    labelled: DataFrame, bad: str = "_bad", grow: str = "_grow", features: tuple[str, ...] = RATIOS,
    max_rules: int = 8, max_terms: int = 4, precision: float = 0.99, least: int = 5,
) -> DecisionList:
    """Sequential covering of the rows where ``bad`` holds.

    Candidate thresholds: the features' quantiles among all rows and among bad rows. A rule grows by the
    threshold with the best FOIL gain on rows where ``grow`` holds, until it covers no good row; then terms are
    dropped from its end while the rows held back give no lower precision. It joins the list if ``precision``
    of the held-back rows it covers are bad and it covers ``least`` bad rows in all; the rows it covers leave the
    table, and learning ends with the first rule that doesn't. No labelled rows, or none of one kind: no rules.
    """
    rows = cut_lineage(labelled.select(*features, F.col(bad).alias("_bad"), F.col(grow).alias("_grow")))
    spots: dict[str, list[float]] = {}
    for part in (rows, rows.where("_bad")):
        got = part.agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in features]).first()
        for f in features:
            spots[f] = sorted({*spots.get(f, []), *(got[f] or [])})
    terms = [Threshold(f, above, v) for f in features for v in spots[f] for above in (True, False)]
    found = DecisionList()
    while len(found.rules) < max_rules and terms:
        rule: list[Threshold] = []
        growing = rows.where("_grow")
        p0, n0 = _counts(growing, [F.lit(True)])[0]
        if not p0 or not n0 and found.rules:
            break
        while n0 and len(rule) < max_terms:
            counts = _counts(growing.where(_all(rule)), [t.holds() for t in terms])
            gain = lambda c: c[0] * (_log2(c[0] / (c[0] + c[1])) - _log2(p0 / (p0 + n0))) if c[0] else float("-inf")
            best = max(range(len(terms)), key=lambda i: gain(counts[i]))
            if gain(counts[best]) <= 0:
                break
            rule.append(terms[best])
            p0, n0 = counts[best]
        if not rule:
            break
        cuts = [rule[: i + 1] for i in range(len(rule))]
        held, everywhere = _counts(rows.where("not _grow"), [_all(c) for c in cuts]), _counts(rows, [_all(c) for c in cuts])
        worth = [(p + 1) / (p + n + 2) for p, n in held]
        pick = max(range(len(cuts)), key=lambda i: (worth[i], -i))
        p, n = held[pick]
        if p < precision * (p + n) or everywhere[pick][0] < least or everywhere[pick][0] < precision * sum(everywhere[pick]):
            break
        found.rules.append(tuple(cuts[pick]))
        rows = cut_lineage(rows.where(~_all(cuts[pick])))
    return found


def _log2(x: float) -> float:
    from math import log2

    return log2(x) if x > 0 else float("-inf")


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DecisionList:
    """Rules for rows of quality 0 that the fixed limits let pass; a key with any label 1 is good.

    A third of the keys, by hash, is held back for pruning.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        (F.max(quality) == 0).alias("_bad")
    )
    known = stats.join(marks, F.col(key) == F.col("_key")).where(~base_failed())
    table = known.select("_bad", (F.pmod(F.xxhash64("_key"), F.lit(3)) > 0).alias("_grow"), *[c.alias(n) for n, c in ratios().items()])
    return learn_rules(table)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", with_rows: bool = False) -> DataFrame:
    """The key, the five statistics, base_failed and kept; with ``with_rows`` the whole input row as ``row``.

    The statistics of all rows are written down once, without the texts, and meet the labels there: texts
    are never shuffled. ``with_rows`` works them out again beside the rows. Rules are learned from the labels
    given; without labels only the fixed limits reject. Rows without a key are judged like others. Texts
    without a word fail the fixed limits. Empty table: no rows.
    """
    ids = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    narrow = cut_lineage(text_statistics(ids, "_text").drop("_text"))
    rules = train(narrow.withColumnRenamed("_id", key), labels, key)
    stats = text_statistics(df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), whole_row(df).alias("row")), "_text") if with_rows else narrow
    verdict = stats.withColumns({f"_{n}": c for n, c in ratios().items()})
    named = DecisionList([tuple(Threshold(f"_{t.feature}", t.above, t.value) for t in rule) for rule in rules.rules])
    failed = base_failed()
    return verdict.select(
        F.col("_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & named.kept()).alias("kept"), *(["row"] if with_rows else []),
    )
