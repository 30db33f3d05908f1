"""Sample filings and sentences for annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tellsift.functions.words import CR_LABELS, PR_LABELS
from tellsift.operators import sampling, tables
from tellsift.operators.sentences import to_sentences

LABELS_OF = {"CR": CR_LABELS, "PR": PR_LABELS}


def sentences_to_label(
    filings: DataFrame,
    form_label: str,
    ciks: DataFrame | None = None,
    nmax: int | None = 110,
    nsents: int | None = 4,
    text_col: str = "filtered_text",
    lang: str | None = "en",
) -> tuple[DataFrame, DataFrame]:
    """Firms per file, then sentences per firm, with blank label columns; and the file statistics."""
    sample, stats = sampling.sample_files(filings, ciks, nmax, text_col)
    cut = to_sentences(sample.drop("file"), text_col, LABELS_OF[form_label], lang=lang)
    return sampling.sentences_per_firm(cut, nsents), stats


def sentences_without_label(
    master: DataFrame, form_types: list[str], form_label: str, lang: str | None = "en"
) -> DataFrame:
    """All sentences of filings that are marked but have none yet."""
    filings = tables.unlabelled_filings(master, form_types)
    keyed = filings.selectExpr("xxhash64(cik, filtered_text, label) AS idx", "cik", "filtered_text")
    cut = to_sentences(keyed, "filtered_text", LABELS_OF[form_label], lang=lang)
    return sampling.sentences_per_firm(cut, None)
