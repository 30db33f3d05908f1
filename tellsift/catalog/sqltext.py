"""Shared parts of the SQL that checks the queries."""

from __future__ import annotations

from tellsift.functions import text as T, tokens as K, words as W
from tellsift.functions.rules import CLOSE, OPEN, default_rules


def q(text: str) -> str:
    """A quoted SQL string."""
    return "'" + text.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(T.JUNK)}, ' ', 'g'))"


def seg(x: str) -> str:
    items = f"regexp_replace({x}, {q(T.LIST_ITEM)}, {q(chr(92) + '1 ' + chr(92) + '2' + T.CUT + chr(92) + '3')}, 'g')"
    cut = (
        f"regexp_replace(regexp_replace(p, {q(T.SENTENCE_END)}, {q(chr(92) + '1' + T.CUT + chr(92) + '2')}, 'g'), "
        f"{q(T.ABBREVIATION)}, {q(chr(92) + '1. ')}, 'g')"
    )
    pieces = (
        f"list_transform(regexp_extract_all({items}, {q(T.BRACKETS)}), "
        f"lambda p: CASE WHEN starts_with(p, '(') THEN p ELSE {cut} END)"
    )
    return (
        f"list_filter(list_transform(string_split(array_to_string({pieces}, ''), {q(T.CUT)}), "
        f"lambda s: trim(s)), lambda s: s <> '')"
    )


def mark(x: str) -> str:
    plain = f"translate({x}, {q(K.RESERVED)}, '')"
    joined = f"regexp_replace({plain}, {q(K.SPLIT_CLITIC)}, {q(chr(92) + '1' + chr(29) + chr(92) + '2')}, 'g')"
    marked = f"regexp_replace({joined}, {q(K.TOKEN)}, {q(OPEN + chr(92) + '0' + CLOSE)}, 'g')"
    return f"translate({marked}, {q(chr(29))}, '')"


def ntok(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(OPEN)}, '')))"


def unmark(x: str) -> str:
    return f"trim(translate({x}, {q(OPEN + CLOSE)}, ''))"


def words_of(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(T.WORD)})"


FILINGS = "filings AS (SELECT doc_id AS idx, source AS cik, lang AS form_type, text AS filtered_text FROM documents)"
LABELS = "lab AS (SELECT doc_id AS idx, quality AS Incident, toxic AS Immaterial FROM labels)"
NOTICES = """notices AS (SELECT o_orderkey AS idx, c_name AS cik,
 'On ' || strftime(o_orderdate, '%B %-d, %Y') || ', ' || c_name || ' (NYSE: ' || substr(c_mktsegment, 1, 4)
 || ') filed Form ' || CASE WHEN o_orderstatus = 'F' THEN '8-K' ELSE '10-K' END
 || ' with the Securities and Exchange Commission.' || chr(10)
 || 'The company reported that hackers had accessed data worth $'
 || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' million; (a) a ' || lower(o_orderpriority)
 || ' notice was not sent; and (iv) about ' || CAST(o_custkey % 90 + 1 AS VARCHAR)
 || '% of three customers'' records in ' || n_name || ' were disclosed: see www.' || lower(c_mktsegment)
 || '.com or mail ir' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment)
 || '.com. It doesn''t expect a very harmful breach, said the U.S. Department of Justice (' || n_name
 || ' v. Acme Holdings, Inc.) and Data Agreement Corp. Stolen data may have been sold.' AS filtered_text
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def cut(source: str, name: str = "seg") -> str:
    """Sentences of a table of filings, in order."""
    return (
        f"{name}_l AS MATERIALIZED (SELECT * EXCLUDE (filtered_text), {seg(norm('filtered_text'))} AS l FROM {source}), "
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (l), unnest(l) AS sents, "
        f"CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM {name}_l)"
    )


def distinct_cut(source: str, name: str = "seg") -> str:
    """First occurrence of every sentence of a filing, numbered anew."""
    return cut(source, f"{name}_all") + (
        f", {name} AS MATERIALIZED (SELECT idx, cik, sents, CAST(row_number() OVER (PARTITION BY idx ORDER BY min(pos)) - 1 AS INTEGER) AS pos "
        f"FROM {name}_all GROUP BY idx, cik, sents)"
    )


def annotated(source: str = "seg") -> str:
    """Tokens of sentences with entities: ``ann(idx, pos, i, text, ent)`` and ``cnt``.

    Candidates come from one pass per rule; a recursive query then goes through those of each
    sentence in order of preference and keeps what does not overlap.
    """
    rules = default_rules()
    branches = " UNION ALL ".join(
        f"SELECT idx, pos, {r} AS r, {rule.tier} AS tier, {q(rule.label)} AS label, "
        f"string_split(regexp_replace(marked, {q(rule.regex)}, {q(K.HIT + chr(92) + '0' + K.HIT)}, 'g'), {q(K.HIT)}) AS parts "
        f"FROM mk WHERE regexp_matches(marked, {q(rule.regex)})"
        for r, rule in enumerate(rules)
    )
    return f"""mk AS MATERIALIZED (SELECT idx, pos, {mark('sents')} AS marked FROM {source}),
tk AS MATERIALIZED (SELECT idx, pos, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS i FROM
 (SELECT idx, pos, regexp_extract_all(marked, {q(OPEN + '[^' + CLOSE + ']*' + CLOSE + ' *')}) AS l FROM mk)),
found AS MATERIALIZED ({branches}),
parted AS (SELECT idx, pos, r, tier, label, unnest(parts) AS part, generate_subscripts(parts, 1) AS o FROM found),
placed AS (SELECT *, {ntok('part')} AS w,
 coalesce(sum({ntok('part')}) OVER (PARTITION BY idx, pos, r ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM parted),
cand AS MATERIALIZED (SELECT idx, pos, label, s, s + w AS e,
 row_number() OVER (PARTITION BY idx, pos ORDER BY tier, w DESC, s, r) AS k FROM placed WHERE o % 2 = 0),
pick(idx, pos, k, chosen) AS (
 SELECT DISTINCT idx, pos, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT, label VARCHAR)[]) FROM cand
 UNION ALL
 SELECT p.idx, p.pos, p.k + 1, CASE WHEN len(list_filter(p.chosen, lambda c: o.s < c.e AND c.s < o.e)) > 0 THEN p.chosen
  ELSE list_append(p.chosen, {{'s': o.s, 'e': o.e, 'label': o.label}}) END
 FROM pick p JOIN cand o ON o.idx = p.idx AND o.pos = p.pos AND o.k = p.k + 1),
span AS MATERIALIZED (SELECT idx, pos, unnest(chosen, recursive := true) FROM
 (SELECT idx, pos, arg_max(chosen, k) AS chosen FROM pick GROUP BY idx, pos)),
ann AS MATERIALIZED (SELECT t.idx, t.pos, t.i, {unmark('t.piece')} AS text, CAST(NULL AS VARCHAR) AS ent FROM tk t
 WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.idx = t.idx AND s.pos = t.pos AND t.i >= s.s AND t.i < s.e)
 UNION ALL SELECT s.idx, s.pos, s.s, {unmark("string_agg(t.piece, '' ORDER BY t.i)")}, s.label
 FROM span s JOIN tk t ON s.idx = t.idx AND s.pos = t.pos AND t.i >= s.s AND t.i < s.e GROUP BY s.idx, s.pos, s.s, s.label),
nb AS (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM ann WINDOW w AS (PARTITION BY idx, pos ORDER BY i)),
typed AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(text, {q('^(?:' + K.URL + ')$')}) THEN 'URL'
 WHEN regexp_matches(text, {q('^(?:' + K.EMAIL + ')$')}) THEN 'EMAIL'
 WHEN before = '(' AND after = ')' AND (regexp_matches(text, '^(?:[a-zA-Z]|[ivx]+|[0-9])$')
  OR (length(text) >= 3 AND text = repeat(left(text, 1), length(text)) AND regexp_matches(text, '^[0-9A-Za-z_]'))) THEN 'ITEMNUM'
 WHEN ent IS NOT NULL THEN 'ENT'
 WHEN NOT regexp_matches(text, {q(K.ALPHA)}) OR length(text) < 2 THEN 'OTHER'
 WHEN lower(text) IN {inlist(W.NUMBER_WORDS)} THEN 'NUM' ELSE 'WORD' END AS cls FROM nb)"""


def replaced(labels: list[str] | None) -> str:
    """``tokens(idx, pos, i, j, tok)`` with entities replaced by the chosen labels."""
    chosen = [x for x in labels or [] if x != "ORG"]
    pieces = f"list_filter(string_split(text, ' '), lambda w: regexp_matches(w, {q(K.ALPHA)}))"
    noise = f"len(list_filter(string_split(lower(text), ' '), lambda w: w IN {inlist(W.ORG_NOISE)})) > 0"
    ent = pieces
    if "ORG" in (labels or []):
        ent = f"CASE WHEN ent = 'ORG' AND NOT ({noise}) THEN ['ORG'] ELSE {ent} END"
    if chosen:
        ent = f"CASE WHEN ent IN {inlist(chosen)} THEN [ent] ELSE {ent} END"
    return f"""toks AS MATERIALIZED (SELECT idx, pos, i, unnest(l) AS tok, generate_subscripts(l, 1) AS j FROM (SELECT idx, pos, i,
 CASE WHEN cls IN ('URL', 'EMAIL', 'ITEMNUM', 'NUM') THEN [cls] WHEN cls = 'ENT' THEN {ent}
 WHEN cls = 'WORD' THEN [text] ELSE [] END AS l FROM typed))"""


def tagged() -> str:
    """``posf``: part-of-speech features of annotated sentences."""
    return f"""pw AS (SELECT idx, pos, i, CASE WHEN ent IS NULL THEN lower(text) ELSE '' END AS w FROM ann
 WHERE regexp_matches(text, {q(r'[\p{L}\d$%€£]')})),
pl AS (SELECT *, lag(w) OVER o AS b1, lag(w, 2) OVER o AS b2 FROM pw WINDOW o AS (PARTITION BY idx, pos ORDER BY i)),
ph AS (SELECT *, coalesce((CASE WHEN b1 IN {inlist(W.SKIPPED_ADVERBS)} THEN b2 ELSE b1 END) IN {inlist(W.BE_HAVE)}, false) AS led,
 regexp_matches(w, {q(r'^\p{L}{2,}ed$')}) AS reg FROM pl),
tg AS (SELECT *, CASE WHEN w IN {inlist(W.MODALS)} THEN 'MD' WHEN w IN {inlist(W.AUX_PAST)} THEN 'AUX_PAST'
 WHEN w IN {inlist(W.AUX_OTHER)} THEN 'AUX' WHEN w IN {inlist(W.ONLY_PARTICIPLES)} THEN 'VBN'
 WHEN led AND (reg OR w IN {inlist(W.PARTICIPLES)}) THEN 'VBN' WHEN reg OR w IN {inlist(W.PAST_FORMS)} THEN 'VBD'
 WHEN w IN {inlist(W.BASE_VERBS)} THEN 'VB'
 WHEN w IN {inlist(W.COMMON_NOUNS)} OR regexp_matches(w, {q('^' + chr(92) + 'p{L}{2,}' + W.NOUN_ENDINGS)}) THEN 'NN' ELSE 'X' END AS tag FROM ph),
posf AS MATERIALIZED (SELECT idx, pos, round(ln(count(*) + 1), 6) AS token_count,
 round(count(*) FILTER (tag IN ('VBD', 'AUX_PAST')) / count(*), 6) AS VBD_perc,
 round(count(*) FILTER (tag = 'VBN') / count(*), 6) AS VBN_perc,
 round(count(*) FILTER (tag = 'MD') / count(*), 6) AS MD_perc,
 round(count(*) FILTER (tag IN ('VBD', 'VBN', 'VB')) / count(*), 6) AS VERB_perc,
 round(count(*) FILTER (tag = 'NN') / count(*), 6) AS NOUN_perc FROM tg GROUP BY idx, pos)"""


def valid() -> str:
    """``ok(idx, pos)``: sentences that hold at least three different words."""
    return f"""ok AS MATERIALIZED (SELECT idx, pos FROM ann GROUP BY idx, pos HAVING count(*) >= 4 AND
 count(DISTINCT lower(text)) FILTER ((ent IS NULL OR NOT contains(text, ' ')) AND regexp_matches(text, {q(r'^\p{L}{3,}$')})) >= 3)"""


def lang(x: str) -> str:
    """Language of a text by its function words."""
    names = sorted(W.LANGUAGE_WORDS)
    counts = ", ".join(
        f"'{n}': len(list_filter({words_of(x)}, lambda w: w IN {inlist(W.LANGUAGE_WORDS[n])}))" for n in names
    )
    best = "greatest(" + ", ".join(f"c.{n}" for n in names) + ")"
    whens = " ".join(f"WHEN c.{n} = {best} THEN '{n}'" for n in names)
    return f"(SELECT CASE WHEN {best} = 0 THEN NULL {whens} END FROM (SELECT {{{counts}}} AS c))"


def score(x: str, words: list[str]) -> str:
    """Share of a text's words that are in the list."""
    ws = words_of(x)
    return (
        f"(CASE WHEN len({ws}) = 0 THEN 0.0 ELSE len(list_filter({ws}, lambda w: w IN {inlist(words)}))"
        f" / CAST(len({ws}) AS DOUBLE) END)"
    )


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
