"""Sentences to annotated tokens: array expressions over one sentence, no shuffle, no Python worker."""

from __future__ import annotations

from functools import lru_cache, reduce
from zlib import crc32

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from tellsift.functions.rules import CLOSE, OPEN, Rule, default_rules
from tellsift.functions.text import holds_any, let
from tellsift.functions.words import NUMBER_WORDS, ORG_NOISE

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
URL = (
    r"(?:(?:[Hh][Tt][Tt][Pp][Ss]?://|[Ww][Ww][Ww]\.)[^\s\"“”<>()]*[A-Za-z0-9/]"
    r"|[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.(?:com|org|net|edu|gov)\b(?:/[^\s\"“”<>()]*[A-Za-z0-9/])?)"
)
NUMBER = r"\d[\dA-Za-z]*(?:[.,:/]\d+|-[0-9A-Z]+)*"
INITIALS = r"(?:[A-Za-z]\.)+[A-Za-z]\b\.?"
CLITIC = r"\x1d(?:['’][sS]|n['’]t)"
PLAIN_TOKEN = rf"{NUMBER}|{INITIALS}|{CLITIC}|\p{{L}}[\p{{L}}\p{{M}}\d_]*|\.{{2,}}|-{{2,}}|[^\s\x1d]"
TOKEN = rf"{EMAIL}|{URL}|{PLAIN_TOKEN}"
# The same tokens for Java alone: runs that end before "@" or "." are never given back letter by letter.
JAVA_TOKEN = TOKEN.replace(r"%+\-]+@", r"%+\-]++@", 1).replace(
    r"|[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.(?:", r"|[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.(?:", 1
)
# What every web and mail address holds one of; sentences without need not be searched for them.
ADDRESS_SIGNS = ["@", "://", "W.", "w.", ".com", ".org", ".net", ".edu", ".gov"]
SPLIT_CLITIC = r"(\p{L})(['’][sS]\b|n['’]t\b)"
RESERVED = "\x01\x02\x03\x1d"
ALPHA = r"^\p{L}+$"
# Fixed value: what counts as the text of a list marker.
ITEM = r"^(?:(\w)\1{2,}|[a-zA-Z]|[ivx]+|\d)$"
HIT = "\x01"
SLOTS = 256
# More tokens than a sentence holds.
MOST = 2**30

# A token of a sentence: its text and, where it belongs to an entity, the label.
EMPTY_SPANS = "array<struct<tier:int,width:int,start:int,rule:int,stop:int,label:string>>"


def mark_tokens(sentence: Column) -> Column:
    """The sentence with every token between OPEN and CLOSE, white space kept.

    Reserved signs and clitics are dealt with only where the sentence holds any.
    """
    plain = F.when(holds_any(sentence, RESERVED), F.translate(sentence, RESERVED, "")).otherwise(sentence)
    frame = f"{OPEN}$0{CLOSE}"

    def mark(text: Column) -> Column:
        return F.when(holds_any(sentence, ADDRESS_SIGNS), F.regexp_replace(text, JAVA_TOKEN, frame)).otherwise(
            F.regexp_replace(text, PLAIN_TOKEN, frame)
        )

    split = F.regexp_replace(plain, SPLIT_CLITIC, "$1\x1d$2")
    return F.when(holds_any(sentence, "'’"), _without(mark(split), "\x1d")).otherwise(mark(plain))


def _without(text: Column, sign: str) -> Column:
    """The text without one sign; ``translate`` does the same by a lookup for each character."""
    return F.replace(text, F.lit(sign), F.lit(""))


def token_texts(marked: Column) -> Column:
    return F.regexp_extract_all(marked, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))


def plain_tokens(sentence: Column) -> Column:
    """Token texts without entities."""
    return token_texts(mark_tokens(sentence))


def _token_count(marked: Column) -> Column:
    return F.octet_length(marked) - F.octet_length(_without(marked, OPEN))


def _pieces(marked: Column) -> Column:
    """One text per token: the token, CLOSE and the white space behind it."""
    parts = F.split(marked, OPEN)  # before the first token there is white space only
    return F.slice(parts, 2, MOST)


def _word(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, 1)


def find_spans(marked: Column, rules: list[Rule]) -> Column:
    """Entity spans in token positions: longest first, then leftmost, then rule order.

    A domain rule goes before any general one. Chosen spans never overlap. A rule is searched only
    in sentences that hold a spelling of each of its plain words, so that most sentences cost one
    set lookup per token.
    """
    return _find_spans(marked, F.transform(_pieces(marked), _word), rules)


def _find_spans(marked: Column, texts: Column, rules: list[Rule]) -> Column:
    plain = sorted({w.lower() for rule in rules for words, _ in rule.needs for w in words})
    held = F.array_distinct(F.filter(texts, lambda t: F.lower(t).isin(plain)))
    return let(
        let(held, lambda h: F.struct(h.alias("exact"), F.transform(h, F.lower).alias("lower"))),
        lambda h: _resolve(marked, h, rules),
    )


def _resolve(marked: Column, held: Column, rules: list[Rule]) -> Column:
    labels = F.array(*[F.lit(rule.label) for rule in rules])
    tiers = F.array(*[F.lit(rule.tier) for rule in rules])

    def holds(words: list[str], exact: bool = False) -> Column:
        given = held["exact"] if exact else held["lower"]
        words = words if exact else sorted({w.lower() for w in words})
        if len(words) == 1:
            return F.array_contains(given, words[0])
        return F.exists(given, lambda t: t.isin(words))

    def search(number: int, rule: Rule) -> Column:
        found = F.regexp_replace(marked, rule.regex, f"{HIT}$0{HIT}")
        if rule.needs:
            return F.when(reduce(lambda a, b: a & b, [holds(*need) for need in rule.needs]), found)
        return found if rule.sign is None else F.when(marked.contains(rule.sign), found)

    def chosen(rule: Column, low: int, high: int) -> Column:
        """The search of the rule of this number, found by halving."""
        if high - low == 1:
            return search(low, rules[low])
        middle = (low + high) // 2
        return F.when(rule < middle, chosen(rule, low, middle)).otherwise(chosen(rule, middle, high))

    # rules by the hash of their first words; a word of equal hash only adds a rule whose words are then missed
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for number, rule in enumerate(rules):
        for slot in sorted({crc32(word.encode()) % SLOTS for word in rule.anchors or []}):
            slots[slot].append(number)
    free = [number for number, rule in enumerate(rules) if not rule.needs]
    numbers = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<int>")
    table = F.array(*[numbers(slot) for slot in slots])
    tried = F.transform(held["lower"], lambda w: F.get(table, (F.crc32(w) % SLOTS).cast("int")))
    tried = F.concat(F.array_distinct(F.flatten(tried)), numbers(free))
    searched = F.transform(tried, lambda r: F.struct(chosen(r, 0, len(rules)).alias("text"), r.alias("rule")))

    def spans_of(found: Column) -> Column:
        def spans(counts: Column) -> Column:
            inside = F.filter(F.sequence(F.lit(1), F.size(counts) - 1), lambda i: i % 2 == 1)
            return F.transform(inside, lambda i: span(counts, i))

        def span(counts: Column, i: Column) -> Column:
            place = F.struct(
                F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda n, c: n + c).alias("start"),
                counts[i].alias("width"),
            )
            return let(
                place,
                lambda p: F.struct(
                    tiers[found["rule"]].alias("tier"),
                    (-p["width"]).alias("width"),
                    p["start"].alias("start"),
                    found["rule"].alias("rule"),
                    (p["start"] + p["width"]).alias("stop"),
                    labels[found["rule"]].alias("label"),
                ),
            )

        return let(F.transform(F.split(found["text"], HIT), _token_count), spans)

    hits = F.filter(searched, lambda f: f["text"].contains(HIT))
    candidates = F.sort_array(F.flatten(F.transform(hits, spans_of)))
    empty = F.array().cast(EMPTY_SPANS)

    def add(chosen: Column, span: Column) -> Column:
        clash = F.exists(
            chosen, lambda c: (span["start"] < c["stop"]) & (c["start"] < span["stop"])
        )
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(span)))

    return let(
        candidates.cast(EMPTY_SPANS),
        lambda c: F.when(F.size(c) < 2, c).otherwise(F.aggregate(c, empty, add)),
    )


@lru_cache(maxsize=64)
def _annotation(context: object, column: str, rules: tuple[Rule, ...]) -> Column:
    return _annotate(F.col(column), list(rules))


def annotate(sentence: Column | str, rules: list[Rule] | None = None) -> Column:
    """Tokens in order as ``struct<i, text, ent>``; an entity of several words is one token.

    ``i`` is the position of the first word. ``ent`` is null outside entities. For a column given
    by name the long expression is put together once per session.
    """
    rules = default_rules() if rules is None else rules
    if isinstance(sentence, str):
        return _annotation(SparkContext._active_spark_context, sentence, tuple(rules))
    return _annotate(sentence, rules)


def _annotate(sentence: Column, rules: list[Rule]) -> Column:
    def build(marked: Column) -> Column:
        return let(_pieces(marked), lambda p: let(F.transform(p, _word), lambda t: texts(marked, p, t)))

    def texts(marked: Column, pieces: Column, words: Column) -> Column:
        return let(_find_spans(marked, words, rules), lambda s: merge(pieces, words, s))

    def merge(pieces: Column, words: Column, spans: Column) -> Column:
        single = F.transform(
            words, lambda t, i: F.struct(i.alias("i"), t.alias("text"), F.lit(None).cast("string").alias("ent"))
        )
        places = F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["label"]))
        places = let(places, lambda p: F.when(F.size(p) > 1, F.sort_array(p)).otherwise(p))
        replaced = let(single, lambda w: let(places, lambda at: _woven(w, pieces, at)))
        return F.when(F.size(spans) == 0, single).otherwise(replaced)

    return let(mark_tokens(sentence), build)


def _woven(words: Column, pieces: Column, spans: Column) -> Column:
    """The words with each span of ``(start, stop, label)``, in order and apart, as one token of its label."""

    def upto(s: Column, j: Column) -> Column:
        before = F.coalesce(F.get(spans, j - 1)["stop"], F.lit(0))
        inside = F.array_join(F.slice(pieces, s["start"] + 1, s["stop"] - s["start"]), "")
        # of white space between two tokens only the blanks that come first are kept
        inside = F.when(
            holds_any(inside, "\t\n\x0b\f\r"), F.regexp_replace(inside, rf"{CLOSE}( *)[\t\n\x0b\f\r]\s*", f"{CLOSE}$1")
        ).otherwise(inside)
        text = _without(F.call_function("substring_index", inside, F.lit(CLOSE), s["stop"] - s["start"]), CLOSE)
        entity = F.struct(s["start"].alias("i"), text.alias("text"), s["label"].alias("ent"))
        return let(before, lambda b: F.concat(F.slice(words, b + 1, s["start"] - b), F.array(entity)))

    last = F.get(spans, F.size(spans) - 1)["stop"]
    return F.concat(F.flatten(F.transform(spans, upto)), F.slice(words, last + 1, F.lit(MOST)))


def is_org_noise(text: Column, noise: list[str] = ORG_NOISE) -> Column:
    """True when a supposed organisation holds a word that rules it out."""
    return F.exists(F.split(F.lower(text), " "), lambda w: w.isin(noise))


def is_item(tokens: Column, i: Column) -> Column:
    """True for the token between brackets of a list item such as (a), (iv), (3) or (ccc)."""
    return (
        F.coalesce(F.get(tokens, i - 1)["text"] == "(", F.lit(False))
        & F.coalesce(F.get(tokens, i + 1)["text"] == ")", F.lit(False))
        & F.get(tokens, i)["text"].rlike(ITEM)
    )


def token_class(tokens: Column, i: Column) -> Column:
    """URL, EMAIL, ITEMNUM, ENT, NUM, WORD or OTHER for the token at position ``i``."""
    return _class(tokens, F.get(tokens, i), i)


def _class(tokens: Column, token: Column, i: Column) -> Column:
    """The class of ``token``, which is the one at ``i``. Letters alone are no address, so a word is not searched for one."""
    text = token["text"]
    named = (
        F.when(holds_any(text, [".", "://"]) & text.rlike(f"^(?:{URL})$"), "URL")
        .when(text.contains("@") & text.rlike(f"^(?:{EMAIL})$"), "EMAIL")
        .when(is_item(tokens, i), "ITEMNUM")
        .when(token["ent"].isNotNull(), "ENT")
        .otherwise("OTHER")
    )
    return (
        F.when(token["ent"].isNotNull() | ~text.rlike(ALPHA), named)
        .when(is_item(tokens, i), "ITEMNUM")
        .when(F.length(text) < 2, "OTHER")
        .when(F.lower(text).isin(NUMBER_WORDS), "NUM")
        .otherwise("WORD")
    )


def entity_tokens(
    tokens: Column,
    labels: list[str] | None = None,
    oov: Column | None = None,
    noise: list[str] = ORG_NOISE,
) -> Column:
    """The token list of a sentence with chosen entities replaced by their label.

    The first that holds decides: URL, EMAIL, ITEMNUM, a chosen label, a genuine organisation,
    the words of any other entity, then NUM, OOV (``oov`` is an array of unknown words) or the word.
    """
    chosen = [label for label in labels or [] if label != "ORG"]
    with_org = "ORG" in (labels or [])

    def one(token: Column, i: Column) -> Column:
        text, ent = token["text"], token["ent"]
        cls = _class(tokens, token, i)
        word = F.array(text)
        if oov is not None:
            word = F.when(F.array_contains(oov, text), F.array(F.lit("OOV"))).otherwise(word)
        in_entity = F.filter(F.split(text, " "), lambda w: w.rlike(ALPHA))
        if with_org:
            in_entity = F.when(
                (ent == "ORG") & ~is_org_noise(text, noise), F.array(F.lit("ORG"))
            ).otherwise(in_entity)
        if chosen:
            in_entity = F.when(ent.isin(chosen), F.array(ent)).otherwise(in_entity)
        return let(
            cls,
            lambda c: F.when(c.isin("URL", "EMAIL", "ITEMNUM", "NUM"), F.array(c))
            .when(c == "ENT", in_entity)
            .when(c == "WORD", word)
            .otherwise(F.array().cast("array<string>")),
        )

    return F.flatten(F.transform(tokens, one))


def valid_sentence(tokens: Column) -> Column:
    """At least four tokens and three different words of more than two letters, entities aside.

    As with all functions on annotated tokens, pass a column rather than ``annotate(...)`` itself.
    """
    words = F.transform(
        F.filter(
            tokens,
            lambda t: (t["ent"].isNull() | ~t["text"].contains(" "))
            & t["text"].rlike(r"^\p{L}{3,}$"),
        ),
        lambda t: F.lower(t["text"]),
    )
    return (F.size(tokens) >= 4) & (F.size(F.array_distinct(words)) >= 3)


def ngrams(words: Column, low: int, high: int | None = None) -> Column:
    """All n-grams of the word array, joined by a blank."""
    high = high or low
    if (low, high) == (1, 1):
        return words

    def of_size(ws: Column, n: int) -> Column:
        if n == 1:
            return ws
        return F.when(
            F.size(ws) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(ws) - (n - 1)),
                lambda i: F.concat_ws(" ", *[F.get(ws, i + (k - 1)) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(words, lambda ws: F.concat(*[of_size(ws, n) for n in range(low, high + 1)]))


def remove_words(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def default_words(text: Column, lower: bool = True) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(
        F.lower(text) if lower else text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)
    )
