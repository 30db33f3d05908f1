"""Entity rules over tokens, written as one token pattern after another.

Elements are separated by blanks. ``Title`` is a title-case token, ``!Title`` one that is not,
``dddd`` a token of so many digits, ``i:`` ignores case, anything else is a regular expression for
the whole token. A trailing ``{?}``, ``{*}`` or ``{+}`` repeats the element.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The rules of the filing domain, in their order of priority.
DOMAIN_RULES = [
    ("TICKER", r"\( i:nyse|nasdaq|lse|tase : [A-Z0-9.]+ \)"),
    ("TICKER", r"\( i:nyse|nasdaq|lse|tase : [A-Z0-9.]+ , i:nyse|nasdaq|lse|tase : [A-Z0-9.]+ \)"),
    ("SEC", "SEC"),
    ("SEC", r"i:the{?} U\.?S\.?{?} Securities and Exchange Commission"),
    ("SEC", "Securities Administrator"),
    ("FILING", "i:annual i:report"),
    ("FILING", "i:quarterly i:report"),
    ("FILING", "i:the Title{?} Prospectus(?:es)?"),
    ("FILING", "Free Writing Prospectus(?:es)?"),
    ("FILING", "Registration Statement"),
    ("FILING", "Proxy Statement"),
    ("FILING", r"Form [0-9A-Z.\-]+"),
    ("FILING", r"Exhibit [0-9A-Z.\-]+"),
    ("FILING", r"Schedule [0-9A-Z.\-]+"),
    ("ORG", "Cisco"),
    ("GOV", "FDA"),
    ("GOV", "IRS"),
    ("GOV", "FASB"),
    ("GOV", "IASB"),
    ("GOV", "DOJ"),
    ("GOV", "Congress"),
    ("GOV", "Senate"),
    ("GOV", "FINRA"),
    ("GOV", "FDIC"),
    ("GOV", "FINMA"),
    ("GOV", "FRB"),
    ("GOV", "FSA"),
    ("GOV", "WTO"),
    ("GOV", "EPA"),
    ("GOV", "DEFRA"),
    ("GOV", "AFCA"),
    ("GOV", "Federal Reserve Bank"),
    ("GOV", "Federal Reserve Board"),
    ("GOV", "i:the{?} Federal Title Commission"),
    ("GOV", "Canadian Competition Bureau"),
    ("GOV", "Financial Industry Regulatory Authority"),
    ("GOV", "Australian Financial Complaints Authority"),
    ("GOV", "Federal Reserve"),
    ("GOV", "Governmental Authority"),
    ("GOV", r"i:the U\.?S\.? Department of Title"),
    ("GOV", "United States Department of Title"),
    ("GOV", r"i:the U\.?S\.? Title Department"),
    ("GOV", "i:the Department of Defense"),
    ("GOV", "Ministry of Health"),
    ("GOV", "i:the Title{?} Title Court"),
    ("PERSON", "Co - Chief"),
    ("ACCT", "i:non - GAAP"),
    ("ACCT", "i:adjusted{?} i:ebitda"),
    ("ACCT", "i:adjusted{?} Title Revenue"),
    ("ACCT", "i:eps"),
    ("ACCT", "i:ebit"),
    ("ACCT", "CSR"),
    ("ACCT", "AOCI"),
    ("ACCT", "Disclosure"),
    ("ACCT", "Liabilities"),
    ("ACCT", r"FY\d{2}"),
    ("ACCT", r"FY\d{4}"),
    ("ACCT", "CET1 Capital"),
    ("ACCT", "CET1 Ratio"),
    ("ACCT", "Internal Controls i:and Title"),
    ("ACCT", "Material Adverse Effect"),
    ("ACCT", "Standard Industry Classification"),
    ("ACCT", "Convertible Securities"),
    ("ACCT", r"U\.?S\.?{?} GAAP"),
    ("ACCT", "ASU"),
    ("LAW", r"Regulation [A-Z\-]+"),
    ("LAW", "FATCA"),
    ("LAW", "FCPA"),
    ("LAW", "ERISA"),
    ("LAW", "PPACA"),
    ("LAW", "HIPAA"),
    ("LAW", "GLBA"),
    ("LAW", "FCC"),
    ("LAW", "Title{?} -{?} Title Laws?"),
    ("LAW", "the Title{*} ,{?} Title{+} and Title Laws?"),
    ("LAW", "Title Regulation"),
    ("LAW", "i:the Title{?} Code"),
    ("LAW", r"i:the{?} U\.?S\.?{?} Title{+} Act of{?} dddd{?}"),
    ("LAW", "i:the dddd{?} Act"),
    ("LAW", "i:the Federal Acquisition Regulation"),
    ("GPE", "Title ,{?} [A-Z]{2} ddddd USA"),
    ("GPE", "Title , Title ddddd USA"),
    ("GPE", "EU !Title"),
    ("GPE", "People 's Republic of China"),
    ("GPE", "European Union"),
    ("GPE", "United States"),
    ("CONTRACT", "Letter of Credit"),
    ("CONTRACT", "Letters of Credit"),
    ("CONTRACT", "Asset Swap"),
    ("CONTRACT", "Title Loans?"),
    ("CONTRACT", "Non{?} - Serviced Title Loans?"),
    ("TIME", "Pacific Time"),
    ("TIME", "Eastern Time"),
    ("EVENT", "Title Investigation"),
    ("EVENT", "Title{?} -{?} Title Event"),
]

# Rules standing in for labels that a trained model would give; the domain rules go before them.
MONTH = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
GENERAL_RULES = [
    ("DATE", rf"{MONTH} \d{{1,2}} ,{{?}} dddd"),
    ("DATE", rf"\d{{1,2}} {MONTH} dddd"),
    ("DATE", rf"{MONTH} dddd"),
    ("DATE", rf"{MONTH} \d{{1,2}}"),
    ("DATE", r"\d{4}-\d{2}-\d{2}"),
    ("DATE", "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"),
    ("TIME", r"\d{1,2}:\d{2} i:a\.m\.?|p\.m\.?|am|pm{?}"),
    ("PERCENT", r"\d[\d.,]* %"),
    ("PERCENT", r"\d[\d.,]* percent"),
    ("MONEY", r"US{?} [$€£] \d[\d.,]* i:thousand|million|billion|trillion{?}"),
    ("ORG", r"Title{+} ,{?} Inc|Corp|Corporation|Company|LLC|Ltd|Limited|plc \.{?}"),
]

OPEN, CLOSE = "\x02", "\x03"
TITLE = r"\p{Lu}\p{Ll}*"
NOT_TITLE = rf"(?:[^\p{{Lu}}{OPEN}{CLOSE}]|\p{{Lu}}\p{{Ll}}*[^\p{{Ll}}{OPEN}{CLOSE}])[^{OPEN}{CLOSE}]*"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    tier: int = 0

    @property
    def regex(self) -> str:
        """The rule over marked text, in which every token stands between OPEN and CLOSE."""
        return "".join(_element(e) for e in self.pattern.split(" "))

    @property
    def anchors(self) -> list[str] | None:
        """Lower-cased tokens of which every match holds one, or None when no element names any."""
        return sorted({w.lower() for w in self.needs[0][0]}) if self.needs else None

    @property
    def needs(self) -> list[tuple[list[str], bool]]:
        """For each element of plain words its spellings, of which every match holds one, and whether their case counts.

        The one least common by ``_commonness`` comes first. Others follow where they are of four letters or more, since
        shorter ones stand in most sentences and would spare few searches.
        """
        found = []
        for element in self.pattern.split(" "):
            if re.search(r"\{[?*]\}$", element) or "Title" in element or re.fullmatch("d+", element):
                continue
            words = _spellings(element.removeprefix("i:").removesuffix("{+}"))
            if words is not None:
                found.append((words, not element.startswith("i:")))
        found.sort(key=lambda need: (*_commonness(need[0]), not need[1]))
        return found[:1] + [need for need in found[1:] if min(len(w) for w in need[0]) >= 4]

    @property
    def sign(self) -> str | None:
        """Characters that every match holds, for a rule without anchors; None when none are sure."""
        signs = []
        for element in self.pattern.split(" "):
            if re.search(r"\{[?*]\}$", element) or "Title" in element or re.fullmatch("d+", element):
                continue
            if not element.startswith("i:") and re.fullmatch(r"(?:\\d(?:\{\d+(?:,\d+)?\})?|[A-Za-z:/-])+", element):
                signs += re.findall(r"[A-Za-z:/-]+", re.sub(r"\\d(?:\{\d+(?:,\d+)?\})?", " ", element))
        return max(signs, key=len, default=None)


def _commonness(words: list[str]) -> tuple[int, int]:
    """Sorts by the shortest spelling, long ones first, then by the number of spellings."""
    return -min(len(w) for w in words), len(words)


def _spellings(pattern: str) -> list[str] | None:
    """All texts that an element of plain words, ``|`` and ``?`` stands for, as they are written."""
    found: set[str] = set()
    for option in pattern.split("|"):
        texts = [""]
        pieces = re.findall(r"(\(\?:\w+\)|\\[^\w]|\[[^\]\\^-][^\]\\-]*\]|[^\\()\[\]{}*+?^]|\$)(\??)", option)
        if "".join(a + b for a, b in pieces) != option or any(a == "." for a, _ in pieces):
            return None
        for piece, optional in pieces:
            if piece.startswith("["):
                forms = list(piece[1:-1])
            elif piece.startswith("(?:"):
                forms = [piece[3:-1]]
            else:
                forms = [piece[-1]]
            texts = [t + f for t in texts for f in forms + ([""] if optional else [])]
        found.update(texts)
    return sorted(found)


def _element(element: str) -> str:
    repeat = re.search(r"\{([?*+])\}$", element)
    if repeat:
        element = element[: repeat.start()]
    if element == "Title":
        token = TITLE
    elif element == "!Title":
        token = NOT_TITLE
    elif re.fullmatch("d+", element):
        token = r"\d{%d}" % len(element)
    elif element.startswith("i:"):
        token = f"(?i:{element[2:]})"
    else:
        token = f"(?:{element})"
    return f"(?:{OPEN}{token}{CLOSE} ?){repeat.group(1) if repeat else ''}"


def default_rules() -> list[Rule]:
    return [Rule(label, p) for label, p in DOMAIN_RULES] + [
        Rule(label, p, tier=1) for label, p in GENERAL_RULES
    ]


def _from_token(token: dict) -> str:
    spec = next(iter(v for k, v in token.items() if k != "OP"))
    key = next(k for k in token if k != "OP")
    if key == "IS_TITLE":
        text = "Title"
    elif key == "SHAPE":
        text = spec
    else:
        text = spec["REGEX"].removeprefix("^").removesuffix("$") if isinstance(spec, dict) else re.escape(spec)
        text = ("i:" if key == "LOWER" else "") + text.replace("\\-", "-").replace("\\ ", " ")
    op = token.get("OP", "")
    if op == "!":
        if text != "Title":
            raise ValueError("only a title-case test can be negated")
        return "!Title"
    return text + (f"{{{op}}}" if op else "")


def read_rules(spark: SparkSession, path: str, max_rules: int = 2000) -> list[Rule]:
    """Rules from JSON lines: a label and either exact text or a list of token tests.

    Rules become part of the query text, so there may be at most ``max_rules`` of them.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").limit(max_rules + 1).collect()
    if len(lines) > max_rules:
        raise ValueError(f"more than {max_rules} rules; use a gazetteer table for lists of names")
    rules = []
    for line in lines:
        entry = json.loads(line.value)
        pattern = entry["pattern"]
        if isinstance(pattern, str):
            pattern = " ".join(re.escape(word).replace("\\-", "-") for word in pattern.split(" "))
        else:
            pattern = " ".join(_from_token(token) for token in pattern)
        rules.append(Rule(entry["label"], pattern))
    return rules


def rule_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as a table: priority, label, pattern."""
    rules = default_rules() if rules is None else rules
    rows = [(i, r.label, r.pattern) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "priority int, label string, pattern string")
