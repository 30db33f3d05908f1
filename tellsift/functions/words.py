"""Fixed word lists and small lexicons."""

# Form types of the two filing groups (current and periodic reports).
FORM_GROUPS = {
    "CR": ["6-K", "8-K"],
    "PR": ["10-Q", "10-K", "20-F", "40-F", "DRS", "S-1", "S-3", "S-4", "F-1", "F-10", "F-3"],
}

# Entity labels that replace their text in the token string, per filing group.
CR_LABELS = [
    "DATE", "TIME", "TICKER", "GPE", "PERSON", "PERCENT", "LAW", "MONEY", "FILING", "GOV",
    "LOC", "SEC", "ORG",
]
PR_LABELS = ["PERCENT", "LAW", "MONEY", "FILING", "GOV", "SEC", "DATE", "PERSON", "ORG"]

# Words that show that a supposed organisation is none.
ORG_NOISE = [
    "agreement", "breach", "requirement", "change", "report", "stock", "contract", "shareholder",
    "policy", "statement", "rate", "notice", "diluted", "government", "document", "commitment",
    "offer", "award", "termination", "pin", "law", "market", "asset", "regulatory",
]

# Curated stop words per filing group, for lower-cased and for cased text.
CR_STOP_LOWER = [
    "org", "to", "and", "in", "this", "by", "gpe", "an", "at", "no", "date", "related", "result",
    "based",
]
CR_STOP_CASED = [
    "ORG", "to", "and", "in", "In", "this", "This", "by", "By", "GPE", "an", "at", "no", "DATE",
    "related", "result", "based",
]
PR_STOP_LOWER = [
    "of", "in", "and", "to", "our", "that", "not", "technology", "we", "customers", "materially",
    "on", "or",
]
PR_STOP_CASED = [
    "of", "in", "In", "and", "to", "our", "Our", "that", "not", "technology", "we", "We",
    "customers", "materially", "on", "On", "or",
]

# Columns a labeller fills in.
LABEL_COLUMNS = ["Incident", "Immaterial", "Cost", "Litigation", "Management"]

# Number words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion trillion first second third fourth fifth sixth seventh "
    "eighth ninth tenth"
).split()

# Function words of four languages.
LANGUAGE_WORDS = {
    "de": (
        "der die das und nicht ein eine einer den dem des im in ist zu mit auf von für sich auch "
        "als an es wird sind bei nach aus wir sie"
    ).split(),
    "en": (
        "the of and to in a is that for on was with as by be are at from this it or an which has "
        "have not we our its will"
    ).split(),
    "es": (
        "el la los las de del que y en un una por con para es se no al lo como más su sus o este "
        "esta pero son fue ha"
    ).split(),
    "fr": (
        "le la les de des du et un une en est que qui dans pour par sur au aux avec ce cette il "
        "elle ne pas nous vous sont ou"
    ).split(),
}

# Parts of speech: closed classes and the commonest irregular forms.
MODALS = "can could may might must shall should will would cannot ought".split()
BE_HAVE = "be am is are was were been being have has had having".split()
AUX_PAST = "was were had did".split()
AUX_OTHER = "be am is are being have has having do does".split()
SKIPPED_ADVERBS = "not also already never previously recently subsequently".split()
PAST_FORMS = (
    "began became broke brought built bought came chose cut fell found gave got grew held kept "
    "knew led left lost made met paid put ran rose said saw sent set sold sought spoke spent "
    "stole stood stolen took taught thought told went won wrote"
).split()
PARTICIPLES = (
    "begun become broken brought built bought come chosen cut fallen found given got grown held "
    "kept known led left lost made met paid put run risen said seen sent set sold sought spoken "
    "spent stolen stood taken taught thought told gone won written"
).split()
ONLY_PARTICIPLES = (
    "been begun broken chosen fallen given grown known risen seen spoken stolen taken gone written"
).split()
BASE_VERBS = (
    "affect allow believe cause continue ensure expect experience help include includes including "
    "maintain make makes need operate protect provide provides remain require requires result "
    "source use uses visit"
).split()
NOUN_ENDINGS = "(?:tion|tions|sion|sions|ment|ments|ness|ity|ities|ance|ence|ship|ware|ing)$"
COMMON_NOUNS = (
    "access attack board breach business company computer cost customer customers cyber data "
    "date employee employees event executive failure filing firm hacker impact incident "
    "information law loss market network notice number party people person plan product products "
    "quarter report results risk security service services system systems technology term "
    "theft time user users year years"
).split()

# Sentiment: (polarity, subjectivity) -> words.
SENTIMENT = [
    (0.8, 0.9, "excellent outstanding exceptional superb".split()),
    (0.5, 0.6, "good great strong best better successful success pleased leading positive".split()),
    (0.3, 0.4, "improved improve benefit gain growth secure effective qualified valuable".split()),
    (0.0, 0.5, "likely certain possible significant material".split()),
    (-0.3, 0.4, "risk loss difficult limited delay decline weak concern uncertain".split()),
    (-0.5, 0.6, "bad poor failure failed adverse breach harmful unauthorized worthless".split()),
    (-0.8, 0.9, "terrible worst severe malicious fraudulent disastrous pathetic scum".split()),
]
NEGATIONS = "not no never without neither nor cannot n't n’t".split()
INTENSIFIERS = [(1.3, "very highly extremely most".split()), (0.7, "slightly somewhat".split())]
