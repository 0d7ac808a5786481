"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs their votes, a classifier decides.

DataFrame expressions only. Spans of the four fixed kinds always stay; a candidate of another kind stays if the final
classifier says so. Nothing is labelled by hand: the votes of all candidates of all documents are counted by pattern, and
the labelers' reliabilities, the patterns' probabilities and the classifier are fitted to that table of counts. It has
at most kinds x 3^labelers x shapes rows, whatever the corpus.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import store, text_of

# The four base kinds, in order, written so that a long run of letters or digits is read once. An e-mail
# address starts where no address character stands before it, or where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)
# Gazetteers: fixed values.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora".split()
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Thomas Charles Daniel Mary Patricia Jennifer Linda Elizabeth Susan "
    "Sarah Karen Hans Klaus Jürgen Wolfgang Stefan Andreas Ursula Monika Petra Sabine Heike Anna Jean Pierre Michel "
    "Philippe Alain Nathalie Isabelle Sylvie Catherine Marie José Juan Antonio Manuel Francisco Carmen Josefa Isabel "
    "Dolores Pilar").split()
TOP_DOMAINS = "com org net edu gov mil int info biz io de fr es uk us eu at ch it nl be pl ca au jp in br mx".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91".split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()
#: Other kinds, found only if the classifier agrees.
EXTRA = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "written": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}"
               r"(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63}){1,6}",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(GIVEN_NAMES)})(?:\x20\p{{Lu}}\p{{Ll}}+){{1,3}}",
}
KINDS = [*BASE, *EXTRA]
#: What a text must hold for a pattern to be tried at all.
_GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
           "ssn": EXTRA["ssn"], "iban": r"[A-Z]{2}[0-9]{2}", "local": EXTRA["local"], "written": r"(?i)[\[(]at[\])]",
           "name": EXTRA["name"]}
#: Words that announce a kind, and words that announce some other number or phrase.
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|courriel|correo|schreib\p{L}*",
    "ip": r"ip|host|server|client|login|addr\p{L}*|adresse|dirección",
    "card": r"card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono|móvil",
    "ssn": r"ssn|social|security|insured|tax",
    "iban": r"iban|account|bank|konto|compte|cuenta|transfer",
    "local": r"phone|tel|call|fax|mobile|cell|text",
    "written": r"e-?mail|mail|contact|write|reach|courriel|correo",
    "name": r"name|called|contact|dear|signed|born|patient|employee|customer|heißt|kunde|nom|nombre|llamo",
}
WARNINGS = (r"version|release|build|section|figure|table|page|isbn|order|invoice|ticket|serial|model|sku|tracking|hash|"
            r"commit|street|avenue|university|prize|award|bridge|saint")
#: Characters read before and after a span.
BEFORE, AFTER = 32, 16
LABELERS = ("form", "gazetteer", "cue", "warning", "edges")
#: The first so many labelers have a rule of their own for each kind, and so reliabilities of their own.
OWN_RULES = 2
#: Votes: abstain, private, not private.
ABSTAIN, YES, NO = 0, 1, 2
SHAPES = 8
#: A candidate of another kind stays from this probability on.
THRESHOLD = 0.5
#: Expected votes of a labeler that is right more often than not, as so many observations, before any are seen.
_PRIOR = {1: (0.3, 0.6, 0.1), 0: (0.3, 0.1, 0.6)}
_STRENGTH, _ROUNDS, _STEPS = 20.0, 50, 400
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


# ---- candidates and their votes -----------------------------------------------------------------

def _running(lengths: Column) -> Column:
    """Running totals of an array of whole numbers, in blocks, as a growing array is copied at every step."""
    size = 512

    def add(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))

    def totals(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array().cast("array<int>"), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")),
                         lambda k: totals(F.slice(lengths, k * size + 1, F.lit(size))))
    ends = totals(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(F.zip_with(blocks, ends, lambda b, end: F.transform(b, lambda x: x + end - F.element_at(b, -1))))


def _found(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Add the column `kind`: the leftmost matches with positions in code points and the text around them.

    The parts between matches give the positions, as Spark gives none: a match ends where all parts up to it do.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_v", F.when(F.col("t").rlike(_GUARDS[kind]), F.regexp_extract_all(
        "t", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_g", F.when(F.size("_v") > 0, F.split("t", pattern, -1)).otherwise(none))
    left, right = F.slice("_g", F.lit(1), F.size("_v")), F.slice("_g", F.lit(2), F.size("_v"))
    rows = rows.withColumn("_e", F.when(F.size("_v") > 0, _running(F.zip_with(
        "_v", left, lambda v, g: F.length(v) + F.length(g)))).otherwise(F.array().cast("array<int>")))
    around = F.arrays_zip(F.col("_e").alias("e"), left.alias("l"), right.alias("r"))
    spans = F.zip_with("_v", around, lambda v, m: F.struct(
        (m["e"] - F.length(v)).alias("start"), m["e"].alias("end"), v.alias("value"),
        F.right(m["l"], F.lit(BEFORE)).alias("before"), F.left(m["r"], F.lit(AFTER)).alias("after")))
    return rows.withColumn(kind, F.when(F.size("_v") > 0, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))).drop(
        "_v", "_g", "_e")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check: from the right, every second one is doubled and its digits are added."""
    def add(total: Column, d: Column) -> Column:
        twice = d * 2
        odd = total["odd"]
        return F.struct((total["sum"] + F.when(odd, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))).alias("sum"),
                        (~odd).alias("odd"))

    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: F.ascii(c) - 48)
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(digits, start, add, lambda t: t["sum"] % 10 == 0)


def _mod_97(value: Column) -> Column:
    """Whether an account number passes its check: its first four characters go last, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _passing(rows: DataFrame, kind: str) -> DataFrame:
    """Without the matches of a kind that fail its check; nothing in them is tried again."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    checks = {
        "ip": lambda s: s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda s: F.length(_digits(s["value"])).between(*CARD_DIGITS) & _luhn(s["value"]),
        "phone": lambda s: F.length(_digits(s["value"])).between(*PHONE_DIGITS),
        "iban": lambda s: _mod_97(s["value"]),
    }
    return rows.withColumn(kind, F.filter(kind, checks[kind])) if kind in checks else rows


def _yes(c: Column) -> Column:
    return F.when(c, YES).otherwise(ABSTAIN)


def _no(c: Column) -> Column:
    return F.when(c, NO).otherwise(ABSTAIN)


def _either(c: Column) -> Column:
    return F.when(c, YES).otherwise(NO)


def _any(values: list[str]) -> str:
    return "|".join(values)


def _form_vote(kind: str, v: Column) -> Column:
    """A stricter regular expression or check than the one that found the span."""
    strict = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}$",
        "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": r"^(?:[0-9]{16,19}|[0-9]{4}(?:\x20[0-9]{2,7}){3,4}|[0-9]{4}(?:-[0-9]{2,7}){3,4})$",
        "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}$",
        "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
        "local": r"^\(?[2-9][0-9]{2}[).-]\x20?[2-9][0-9]{2}[.-][0-9]{4}$",
        "written": r"(?i)^[a-z0-9][^\[(]*[\[(]at[\])].*[\[(]dot[\])]\x20?[a-z]{2,24}$",
    }
    if kind == "iban":
        return _yes(v.rlike(r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+"))
    if kind == "name":
        return _yes(v.rlike(rf"^(?:{_any(TITLES)})\.?\x20"))
    return _either(v.rlike(strict[kind]))


def _gazetteer_vote(kind: str, v: Column) -> Column:
    if kind in ("email", "written"):
        return _either(v.rlike(rf"(?i)[.\x20\])](?:{_any(TOP_DOMAINS)})$"))
    if kind == "ip":
        return _either(~v.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|192\.168|169\.254)\."))
    if kind == "card":
        return _either(v.rlike(r"^(?:4|5[1-5]|2[2-7]|6011|65|3[457])"))
    if kind == "phone":
        return _either(v.rlike(rf"^\+(?:{_any(CALLING_CODES)})"))
    if kind == "ssn":
        return _no(v.isin("078-05-1120", "219-09-9999", "123-45-6789"))
    if kind == "iban":
        return _either(v.rlike(rf"^(?:{_any(IBAN_COUNTRIES)})"))
    if kind == "name":
        return _yes(v.rlike(rf"(?:^|\x20)(?:{_any(GIVEN_NAMES)})(?:\x20|$)"))
    return F.lit(ABSTAIN)


def _votes(kind: str, s: Column) -> Column:
    """The labelers' votes as one number, base 3."""
    beside = r"[\p{L}\p{Nd}_/=@]"
    cast = [_form_vote(kind, s["value"]), _gazetteer_vote(kind, s["value"]),
            _yes(s["before"].rlike(rf"(?i)(?<!\p{{L}})(?:{CUES[kind]})(?!\p{{L}})")),
            _no(s["before"].rlike(rf"(?i)(?<!\p{{L}})(?:{WARNINGS})(?!\p{{L}})[^\p{{L}}]{{0,4}}$")),
            _either(~(s["before"].rlike(beside + "$") | s["after"].rlike("^" + beside)))]
    total = F.lit(0)
    for i, v in enumerate(cast):
        total = total + v * 3**i
    return total


def _shape(s: Column) -> Column:
    """Three features of a span that no labeler reads: it is long, it has separators, nothing but blanks before it."""
    v = s["value"]
    bits = [F.length(v) > 18, v.rlike(r"[\x20()-]"), s["before"].rlike(r"^[\x20\x09-\x0D]*$")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def candidates(docs: DataFrame) -> DataFrame:
    """All columns of `docs` as `row`, plus `spans`: (rank, start, end, votes, shape) by kind, then by start.

    Candidates of other kinds that overlap a base span are left out.
    """
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("t"))
    for kind, pattern in {**BASE, **EXTRA}.items():
        rows = _found(rows, kind, pattern)
        rows = _passing(rows, kind)

    def narrow(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
            _votes(kind, s).alias("votes"), _shape(s).alias("shape")))

    rows = rows.withColumn("base", F.concat(*[narrow(k) for k in BASE]))
    rows = rows.withColumn("extra", F.concat(*[narrow(k) for k in EXTRA]))
    free = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("row", F.concat("base", F.when(F.size("extra") > 0, free).otherwise(F.col("extra"))).alias("spans"))


# ---- reliabilities and the classifier -----------------------------------------------------------

#: By labeler, by kind (one entry for all kinds where the rule is the same), by truth: the chance of each vote.
Chances = list[list[dict[int, list[float]]]]


class Model(NamedTuple):
    """Chances of each vote by labeler, kind and truth, share of private spans by kind, and the classifier's weights."""

    votes: Chances
    shares: list[float]
    kind_weights: list[float]
    vote_weights: list[list[float]]
    shape_weights: list[float]


def _split(votes: int) -> list[int]:
    return [votes // 3**i % 3 for i in range(len(LABELERS))]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 40.0), -40.0)))


def _tables(chances: Chances, rank: int | None) -> list[dict[int, list[float]]]:
    """The table of each labeler for a kind; for none, what is expected of a labeler."""
    expected = {y: list(p) for y, p in _PRIOR.items()}
    return [t[0] if len(t) == 1 else expected if rank is None else t[rank] for t in chances]


def _posterior(chances: Chances, share: float, rank: int | None, cast: list[int]) -> float:
    x = math.log(share / (1 - share))
    return _sigmoid(x + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(_tables(chances, rank), cast)))


def estimate(patterns: list[tuple[int, int, int, int]]) -> tuple[Chances, list[float]]:
    """Expectation-maximisation on (rank, votes, shape, count): chances of each vote, and shares of private spans.

    Labelers are taken as independent given the truth. The expected votes count as _STRENGTH observations, so that a
    truth nobody has seen keeps a meaning, and which of the two is "private" is settled.
    """
    def tables(strength: float) -> Chances:
        return [[{y: [p * strength for p in _PRIOR[y]] for y in (0, 1)} for _ in (KINDS if i < OWN_RULES else "1")]
                for i in range(len(LABELERS))]

    chances, shares = tables(1.0), [0.5] * len(KINDS)
    split = [(rank, _split(votes), n) for rank, votes, _, n in patterns]
    for _ in range(_ROUNDS):
        seen, kinds = tables(_STRENGTH), [[2.0, 2.0] for _ in KINDS]
        for rank, cast, n in split:
            p = _posterior(chances, shares[rank], rank, cast)
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                kinds[rank][y] += w
                for table, v in zip(_tables(seen, rank), cast):
                    table[y][v] += w
        chances = [[{y: [x / sum(t[y]) for x in t[y]] for y in (0, 1)} for t in own] for own in seen]
        shares = [k[1] / (k[0] + k[1]) for k in kinds]
    return chances, shares


def learn(patterns: list[tuple[int, int, int, int]]) -> Model:
    """The classifier: logistic regression of the patterns' probabilities on kind, votes and shape.

    A pattern weighs by the logarithm of its count, so a frequent kind does not drown a rare one. Every possible
    combination of votes takes part with a small weight and an even chance before its votes, for those not seen yet.
    """
    chances, shares = estimate(patterns)
    rows = [(rank, _split(votes), shape, math.log1p(n), _posterior(chances, shares[rank], rank, _split(votes)))
            for rank, votes, shape, n in patterns]
    rows += [(None, _split(v), 0, 0.1, _posterior(chances, 0.5, None, _split(v))) for v in range(3 ** len(LABELERS))]
    kinds, votes = [0.0] * len(KINDS), [[0.0] * 3 for _ in LABELERS]
    shapes, bias = [0.0] * 3, 0.0
    whole = sum(r[3] for r in rows)
    for _ in range(_STEPS):
        g_kinds, g_votes, g_shapes, g_bias = [0.0] * len(KINDS), [[0.0] * 3 for _ in LABELERS], [0.0] * 3, 0.0
        for rank, cast, shape, w, p in rows:
            x = bias + sum(t[v] for t, v in zip(votes, cast)) + sum(s for i, s in enumerate(shapes) if shape >> i & 1)
            d = w * (p - _sigmoid(x + (kinds[rank] if rank is not None else 0.0))) / whole
            g_bias += d
            if rank is not None:
                g_kinds[rank] += d
            for t, v in zip(g_votes, cast):
                t[v] += d
            for i in range(3):
                g_shapes[i] += d * (shape >> i & 1)
        step, decay = 4.0, 1 - 4.0 * 1e-4
        bias += step * g_bias
        kinds = [decay * x + step * g for x, g in zip(kinds, g_kinds)]
        votes = [[decay * x + step * g for x, g in zip(a, b)] for a, b in zip(votes, g_votes)]
        shapes = [decay * x + step * g for x, g in zip(shapes, g_shapes)]
    return Model(chances, shares, [round(k + bias, 9) for k in kinds],
                 [[round(x, 9) for x in t] for t in votes], [round(x, 9) for x in shapes])


def train(found: DataFrame) -> Model:
    """Fit the model to the spans of all rows of `candidates`. The driver gets one row for each pattern of votes."""
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.rank", "s.votes", "s.shape").agg(F.count("*").alias("n"))
    return learn(sorted((r["rank"], r["votes"], r["shape"], r["n"]) for r in seen.collect()))


def decide(found: DataFrame, model: Model) -> DataFrame:
    """`candidates` without the spans of other kinds that the classifier rejects."""
    def score(s: Column) -> Column:
        x = F.get(F.array(*map(F.lit, model.kind_weights)), s["rank"])
        for i, w in enumerate(model.vote_weights):
            x = x + F.get(F.array(*map(F.lit, w)), (F.floor(s["votes"] / 3**i) % 3).cast("int"))
        for i, w in enumerate(model.shape_weights):
            x = x + F.shiftright(s["shape"], i).bitwiseAND(1) * w
        return x

    least = math.log(THRESHOLD / (1 - THRESHOLD))
    return found.withColumn("spans", F.filter("spans", lambda s: (s["rank"] < len(BASE)) | (score(s) >= least)))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda s: F.struct(
        s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["rank"]).alias("kind")))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of `docs` plus `spans`: an array of (rank, start, end, kind) in order of kind, then of start.

    Positions are code points, ends open. Null and empty texts have no spans; repeated rows are scanned alike. A column
    named spans is replaced. Without a model, one is trained on all rows of `docs` first.
    """
    model = model or train(candidates(docs.select("text")))
    found = candidates(docs.drop("spans"))
    return decide(found, model).select("row.*", _named(F.col("spans")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of their spans and all spans as text. The texts are read once."""
    found = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = store(found.select("row.doc_id", "spans"), "candidates")
    decided = decide(found, train(found)).select("doc_id", _named(F.col("spans")).alias("spans"))

    def of_rank(i: int) -> Column:
        return F.filter("spans", lambda s: s["rank"] == i)

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return decided.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
                          written(F.col("spans")).alias("spans"))
