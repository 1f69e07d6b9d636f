"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Wider patterns give
further candidates. Labelers vote on every candidate, each with yes, no or abstain: the strict format
(checksums, ranges), gazetteers (domains, calling codes, key prefixes, reserved networks), the words
before it, its edges, and its variety of characters. Expectation-maximisation estimates how reliable
each labeler is and gives every pattern of votes a posterior; a logistic span classifier is trained on
these posteriors over the features of the span, and adds the candidates it scores at 0.5 or more.

DataFrame functions only. Spans are found inside the row (offsets are sums of lengths of matches and
of the pieces between them), so nothing but counts of vote patterns is shuffled. Those counts are
over all documents; the number of patterns is bounded by the codes (``PATTERN_BOUND``), whatever the
size of the input, and the two small models are fitted on them.

Offsets are code points, the end exclusive. Nulls: a null text is an empty one; null or repeated
doc_ids give a row each. Without candidates the classifier adds nothing. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, text_or_empty

# Fixed patterns of the base kinds. They match what the plain forms match, leftmost first; possessive
# repeats and the look-behind only keep long runs from being tried again at each of their characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Base kinds in listed order.
BASE = ("email", "ip", "card", "phone")

# Wider patterns: (kind, pattern).
WIDER = (
    ("email", r"(?i)[A-Za-z0-9._%+-]++ ?\(at\) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)) ?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+()./-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("key", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z]{4}[A-Z0-9]{12,36}(?![A-Za-z0-9])"),
    ("secret", r"(?i)(?:password|passwd|token|secret|api_key)\s?=\s?\"?[A-Za-z0-9_./+-]{8,}+\"?"),
)
KINDS = (*BASE, "ssn", "iban", "key", "secret")

# Gazetteers and context words.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|be|us|ca|mx|br)$"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_PREFIXES = r"^(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)"
RESERVED_IP = r"^(?:0|10|127|169\.254|192\.168|255)\."
BEFORE_YES = r"(?i)(?:e-?mail|mail|contact|write to|call|phone|tel|fax|mobile|whatsapp|ip|address|host|card|visa|iban|account|ssn|social security|password|token|secret|key|login|user)\W{0,4}$"
BEFORE_NO = r"(?i)(?:version|section|chapter|page|isbn|issn|doi|order|invoice|build|release|fig|figure|table|no|nr)\W{0,3}$"
_CONTEXT = 24

ABSTAIN, NO, YES = 0, 1, 2
LABELERS = ("strict", "gazetteer", "context", "edges", "variety")
#: Values of each feature code beside the kind and the votes.
LENGTHS, DIGITS = 4, 3
PATTERN_BOUND = len(KINDS) * 3 ** len(LABELERS) * LENGTHS * DIGITS
EM_ROUNDS, FIT_ROUNDS = 30, 300


def found(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, leftmost and not overlapping."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("value")))
    return F.aggregate(pairs, at, step)["out"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits_of(value))
    if kind == "card":
        return n.between(12, 19) & passes_luhn(digits_of(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _matches(text: Column, needed: Column, pattern: str) -> Column:
    """Spans of a pattern, searched only where the text holds what it needs."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(needed, found(text, pattern)).otherwise(none)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def _labelled(kind: str, text: Column, spans: Column, base: bool, checked: bool) -> Column:
    """Spans with kind, codes of the votes and of the features."""

    def codes(s: Column) -> Column:
        v = s["value"]
        before = F.substring(text, F.greatest(s["start"] - _CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(_CONTEXT)))
        edge_before = F.substring(text, F.greatest(s["start"], F.lit(1)), F.when(s["start"] > 0, F.lit(1)).otherwise(F.lit(0)))
        edge_after = F.substring(text, s["end"] + 1, F.lit(1))
        n_digits = F.length(digits_of(v))
        varied = F.size(F.array_distinct(F.split(F.regexp_replace(v, r"[^A-Za-z0-9]", ""), "")))
        vote = lambda yes, no: F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)
        if kind == "iban":
            strict = vote(F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34), F.lit(True))
        elif kind in ("key", "secret"):
            strict = vote((n_digits >= 2) | F.rlike(v, F.lit(KEY_PREFIXES)), F.lit(True))
        elif kind == "ssn":
            strict = vote(~F.rlike(v, F.lit(r"^(?:000|666|9)|-00-|-0000$")), F.lit(True))
        else:
            strict = F.lit(YES) if checked else F.lit(ABSTAIN)
        gazetteer = {
            "email": vote(F.rlike(v, F.lit(DOMAINS)), F.lit(False)),
            "phone": vote(F.rlike(v, F.lit(CALLING_CODES)), F.startswith(v, F.lit("+"))),
            "ip": vote(F.lit(False), F.rlike(v, F.lit(RESERVED_IP))),
            "key": vote(F.rlike(v, F.lit(KEY_PREFIXES)), F.lit(False)),
            "secret": vote(F.rlike(v, F.lit(r"(?i)^(?:password|passwd)")), F.lit(False)),
        }.get(kind, F.lit(ABSTAIN))
        context = F.lit(YES) if kind == "secret" else vote(F.rlike(before, F.lit(BEFORE_YES)), F.rlike(before, F.lit(BEFORE_NO)))
        edges = vote(F.rlike(F.concat(edge_before, F.lit("x"), edge_after), F.lit(r"^[\s\"'(<\[,;:]?x[\s\"')>\].,;:!?]?$")), F.lit(True))
        variety = vote(varied >= 5, varied <= 2)
        length = F.when(F.length(v) < 12, 0).when(F.length(v) < 16, 1).when(F.length(v) < 24, 2).otherwise(3)
        share = F.when(n_digits * 4 < F.length(v), 0).when(n_digits * 4 < F.length(v) * 3, 1).otherwise(2)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            *[c.cast("int").alias(name) for name, c in zip(LABELERS, (strict, gazetteer, context, edges, variety), strict=True)],
            length.cast("int").alias("length"),
            share.cast("int").alias("digits"),
        )

    return F.transform(spans, codes)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and further candidates with the codes of votes and features."""
    text = F.col("text")
    read = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    read = read.select("doc_id", "text", F.rlike("text", F.lit("[0-9]")).alias("digit"))
    has = lambda s: F.contains(text, F.lit(s))
    needed = {"email": has("@") & has("."), "ip": F.col("digit") & has("."), "card": F.col("digit"), "phone": F.col("digit") & has("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    # What every match of a wider pattern holds: no match is lost by asking for it first.
    holds = {"email": F.rlike(text, F.lit(r"(?i)\(at\)")), "phone": F.col("digit") & (has("-") | has(".")), "ssn": F.col("digit") & has("-"), "iban": F.col("digit"), "key": F.col("digit"), "secret": has("=")}
    cut = read.select("doc_id", "text", *[_checked(k, _matches(text, needed[k], patterns[k])).alias(k) for k in BASE], *[_matches(text, holds[kind], p).alias(f"more{i}") for i, (kind, p) in enumerate(WIDER)])
    base = F.concat(*[_labelled(k, text, F.col(k), True, True) for k in BASE])
    more = F.concat(*[_labelled(kind, text, F.col(f"more{i}"), False, False) for i, (kind, _) in enumerate(WIDER)])
    both = cut.select("doc_id", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return both.select("doc_id", F.concat("base", apart).alias("spans"))


def vote_patterns(spans: DataFrame) -> list[tuple]:
    """(kind, votes..., length, digits, n) over all candidates; at most ``PATTERN_BOUND`` rows."""
    rows = spans.select(F.explode("spans").alias("s")).select("s.*")
    return [tuple(r) for r in rows.groupBy("kind", *LABELERS, "length", "digits").count().collect()]


def fit_labelers(patterns: Iterable[tuple]) -> tuple[float, list[list[list[float]]], list[float]]:
    """EM for the share of true spans and, per labeler, the chance of each vote given the truth.

    Labelers are taken as independent given the truth; counts are smoothed by one vote of each sort, with
    a mild prior that a labeler is right more often than wrong.
    """
    patterns = list(patterns)
    n = len(LABELERS)
    share = 0.5
    chance = [[[0.4, 0.4, 0.2], [0.4, 0.1, 0.5]] for _ in range(n)]  # [truth][vote]
    posterior = [0.5] * len(patterns)
    for _ in range(EM_ROUNDS):
        for i, p in enumerate(patterns):
            yes, no = math.log(share), math.log(1 - share)
            for k in range(n):
                no += math.log(chance[k][0][p[1 + k]])
                yes += math.log(chance[k][1][p[1 + k]])
            posterior[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        total = sum(p[-1] for p in patterns)
        share = (1 + sum(q * p[-1] for p, q in zip(patterns, posterior, strict=True))) / (2 + total)
        for k in range(n):
            # prior votes: a true span gets a yes twice as often as a no, a false one the reverse
            counts = [[1.0, 2.0, 1.0], [1.0, 1.0, 2.0]]
            for p, q in zip(patterns, posterior, strict=True):
                counts[0][p[1 + k]] += (1 - q) * p[-1]
                counts[1][p[1 + k]] += q * p[-1]
            chance[k] = [[c / sum(row) for c in row] for row in counts]
    return share, chance, posterior


#: Sizes of the codes the classifier sees, in the order of a pattern.
_CODES = (len(KINDS), *[3] * len(LABELERS), LENGTHS, DIGITS)


def fit_classifier(patterns: list[tuple], posterior: list[float], l2: float = 1.0) -> tuple[float, list[list[float]]]:
    """Logistic regression of the posterior on one weight per code value; gradient descent over pattern counts."""
    bias, weights = 0.0, [[0.0] * size for size in _CODES]
    total = sum(p[-1] for p in patterns) or 1
    for _ in range(FIT_ROUNDS):
        g_bias, g = 0.0, [[0.0] * size for size in _CODES]
        for p, q in zip(patterns, posterior, strict=True):
            z = bias + sum(w[c] for w, c in zip(weights, p, strict=False))
            e = p[-1] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q)
            g_bias += e
            for row, c in zip(g, p, strict=False):
                row[c] += e
        bias -= g_bias / total
        weights = [[w - (d + l2 * w) / total for w, d in zip(ws, ds, strict=True)] for ws, ds in zip(weights, g, strict=True)]
    return bias, weights


def span_score(s: Column, model: tuple[float, list[list[float]]]) -> Column:
    bias, weights = model
    terms = [F.element_at(F.array(*[F.lit(float(w)) for w in ws]), s[name] + 1) for name, ws in zip(("kind", *LABELERS, "length", "digits"), weights, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(bias))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans of (start, kind, end, base): base spans and those the classifier adds."""
    spans = materialise(candidates(docs))
    patterns = vote_patterns(spans)
    model = fit_classifier(patterns, fit_labelers(patterns)[2]) if patterns else (-1.0, [[0.0] * size for size in _CODES])
    kept = F.filter("spans", lambda s: s["base"] | (span_score(s, model) >= 0))
    # of added spans that overlap, the one that starts first stays (then the longer one)
    added = F.sort_array(F.transform(F.filter(kept, lambda s: ~s["base"]), lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    own = F.transform(F.filter(kept, lambda s: s["base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(True).alias("base")))
    out_type = "array<struct<start:int,kind:int,end:int,base:boolean>>"

    def take(acc: Column, s: Column) -> Column:
        new = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end"), F.lit(False).alias("base"))
        free = F.size(acc) == 0
        return F.when(free, F.concat(acc, F.array(new))).when(F.element_at(acc, -1)["end"] <= s["start"], F.concat(acc, F.array(new))).otherwise(acc)

    chosen = F.aggregate(added, F.array().cast(out_type), take)
    return spans.select("doc_id", F.sort_array(F.concat(own.cast(out_type), chosen)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans give one mark."""
    name = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], between, F.lit("["), F.upper(F.element_at(name, s["kind"] + 1)), F.lit("]"))
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(new).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    out = personal_data(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
