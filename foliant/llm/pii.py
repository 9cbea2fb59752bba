"""Personal data: base patterns, and weak supervision that adds spans. DataFrame operations only.

What any pattern finds is evidence: base matches, base matches that fail their
check, and matches of wider patterns for every kind. Labelers (form, checksums
and ranges, gazetteers, context words) vote on each piece. Expectation-
maximisation over the table of vote patterns of each kind estimates how far
each labeler can be trusted, and a logistic span classifier is trained on the
labels it infers. Both work on tables of counts whose size depends on the number
of labelers and feature values, never on the corpus; the counts are of all
evidence. The classifier decides which wider matches become spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, unused

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns, each written so that a search takes linear time. A local
#: part can only begin where its run of characters does, or where the last
#: match ended; digit runs likewise. That changes no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a pattern can't match.
SIGN = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Wider patterns of the method, by the kind that a match would be.
AT, DOT = r"(?:\x20?[(\[{](?i:at)[)\]}]\x20?)", r"(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\.)"
WIDER = {
    "email": (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:{AT}|\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
        r"|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)"
    ),
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20?[(\[](?i:dot)[)\]]\x20?|\x20\.\x20|\.)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:3[47][0-9]{2}[\x20.-]{0,2}[0-9]{6}[\x20.-]{0,2}[0-9]{5}|(?:[0-9]{4}[\x20.-]{0,2}){3}[0-9]{2,7}+)(?![0-9])",
    "phone": (
        r"(?<![0-9A-Za-z+./-])(?:(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}"
        r"|00[1-9](?:[\x20.-]?[0-9]){8,13}|\(?0[1-9][0-9]{1,4}\)?[\x20/-][0-9]{5,8})(?![0-9A-Za-z]|[./-][0-9])"
    ),
}
WIDER_SIGN = {
    "email": r"[(\[{](?i:at)[)\]}]|\x20@|@\x20|\x20dot\x20",
    "ip": r"[0-9](?:\[\.\]|\(\.\)|\x20?[(\[](?i:dot)|\x20\.\x20|\.)[0-9]",
    "card": r"[0-9]{4}[\x20.-]{0,2}[0-9]{4}",
    "phone": r"[0-9][)]?[\x20./-][0-9]|00[1-9]",
}

# Gazetteers and context words: short lists; the votes that they give are only evidence, which is weighed.
TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|io|info|biz|name|app|dev|cloud|online|shop|site|eu|de|fr|es|it|uk|ie|pt|pl|cz|sk|hu|ro|bg|gr|hr|si|se|no|fi|dk|is|"
    "ru|ua|tr|il|ae|in|cn|jp|kr|tw|hk|sg|my|th|vn|id|ph|au|nz|za|ng|ke|eg|ma|us|ca|mx|br|ar|cl|co|pe|ve|at|ch|be|nl|lu|li|test|example"
)
COUNTRY_CODES = "1|7|20|27|3[0-469]|35[0-9]|37[0-9]|38[0-9]|4[013-9]|42[01]|5[1-8]|6[0-6]|8[1246]|9[0-58]|97[0-9]|21[1-8]|23[0-9]|25[0-8]"
ISSUERS = "4|5[0-8]|2[2-7]|3[04-9]|6[0-9]"
WORDS_OF = {
    "email": "e-?mail|mail|mailto|contact|reach|write|correo|courriel|kontakt|contacto",
    "phone": "tel|tel[eé]fono|t[eé]l[eé]phone|telefon|phone|call|mobile|cell|fax|contact|reach|whatsapp|sms|anruf|appel|m[oó]vil|handy|portable",
    "card": "card|visa|mastercard|maestro|amex|credit|debit|payment|paid|charge|karte|kreditkarte|tarjeta|carte|pago|zahlung",
    "ip": "ip|ipv4|host|server|client|address|adresse|direcci[oó]n|ping|login|from|connect|gateway|remote",
}
OTHER_WORDS = "isbn|issn|invoice|order|serial|version|release|ref|no|nr|id|doi|token|key|hash|code|part|model|sku|section|figure|table"
LABELERS = ["form", "check", "gazetteer", "context", "counter_context", "boundary"]


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.regexp_replace(match, "[^0-9]+", ".").rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int>>"
MATCH = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string,base:boolean,valid:boolean>>"
SCANNED = 64  # items of a block of _scan()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, kind: str, start: int, value: Callable, join: Callable, emit: Callable) -> Column:
    """emit(what ``join`` makes of the values of all items before, item) of each item.

    An accumulator that grows is copied at each step, so items are worked on in
    blocks: totals of blocks first, then each block from its own start.
    """

    def in_block(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, item: Column) -> Column:
            return F.struct(join(acc["at"], value(item)).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], item))).alias("out"))

        return F.aggregate(block, first, step, lambda acc: acc["out"])

    def run(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(start), lambda acc, item: join(acc, value(item))))
        starts = F.aggregate(totals, F.array(F.lit(start)), lambda acc, t: F.concat(acc, F.array(join(F.element_at(acc, -1), t))))
        return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda block, k: in_block(block, F.get(at, k)))))

    def whole(every: Column) -> Column:
        count = F.ceil(F.size(every) / SCANNED).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(every, k * SCANNED + 1, SCANNED))
        return F.when(F.size(every) > 0, _let(blocks, run)).otherwise(F.array().cast(kind))

    return _let(items, whole)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, kind: str, pattern: str, sign: str, base: bool) -> Column:
    """Matches with their places in code points, the 32 characters before (up to the match before) and the one behind.

    The text is split at the matches, and lengths are summed.
    """

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        n = F.size(hits)
        parts = _let(gaps, lambda g: F.arrays_zip(F.slice(g, 1, n).alias("gap"), hits.alias("hit"), F.slice(g, 2, n).alias("next")))

        def emit(at: Column, part: Column) -> Column:
            start = at + F.length(part["gap"])
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(part["hit"])).alias("end"), part["hit"].alias("hit"),
                F.right(part["gap"], F.lit(32)).alias("before"), F.left(part["next"], F.lit(1)).alias("after"), F.lit(base).alias("base"),
                _valid(kind, part["hit"]).alias("valid"),
            )

        return _scan(parts, MATCH, 0, lambda part: F.length(part["gap"]) + F.length(part["hit"]), _plus, emit)

    none = F.array().cast(MATCH)
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    return F.when(text.rlike(sign), found).otherwise(none)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _base_matches(text: Column) -> Column:
    return F.concat(*[_matches(text, k, BASE[k], SIGN[k], True) for k in KINDS])


def base_spans(text: Column) -> Column:
    """All base spans: the matches that pass their check."""
    return _bare(F.filter(_base_matches(text), lambda m: m["valid"]))


def _apart(matches: Column, others: Column) -> Column:
    """``matches`` that touch no valid one of ``others``, in time n log n."""
    keyed = "array<struct<start:int,own:int,clear:boolean,match:" + MATCH[6:-1] + ">>"

    def rows(every: Column, own: int) -> Column:
        return F.transform(every, lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), F.lit(True).alias("clear"), m.alias("match")))

    def with_clear(x: Column, clear: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["own"].alias("own"), (x["clear"] & clear).alias("clear"), x["match"].alias("match"))

    def forth(at: Column, x: Column) -> Column:
        return with_clear(x, at <= x["start"])

    def back(at: Column, x: Column) -> Column:
        return with_clear(x, at >= x["match"]["end"])

    both = F.array_sort(F.concat(rows(F.filter(others, lambda m: m["valid"]), 0), rows(matches, 1)))
    ends = _scan(both, keyed, -1, lambda x: F.when(x["own"] == 0, x["match"]["end"]).otherwise(-1), F.greatest, forth)
    starts = lambda x: F.when(x["own"] == 0, x["start"]).otherwise(2**31 - 1)
    clear = F.filter(_scan(F.reverse(ends), keyed, 2**31 - 1, starts, F.least, back), lambda x: (x["own"] == 1) & x["clear"])
    return F.when(F.size(matches) > 0, F.reverse(F.transform(clear, lambda x: x["match"]))).otherwise(F.array().cast(MATCH))


def _by_kind(kind: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, choice in choices.items():
        out = F.when(kind == name, choice).otherwise(out)
    return out.cast("int")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def _judged(m: Column) -> Column:
    """A match with its votes (1 personal, -1 not, 0 abstains) and features."""
    hit, kind = m["hit"], m["kind"]
    before, after = F.lower(m["before"]), m["after"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    national = F.regexp_replace(digits, "^00", "")
    form = _by_kind(kind, {
        "email": _vote(hit.rlike(r"^[A-Za-z0-9][^\s]*(?:@|[(\[{])"), hit.rlike(r"\sat\s|^[._%+-]")),
        "ip": _vote(hit.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|\[|\("), hit.contains(" ") | hit.rlike("[0-9]{4}")),
        "card": _vote(hit.rlike(r"^[0-9]{14,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$"), F.lit(True)),
        "phone": _vote(hit.rlike(r"^\+|^00|^\(?0|\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$"), hit.rlike("^[0-9]{3} [0-9]{3} [0-9]{4}$")),
    })
    gazetteer = _by_kind(kind, {
        "email": _vote(F.lower(hit).rlike(rf"(?:\.|\)|\]|\}}|\s)\s?(?:{TOP_DOMAINS})$"), hit.rlike("[0-9]$")),
        "ip": _vote(hit.rlike("^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])[^0-9]") & (F.length(digits) > 5), hit.rlike("^0|^2[3-9][0-9]") | (F.length(digits) < 5)),
        "card": _vote(digits.rlike(f"^(?:{ISSUERS})"), F.lit(True)),
        "phone": F.when(hit.rlike(r"^\+|^00"), _vote(national.rlike(f"^(?:{COUNTRY_CODES})"), F.lit(True)))
        .otherwise(_vote(digits.rlike("^0[1-9]|^[2-9][0-8][0-9][2-9]"), digits.rlike(r"^1|^00|^(?:[0-9])\1\1"))),
    })
    context = _by_kind(kind, {k: _vote(before.rlike(rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)")) for k, words in WORDS_OF.items()})
    votes = [
        form,
        _vote(m["valid"], F.lit(True)).cast("int"),
        gazetteer,
        context,
        _vote(F.lit(False), before.rlike(rf"(?:^|[^\p{{L}}])(?:{OTHER_WORDS})[ .:#=\"]*$")).cast("int"),
        _vote(
            ((F.length(before) == 0) | before.rlike(r"[\s(,;:<\"']$")) & ((F.length(after) == 0) | after.rlike(r"[\s),;:.>\"'!?]")),
            before.rlike(r"[0-9/\p{L}][-/.]?$") | after.rlike(r"[0-9/\p{L}]"),
        ).cast("int"),
    ]
    return F.struct(
        kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["base"].alias("base"), m["valid"].alias("valid"),
        *[v.alias(name) for v, name in zip(votes, LABELERS, strict=True)],
        F.least(F.floor(F.length(hit) / 6), F.lit(4)).cast("int").alias("length"),
        hit.contains(" ").alias("spaced"),
    )


def _evidence(text: Column) -> Column:
    """All matches, judged: those of the base patterns, valid or not, and wider ones that touch no valid one of these."""
    wider = F.concat(*[_matches(text, k, WIDER[k], WIDER_SIGN[k], False) for k in WIDER])
    return _let(_base_matches(text), lambda base: F.transform(F.concat(base, _apart(wider, base)), _judged))


def with_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and the judged matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), _evidence(text).alias("evidence"))


# ---- the label model: a few dozen rows of counts on the driver ----

Pattern = tuple[tuple[int, ...], int]


def label_model(
    patterns: list[Pattern], rounds: int = 50, trust: tuple[float, ...] = ()
) -> tuple[dict[tuple[int, ...], float], float, list[tuple[float, float]]]:
    """EM over (votes, count): posterior of each vote pattern, the prior, and each labeler's reliability by class.

    A labeler that speaks is right with one chance on personal data and another
    elsewhere. ``trust`` has the chances to start from and to smooth with (0.75
    if not given), so a labeler that never votes keeps its own.
    """
    k = len(patterns[0][0]) if patterns else 0
    trust = trust or (0.75,) * k
    prior, right = 0.5, [(t, t) for t in trust]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (a, b) in zip(votes, right, strict=True):
                odds += math.log(a / (1 - b)) if v > 0 else math.log((1 - a) / b) if v < 0 else 0.0
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, n in patterns)
        mass = sum(n * posterior[v] for v, n in patterns)
        prior = min(0.95, max(0.05, (mass + 1) / (total + 2)))
        for j in range(k):
            yes = sum(n * posterior[v] for v, n in patterns if v[j])
            no = sum(n * (1 - posterior[v]) for v, n in patterns if v[j])
            a = (sum(n * posterior[v] for v, n in patterns if v[j] > 0) + 10 * trust[j]) / (yes + 10)
            b = (sum(n * (1 - posterior[v]) for v, n in patterns if v[j] < 0) + 10 * trust[j]) / (no + 10)
            right[j] = (min(0.99, max(0.51, a)), min(0.99, max(0.51, b)))  # better than chance, by assumption
    return posterior, prior, right


def train_classifier(rows: list[tuple[list[float], float, int]], rounds: int = 300, rate: float = 1.0) -> list[float]:
    """Logistic regression on (features, soft label, count) rows, by gradient descent with a small ridge."""
    if not rows:
        return []
    w = [0.0] * len(rows[0][0])
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = [0.001 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, v in enumerate(x):
                if v:
                    slope[j] += (p - y) * v * n / total
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


FEATURES = [*LABELERS, "kind", "length", "spaced"]
TRUST = (0.75, 0.95, 0.75, 0.75, 0.75, 0.75)  # checksums and ranges are wrong least often


def _vector(row) -> list[float]:
    votes = [float(row[c]) for c in LABELERS]
    kinds = [float(row["kind"] == k) for k in KINDS[1:]]
    lengths = [float(row["length"] == k) for k in range(1, 5)]
    return [1.0, *votes, *kinds, *lengths, float(row["spaced"])]


def _chance(c: Column, w: list[float]) -> Column:
    weights = iter(w)
    terms = [F.lit(next(weights)), *[c[name] * F.lit(next(weights)) for name in LABELERS]]
    terms += [F.when(c["kind"] == k, next(weights)).otherwise(0.0) for k in KINDS[1:]]
    terms += [F.when(c["length"] == k, next(weights)).otherwise(0.0) for k in range(1, 5)]
    terms.append(F.when(c["spaced"], next(weights)).otherwise(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms)))


def train(found: DataFrame) -> list[float]:
    """The span classifier's weights, from all ``evidence`` of with_evidence(); none without evidence.

    Each kind has a label model of its own; one classifier learns from all.
    """
    each = found.select(F.explode("evidence").alias("c")).select("c.*")
    # Six labelers of three votes, four kinds, five lengths and a flag: at most 29,160 rows, whatever the corpus.
    counts = each.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    votes: dict[str, dict[tuple[int, ...], int]] = {}
    for r in counts:
        key, own = tuple(r[c] for c in LABELERS), votes.setdefault(r["kind"], {})
        own[key] = own.get(key, 0) + r["n"]
    posterior = {kind: label_model(sorted(own.items()), trust=TRUST)[0] for kind, own in votes.items()}
    return train_classifier(sorted((_vector(r), posterior[r["kind"]][tuple(r[c] for c in LABELERS)], r["n"]) for r in counts))


def all_spans(evidence: Column, w: list[float], least: float = 0.9) -> Column:
    """Base spans, and wider matches that pass their kind's check and whose chance is ``least`` or more.

    Of added ones that overlap the first stays.
    """
    base = _bare(F.filter(evidence, lambda c: c["base"] & c["valid"]))
    if not w:
        return F.array_sort(base, _by_place)
    likely = F.filter(evidence, lambda c: ~c["base"] & c["valid"] & (_chance(c, w) >= least))
    ordered = F.array_sort(_bare(likely), _by_place)
    flagged = "array<struct<span:" + SPAN[6:-1] + ",first:boolean>>"
    marked = _scan(ordered, flagged, 0, lambda s: s["end"], F.greatest, lambda at, s: F.struct(s.alias("span"), (at <= s["start"]).alias("first")))
    added = F.transform(F.filter(marked, lambda x: x["first"]), lambda x: x["span"])
    return F.array_sort(F.concat(base, added), _by_place)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, spans): base spans, and those with the ones that the classifier adds.

    Spans are in code points, end exclusive, by start and then kind as listed.
    Null and empty texts have none. Rows are told apart by doc_id and ``h``, a
    hash of the text; repeated rows have a row each. The time for a text grows
    with its length and, for many matches, as n log n.
    """
    found = stored(with_evidence(docs), "pii-evidence")
    base = _bare(F.filter("evidence", lambda c: c["base"] & c["valid"]))
    return found.select("doc_id", "h", F.array_sort(base, _by_place).alias("base"), all_spans(F.col("evidence"), train(found)).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_chars`` (if there) of the new text.

    The spans are found again where the text is, so no text is shuffled. A null
    text stays null, an empty one empty; repeated rows and rows without id are
    handled each for itself; no documents, no rows.
    """
    w = train(stored(with_evidence(docs).select("evidence"), "pii-evidence"))
    text = F.coalesce(F.col("text"), F.lit(""))
    (found,) = unused(docs, "spans")
    spans = docs.withColumn(found, _let(_evidence(text), lambda e: all_spans(e, w)))
    out = spans.withColumn("text", redacted(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _by_place(a: Column, b: Column) -> Column:
    return (
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(_rank(a["kind"]) < _rank(b["kind"]), -1)
        .when(_rank(a["kind"]) > _rank(b["kind"]), 1)
        .otherwise(0)
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """The personal-data contract: base counts, a digest of the base spans, and all spans as text."""
    found = find_spans(docs)
    counts = [_count(F.col("base"), k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; what overlaps is replaced once, as the first.

    ``spans`` are in order. Blocks of spans are cut out of the text, and each is redacted by itself.
    """
    flagged = "array<struct<kind:string,start:int,end:int,after:int>>"

    def mark(at: Column, s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), at.alias("after"))

    def block(every: Column, k: Column) -> Column:
        """From where the spans before this block end to where its own do; places count from there."""
        own = F.slice(every, k * SCANNED + 1, SCANNED)

        def cut(own: Column) -> Column:
            first = F.get(own, F.lit(0))["after"]
            last = F.array_max(F.transform(own, lambda s: F.greatest(s["end"], s["after"])))

            def one(part: Column) -> Column:
                pieces = F.transform(own, lambda s: F.concat(
                    F.substring(part, s["after"] - first + 1, F.greatest(F.lit(0), s["start"] - s["after"])),
                    F.when(s["start"] >= s["after"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")),
                ))
                return F.array_join(pieces, "")

            return _let(F.substring(text, first + 1, last - first), one)

        return _let(own, cut)

    def whole(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(every) / SCANNED).cast("int") - 1), lambda k: block(every, k))
        rest = F.substring(text, F.array_max(F.transform(every, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(blocks, ""), rest)

    marked = _scan(spans, flagged, 0, lambda s: s["end"], F.greatest, mark)
    return F.when(F.size(spans) > 0, _let(marked, whole)).otherwise(text)
