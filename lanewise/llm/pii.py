"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Only DataFrame expressions: texts stay in the JVM, spans are arrays of structs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import stored, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: Base patterns. Runs are taken whole and entered at their start only (or where the match
#: before ended), which finds the same leftmost matches without trying every place of a run.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, whose matches are only candidates.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|@) ?{_HOST}{{1,63}}+"
    rf"(?: ?(?:\(dot\)|\[dot\]|\.) ?{_HOST}{{1,63}}+)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Words before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b",
}
CONTEXT_AGAINST = r"(?i)\b(?:version|isbn|order|invoice|sku|serial|part|build|release|example)\b"
CONTEXT_CHARS = 40
#: Gazetteers: endings of domains, first digits of card issuers, reserved address ranges.
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?(?:1|33|34|44|49|39|31)?[\x20(.-]*[2-9]",
}
RESERVED_IP = r"^(?:10|127|0|192\.168|169\.254)\."
LABELERS = ("pattern", "validity", "gazetteer", "context", "edges")
ROUNDS = 8
ACCEPT_FROM = 0.5


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def valid(kind: str, span: Column) -> Column:
    """The check of a base kind on a whole match."""
    n = F.length(digits(span))
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return span.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits(span))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def found(text: Column, kind: str, pattern: str) -> Column:
    """`start, ord, end, kind, value` of all leftmost matches, in code points.

    The pieces between the matches and the matches themselves add up to the places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), values.alias("value"))
    empty = F.array().cast("array<struct<start:long,ord:int,end:long,kind:string,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        span = F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("ord"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            pair["value"].alias("value"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    # The last piece has no match after it.
    spans = F.aggregate(F.slice(pairs, 1, F.size(values)), start, step, lambda state: state["spans"])
    return F.when(F.size(values) > 0, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_passing(text, kind) for kind in KINDS]))


def _passing(text: Column, kind: str) -> Column:
    return F.filter(found(text, kind, BASE[kind]), lambda s: valid(kind, s["value"]))


def loose_spans(text: Column, base: Column) -> Column:
    """Matches of the looser patterns that touch no base span."""
    kinds = F.concat(*[found(text, kind, LOOSE[kind]) for kind in KINDS])
    return F.filter(
        kinds, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def by_kind(kind: Column, choose) -> Column:
    expr = None
    for name in KINDS:
        expr = F.when(kind == name, choose(name)) if expr is None else expr.when(kind == name, choose(name))
    return expr


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(text: Column, span: Column, strict: bool) -> dict[str, Column]:
    """1 for personal data, -1 against, 0 without an opinion, from each labeler."""
    value, kind = span["value"], span["kind"]
    start, end = span["start"].cast("int"), span["end"].cast("int")
    n_before = F.least(F.lit(CONTEXT_CHARS), start)
    before = F.substring(text, start + 1 - n_before, n_before)
    edge = F.concat(F.substring(before, -1, 1), F.substring(text, end + 1, F.lit(1)))
    no = F.lit(False)
    ok = by_kind(kind, lambda k: valid(k, value) if k in ("card", "phone") else F.lit(strict))
    known = by_kind(
        kind,
        lambda k: vote(~value.rlike(RESERVED_IP), value.rlike(RESERVED_IP))
        if k == "ip"
        else vote(
            (digits(value) if k == "card" else value).rlike(GAZETTEER[k]),
            ~(digits(value) if k == "card" else value).rlike(GAZETTEER[k]),
        ),
    )
    return {
        "pattern": vote(F.lit(strict), no),
        "validity": vote(ok, ~ok),
        "gazetteer": known,
        "context": vote(by_kind(kind, lambda k: before.rlike(CONTEXT[k])), before.rlike(CONTEXT_AGAINST)),
        # Letters or digits right beside a span speak for a longer token of another kind.
        "edges": vote(~edge.rlike("[0-9A-Za-z_=]"), edge.rlike("[0-9A-Za-z_=]")),
    }


def features(span: Column, voted: dict[str, Column]) -> dict[str, Column]:
    """What the span classifier sees: the votes, the kind, and the length in steps of four."""
    length = F.least(F.lit(8), F.floor((span["end"] - span["start"]) / 4)).cast("int")
    return voted | {"kind": span["kind"], "length": length}


@dataclass
class SpanModel:
    """Log-odds of each value of each feature, and the prior."""

    prior: float = 0.0
    weights: dict[str, dict] = field(default_factory=dict)
    reliability: dict[str, float] = field(default_factory=dict)

    def log_odds(self, seen: dict[str, Column]) -> Column:
        total = F.lit(self.prior)
        for name, values in self.weights.items():
            for value, weight in values.items():
                total = total + F.when(seen[name] == value, weight).otherwise(0.0)
        return total


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Labeler reliabilities by EM over all candidates of all texts, then the span classifier.

    The corpus is reduced once to counts per combination of features, of which there are a
    bounded number; each round of EM and the fit are one aggregate over that table, and only
    sums reach the driver. The classifier is naive Bayes on the posteriors as soft labels.
    """
    rows = texts(docs, id_col, text_col).where(F.col("text").isNotNull()).select("text")
    spanned = rows.withColumn("base", base_spans(F.col("text")))
    spanned = spanned.withColumn("loose", loose_spans(F.col("text"), F.col("base")))
    # The spans are decided before they are exploded, so that texts are not copied per span.
    def described(spans: str, strict: bool) -> Column:
        of = lambda s: features(s, votes(F.col("text"), s, strict))
        return F.transform(spans, lambda s: F.struct(*[c.alias(n) for n, c in of(s).items()]))

    seen = F.concat(described("base", True), described("loose", False))
    names = [*LABELERS, "kind", "length"]
    spans = spanned.select(F.explode(seen).alias("s")).select("s.*")
    table = stored(spans.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    reliability = dict.fromkeys(LABELERS, 0.8)
    prior = 0.5
    for _ in range(ROUNDS):
        p = _posterior(prior, reliability)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * p).alias("p")]
        for name in LABELERS:
            right = F.when(F.col(name) == 1, p).when(F.col(name) == -1, 1 - p).otherwise(0)
            sums += [
                F.sum(F.col("n") * right).alias(f"right_{name}"),
                F.sum(F.col("n") * F.abs(name)).alias(f"voted_{name}"),
            ]
        r = table.agg(*sums).first()
        if not r["n"]:
            return SpanModel(reliability=reliability)
        prior = (r["p"] + 1) / (r["n"] + 2)
        # A labeler is taken to be better than chance, which also keeps the classes apart.
        reliability = {
            name: min(0.99, max(0.55, (r[f"right_{name}"] + 4) / (r[f"voted_{name}"] + 5)))
            for name in LABELERS
        }
    p = _posterior(prior, reliability)
    model = SpanModel(_logit(prior), {}, reliability)
    pairs = [F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]
    long = F.explode(F.array(*pairs))
    soft = (
        table.select("n", p.alias("p"), long.alias("f"))
        .groupBy("f.name", "f.value")
        .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        .collect()
    )
    total = {n: [sum(r[c] for r in soft if r["name"] == n) for c in ("yes", "no")] for n in names}
    for r in soft:
        yes, no = ((r[c] + 1) / (t + 10) for c, t in zip(("yes", "no"), total[r["name"]]))
        value = r["value"] if r["name"] == "kind" else int(r["value"])
        model.weights.setdefault(r["name"], {})[value] = math.log(yes / no)
    return model


def _posterior(prior: float, reliability: dict[str, float]) -> Column:
    total = F.lit(_logit(prior))
    for name, right in reliability.items():
        total = total + F.col(name) * _logit(right)
    return 1 / (1 + F.exp(-total))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by comma."""
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
    )


def personal_data(
    docs: DataFrame,
    model: SpanModel | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """`doc_id, base, spans` per row (and `row` with `carry`): arrays of spans with their values.

    `base` are the matches of the base patterns that pass their check. `spans` adds candidates
    of the looser patterns that the classifier accepts and that touch no base span. Places are
    code points, ends exclusive; order is by start, then kind. Null text is empty and has no
    span; repeated rows have equal spans; an empty table gives none.
    """
    model = model or train(docs, id_col, text_col)
    rows = texts(docs, id_col, text_col, carry).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("loose", loose_spans(F.col("text"), F.col("base")))
    accepted = F.filter(
        "loose",
        lambda s: model.log_odds(features(s, votes(F.col("text"), s, False))) >= _logit(ACCEPT_FROM),
    )
    return rows.withColumn("spans", F.array_sort(F.concat("base", accepted))).drop("text", "loose")
