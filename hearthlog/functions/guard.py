"""Personal identifiers and instruction attacks as column expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# ---- fixed values ----
PII_PATTERNS = {
    "PHONE_NUMBER": r"(?<![\d\w])(?:\+?91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}(?!\d)",
    "IN_AADHAAR": r"(?<![\d+])\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b(?!\d)",
    "IN_PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "IN_UPI": r"(?i)\b[\w.\-]{2,}@(?:okaxis|oksbi|okhdfcbank|okicici|ybl|paytm|upi|ibl|axl)\b",
    "IN_VEHICLE": r"\b[A-Z]{2}\s?\d{1,2}\s?[A-Z]{1,3}\s?\d{4}\b",
}
# kinds the source system takes from a language engine; the patterns are ours
PII_PATTERNS_GENERIC = {
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b",
    "CREDIT_CARD": r"\b\d{13,19}\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}
PII_LABELS = {
    "PHONE_NUMBER": "[phone]", "EMAIL_ADDRESS": "[email]", "CREDIT_CARD": "[card]",
    "IBAN_CODE": "[bank]", "IP_ADDRESS": "[ip]", "IN_AADHAAR": "[aadhaar]", "IN_PAN": "[pan]",
    "IN_UPI": "[upi]", "IN_VEHICLE": "[vehicle]",
}
ATTACK_PATTERNS = [
    ("override",
     r"\b(?:ignore|disregard|forget|override|bypass)\b[^.?!]{0,40}"
     r"\b(?:instruction|rule|prompt|guideline|restriction|system)"),
    ("reveal-prompt",
     r"\b(?:show|print|repeat|reveal|output|tell me)\b[^.?!]{0,30}"
     r"\b(?:system prompt|your prompt|your instructions|persona card|initial prompt)"),
    ("impersonate-owner",
     r"\b(?:i am|i'm|this is)\s+(?:actually\s+)?(?:{owner}the owner|your owner|your creator)\b"),
    ("unlock",
     r"\b(?:developer mode|god mode|dan mode|jailbreak|no restrictions|without any (?:filter|limit))"),
    ("extract-secrets",
     r"\b(?:tell|give|list|share)\b[^.?!]{0,30}\b(?:his|{owners}the owner's)\b[^.?!]{0,25}"
     r"\b(?:secret|password|private|personal detail|phone number|address|aadhaar|bank)"),
    ("roleplay-escape",
     r"\b(?:pretend|act as if|roleplay|imagine)\b[^.?!]{0,40}"
     r"\b(?:you have no|there are no|you can ignore|without.{0,15}rules)"),
]
# kinds that win when two findings start together; the rest rank last
PII_SPECIFICITY = {"PHONE_NUMBER": 0, "IN_AADHAAR": 1, "IN_PAN": 1, "IN_UPI": 1, "IN_VEHICLE": 1}
# ---- end of fixed values ----

PII_KINDS = list(PII_PATTERNS) + list(PII_PATTERNS_GENERIC)
# word characters and digits of every script count
_ALL = {kind: "(?U)" + p for kind, p in {**PII_PATTERNS, **PII_PATTERNS_GENERIC}.items()}


def attack_patterns(owner_names: list[str] = ()) -> list[tuple[str, str]]:
    owner = "".join(f"{n}|" for n in owner_names)
    owners = "".join(f"{n}'s|" for n in owner_names)
    return [(label, p.replace("{owner}", owner).replace("{owners}", owners)) for label, p in ATTACK_PATTERNS]


def attack_reason(c: Column, owner_names: list[str] = ()) -> Column:
    """Label of the first matching attack pattern; NULL when there is none."""
    return F.coalesce(
        *[F.when(c.rlike("(?iU)" + pattern), F.lit(label)) for label, pattern in attack_patterns(owner_names)]
    )


_WITH_AT = ("EMAIL_ADDRESS", "IN_UPI")
_FINDINGS = "array<struct<start:int,rank:int,less:int,kind:string,text:string,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(c: Column, kind: str) -> Column:
    """Matches of one kind with their places, from the texts matched and the texts between them.

    A text without a match is searched once and not split.
    """
    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(c, _ALL[kind], -1), F.lit(1), F.size(found)), lambda text, gap: F.struct(F.length(gap).alias("gap"), F.length(text).alias("size")))
        step = lambda so_far, p: F.struct((so_far["at"] + p["gap"] + p["size"]).alias("at"), F.concat(so_far["starts"], F.array(so_far["at"] + p["gap"])).alias("starts"))
        starts = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda done: done["starts"])
        return F.zip_with(found, starts, lambda text, start: F.struct(
            start.alias("start"), F.lit(PII_SPECIFICITY.get(kind, 2)).alias("rank"), (-F.length(text)).alias("less"), F.lit(kind).alias("kind"), text.alias("text"), (start + F.length(text)).alias("end")))

    found = F.regexp_extract_all(c, F.lit(_ALL[kind]), F.lit(0))
    if kind in _WITH_AT:
        found = F.when(F.contains(c, F.lit("@")), found).otherwise(F.array().cast("array<string>"))
    spans = _let(found, lambda found: F.when(F.size(found) > 0, placed(found).cast(_FINDINGS)).otherwise(F.array().cast(_FINDINGS)))
    return F.filter(spans, lambda s: F.call_function("luhn_check", s["text"])) if kind == "CREDIT_CARD" else spans


def pii_findings(c: Column, kinds: list[str] = tuple(PII_KINDS)) -> Column:
    """array<struct<start, rank, less, kind, text, end>> with overlaps resolved, whatever the order of `kinds`.

    Of findings that start together the more specific and then the longer
    comes first; one that ends inside an earlier one is dropped. NULL and
    clean texts give no findings.
    """
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(_FINDINGS).alias("kept"))

    def keep(so_far: Column, s: Column) -> Column:
        more = s["end"] > so_far["reach"]
        return F.struct(F.greatest(so_far["reach"], s["end"]).alias("reach"), F.when(more, F.concat(so_far["kept"], F.array(s))).otherwise(so_far["kept"]).alias("kept"))

    def of(text: Column) -> Column:
        spans = F.array_sort(F.concat(*[_spans(text, k) for k in kinds]))
        # every identifier holds a digit or an @
        return F.when(text.rlike(r"\p{Nd}|@"), F.aggregate(spans, start, keep, lambda done: done["kept"]))

    return F.coalesce(_let(c, of), F.array().cast(_FINDINGS))


def pii_values(c: Column, kinds: list[str] = tuple(PII_KINDS)) -> Column:
    """array<struct<kind, text>> of the findings."""
    return F.transform(pii_findings(c, kinds), lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text")))


def redact(c: Column, kinds: list[str] = tuple(PII_KINDS)) -> Column:
    """Text with each finding replaced by its visible label, from the last to the first."""
    labels = F.create_map(*[F.lit(x) for pair in PII_LABELS.items() for x in pair])
    label = lambda s: F.element_at(labels, s["kind"])

    def joined(text: Column, found: Column) -> Column:
        """Findings apart: the texts between them and their labels, once through."""
        before = lambda i: F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)
        parts = F.transform(found, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), label(s)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(found, -1)["end"] + 1, F.length(text)))

    def in_turn(text: Column, found: Column) -> Column:
        put = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), label(s), F.substring(t, s["end"] + 1, F.length(t)))
        return F.aggregate(F.reverse(found), text, put)

    def of(z: Column) -> Column:
        text, found = z["text"], z["found"]
        apart = F.forall(F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), lambda s, after: F.coalesce(s["end"] <= after["start"], F.lit(True))), lambda ok: ok)
        return F.when(F.size(found) == 0, text).when(apart, joined(text, found)).otherwise(in_turn(text, found))

    return _let(_let(c, lambda text: F.struct(text.alias("text"), pii_findings(text, kinds).alias("found"))), of)
