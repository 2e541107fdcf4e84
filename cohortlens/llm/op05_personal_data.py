"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds of the base set: email, ip, card, phone; they stand whatever the score. The method adds kinds that need more evidence
than a pattern: ``iban`` (mod-97), ``card_near`` (12 or 13 digits passing Luhn next to a word about payment), ``national_id``
(3-2-4 digits with a context word) and ``secret`` (an access key, or a quoted or assigned value of any length after a word such as
token or password in either case). An added span is kept if pattern score + checksum + context reaches ``LEAST``; a failed checksum rules it out.

Each text is read in one pass in its own task; nothing is shuffled or shared. Patterns are written so that none is tried
again over the same characters: e-mail addresses are found from their @, and runs of digits are taken whole.

Defined cases: a missing text is empty; an empty text has no spans; repeated rows give a row each; positions are code points,
ends exclusive; spans of one kind never overlap.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from cohortlens.llm.common import append, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_near", "national_id", "secret")
LEAST = 0.7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|token|secret|api_?key)\x20?[=:]\x20?(?:"[^"\n]{8,}+"|[0-9A-Za-z_-]{8,}+))""")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_WORD = re.compile(r"[a-z]+")

#: Context words for each added kind, and how far around a span they count, in code points.
CONTEXT = {
    "iban": {"iban", "bank", "account", "konto", "cuenta", "compte"},
    "card_near": {"card", "visa", "credit", "debit", "karte", "tarjeta", "carte"},
    "national_id": {"ssn", "social", "security", "identity", "taxpayer"},
    "secret": {"password", "token", "secret", "key", "login", "credentials"},
}
NEAR = 40
#: What a pattern alone, a passed checksum and a near context word are worth.
PATTERN_SCORE = {"iban": 0.3, "card_near": 0.2, "national_id": 0.5, "secret": 0.7}
CHECKSUM_SCORE, CONTEXT_SCORE = 0.4, 0.3


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10 of an account number, spaces ignored."""
    code = code.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return int(number) % 97 == 1


def _emails(text: str):
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and _LOCAL.match(text, start - 1):
            start -= 1
        host = start < at and _HOST.match(text, at + 1)
        if host:
            past = host.end()
            yield start, past
        else:
            past = at + 1  # no address can hold this @
        at = text.find("@", past)


def base_spans(text: str) -> list[Span]:
    """In order of start, then of kind as listed."""
    out = [Span("email", a, b, 1.0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(Span("ip", m.start(), m.end(), 1.0))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end(), 1.0))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(Span("phone", m.start(), m.end(), 1.0))
    return sorted(out, key=lambda s: (s.start, BASE.index(s.kind)))


def _scored(text: str, kind: str, start: int, end: int, checked: bool | None) -> Span | None:
    if checked is False:
        return None
    score = PATTERN_SCORE[kind] + CHECKSUM_SCORE * bool(checked)
    around = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
    if not CONTEXT[kind].isdisjoint(_WORD.findall(around)):
        score += CONTEXT_SCORE
    return Span(kind, start, end, round(min(1.0, score), 2)) if score >= LEAST - 1e-9 else None


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the patterns propose, the checksums leave and the score confirms, besides the base spans."""
    found = [_scored(text, "secret", m.start(), m.end(), None) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):  # the other kinds have digits
        found += [_scored(text, "iban", m.start(), m.end(), mod97(m.group())) for m in _IBAN.finditer(text)]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 13:
                found.append(_scored(text, "card_near", m.start(), m.end(), luhn(digits)))
        if "-" in text:
            found += [_scored(text, "national_id", m.start(), m.end(), None) for m in _NATIONAL.finditer(text)]
    return [s for s in found if s is not None]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all: those of the base with the added ones, by start and then by kind as listed."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return base, sorted(base + added_spans(text, base), key=lambda s: (s.start, order[s.kind]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in square brackets; of overlapping spans the first one counts."""
    out, past = [], 0
    for s in spans:
        if s.start >= past:
            out += [text[past : s.start], f"[{s.kind}]"]
            past = s.end
    return "".join(out) + text[past:]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                      T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (kind, start, end, score), and ``redacted``, the text
    without them; equally named columns of the input are replaced."""
    docs = docs.drop(*[c for c in ("base_spans", "all_spans", "redacted") if c != text])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text)
            found = [all_spans(x) for x in texts]
            columns = {"base_spans": pa.array([[vars(s) for s in b] for b, _ in found], kind),
                       "all_spans": pa.array([[vars(s) for s in a] for _, a in found], kind),
                       "redacted": pa.array([redact(x, a) if a else x for x, (_, a) in zip(texts, found)], pa.string())}
            yield append(batch, columns)

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField("base_spans", T.ArrayType(_SPAN)), T.StructField("all_spans", T.ArrayType(_SPAN)),
        T.StructField("redacted", T.StringType())]))
