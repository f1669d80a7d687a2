"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Every scan is linear in the text: an email is looked for around each @, and digits only where a run of them begins. Texts are
searched where they lie, whole, with no shuffle; a task holds one Arrow batch."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read

#: The first four are base kinds: their spans are kept whatever their score. The others need MIN_SCORE.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "passport", "birth", "account")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.6
#: Kinds that are looked for only where no other span is.
LOOSE = KINDS[6:]
#: Characters before and after a span in which a context word counts.
NEAR = 48

# Score of a well-formed span of a kind, and words that raise it by 0.3.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "secret": 0.4, "passport": 0.4, "birth": 0.3, "account": 0.3}
CONTEXT = {
    "email": r"e-?mail|contact|write|@",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security",
    "secret": r"token|secret|passw|credential|bearer|(?:api|access|private|auth)[ _-]?key",
    "passport": r"passport|passeport|reisepass|pasaporte",
    "birth": r"\bborn\b|birth|\bdob\b|geboren|nacid|\bnée?\b",
    "account": r"account|\bacct\b|konto|cuenta|routing",
}
_CONTEXT = {k: re.compile(v, re.I) for k, v in CONTEXT.items()}

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_IBAN_FOUR = re.compile(r"\x20?[A-Z0-9]{4}")
_IBAN_TAIL = re.compile(r"\x20?[A-Z0-9]{1,3}")
_EDGE = re.compile(r"\b")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])")
# How keys of well-known services begin.
_SERVICE = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_|sk-|xox[abpr]-|AIza")
_PASSPORT = re.compile(r"\b[A-Z]{1,2}[0-9]{6,8}\b")
_DATE = re.compile(r"\b(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4}))\b")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{6,17}(?![0-9A-Za-z]|[.-][0-9])")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


# Characters of an IBAN by country, as registered under ISO 13616.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    context: bool


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled, sum to a multiple of 10."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_ends(text: str, start: int) -> list[int]:
    """Where an IBAN that begins at start may end, longest first."""
    ends, at = set(), start + 4
    for k in range(8):
        if k >= 2:
            # The tail is as long as it can be: behind a shorter one there is no edge of a word.
            tail = _IBAN_TAIL.match(text, at)
            ends |= {x for x in (at, tail.end() if tail else at) if _EDGE.match(text, x)}
        four = _IBAN_FOUR.match(text, at)
        if not four:
            break
        at = four.end()
    return sorted(ends, reverse=True)


def _iban_search(text: str, start: int, stop: int, registered: bool):
    """Leftmost matches within start and stop whose checksum holds, of the country's length or of any; a search goes on behind a match, or behind a place where none begins."""
    m = _IBAN.search(text, start)
    while m and m.start() < stop:
        a, due = m.start(), IBAN_LENGTH.get(m[0][:2], 0) if registered else None
        ends = _iban_ends(text, a) if due != 0 else []
        end = next((e for e in ends if e <= stop and (due is None or e - a - text.count(" ", a, e) == due) and mod97(text[a:e])), None)
        if end is not None:
            yield a, end
        m = _IBAN.search(text, a + 1 if end is None else end)


def _ibans(text: str):
    """Those of a registered country and its length; then, in the gaps, any others."""
    at = 0
    for a, b in [*_iban_search(text, 0, len(text), True), (len(text), len(text))]:
        yield from _iban_search(text, at, a, False)
        if a < b:
            yield a, b
        at = b


def _emails(text: str):
    """Leftmost matches: for each @ the local part reaches back to the last other character or match, the domain forward."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done:
            piece = text[max(done, start - 256) : start]
            run = len(piece) - _LOCAL_END.search(piece).start() if not _all_local(piece) else len(piece)
            start -= run
            if run < len(piece):
                break
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _all_local(piece: str) -> bool:
    return _NOT_LOCAL.search(piece) is None


def _ip_ok(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def _proposals(text: str):
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, 0.0
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if _ip_ok(m[0]):
            yield "ip", *m.span(), 0.0
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span(), 0.2
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield "phone", *m.span(), 0.0
    for a, b in _ibans(text):
        yield "iban", a, b, 0.2
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", *m.span(), 0.0
    for m in _TOKEN.finditer(text):
        if (known := _SERVICE.match(m[0])) or (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
            yield "secret", *m.span(), 0.3 if known else 0.0
    for m in _PASSPORT.finditer(text):
        yield "passport", *m.span(), 0.0
    for m in _DATE.finditer(text):
        if _is_date(m):
            yield "birth", *m.span(), 0.0
    for m in _ACCOUNT.finditer(text):
        yield "account", *m.span(), 0.0


def _is_date(m: re.Match) -> bool:
    year, a, b = map(int, (m[1], m[2], m[3]) if m[1] else (m[6], m[5], m[4]))
    return 1900 <= year <= 2100 and any(1 <= month <= 12 and 1 <= day <= 31 for month, day in ((a, b), (b, a)))


def _only_digits(s: str) -> str:
    return "".join(filter(str.isdecimal, s)) if s.isascii() else "".join(_DIGIT.findall(s))


def find_spans(text: str) -> list[Span]:
    """All spans by kind as in KINDS, then start; offsets are code points, ends exclusive.

    A span's score is that of its kind, more where a checksum or a known beginning speaks for it, and 0.3 more with a word of the
    kind's context nearby. Kinds that look like much else, from ssn on, need that word; of them a span that begins within one of
    another kind is left out."""
    found: list[Span] = []
    for kind, a, b, more in _proposals(text):
        around = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
        context = bool(_CONTEXT[kind].search(around))
        score = min(1.0, PRIOR[kind] + more + 0.3 * context)
        if kind in BASE_KINDS or score >= MIN_SCORE - 1e-9 and not (kind in LOOSE and _within(found, a)):
            found.append(Span(kind, a, b, round(score, 3), context))
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


def _within(found: list[Span], place: int) -> bool:
    """Whether a span found before covers the place. Spans of a kind come in order and apart, so the last that starts before it tells."""
    at = 0
    while at < len(found):
        order = KINDS.index(found[at].kind)
        end = bisect_right(found, order, at, key=lambda s: KINDS.index(s.kind))
        i = bisect_right(found, place, at, end, key=lambda s: s.start) - 1
        if i >= at and found[i].end > place:
            return True
        at = end
    return False


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of the first one's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind,start,end,score,context>> and redacted, one row for each row of docs.

    A null or empty text has no spans; its redacted text is null or empty as it was. Null and repeated doc_ids stay."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("context", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find_spans(t) if t else [] for t in texts]
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x._asdict() for x in s] for s in spans], struct), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,context:boolean>>, redacted string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents as pii_spans() finds them; scores tells each span's score and whether a context word stood by, in the same order."""
    found = pii_spans(read(spark, sf_dir, "documents")).select("doc_id", "spans")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["score"], s["context"].cast("string"))), ",")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), said.alias("scores"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans replaced by their kinds and n_chars counted anew; a null text, and its n_chars, stay as they are."""
    import pyarrow as pa

    place = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = [find_spans(t) if t else [] for t in texts]
            if any(spans):
                clean = [redact(t, s) if s else t for t, s in zip(texts, spans)]
                columns = list(batch.columns)
                columns[place] = pa.array(clean, pa.string())
                if counted is not None:
                    n = [len(c) if s else old for c, s, old in zip(clean, spans, columns[counted].to_pylist())]
                    columns[counted] = pa.array(n, batch.schema.field(counted).type)
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
