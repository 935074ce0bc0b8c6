"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Every kind has patterns that propose spans in time linear in the text (anchored at the
character that makes the kind rare, or one walk over maximal digit chains, so that a
long run of letters or digits is read once), a validator that confirms a proposal
(Luhn for cards, mod-97 for bank accounts, ranges and digit counts elsewhere) and a
prior. Words in a window before and after the span raise or lower the score.

Base kinds (email, ip, card, phone) follow the fixed patterns, leftmost and
non-overlapping per kind; a proposal that fails its validator is dropped and its
characters are not tried again. Their spans are always returned, whatever the score.
The added kinds are returned from `min_score` on:

  card_part  card numbers inside a digit chain that failed as a whole (two cards in a
             row, a card after another number): one run of 13 to 19 digits, or groups
             4-4-4-4, 4-6-5, 4-6-4, that pass Luhn
  iban       two capitals, two digits, 11 to 30 letters or digits in groups; the longest
             prefix ending at a word end with mod-97 equal to 1
  ssn        ddd-dd-dddd in the assigned ranges; it has no checksum, so only context
             words lift it over the default `min_score`

The work is per row: tasks read whole texts in Arrow batches, nothing is shuffled, so
copies and hot sources only cost their own reading.

Defined results: null text counts as empty (no findings); null ids and repeated rows get
their own result rows; spans are code points, end exclusive; equal spans of different
kinds are all kept; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the base kinds in their fixed order, then the added ones
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("card_part", "iban", "ssn")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "card_part": 0.7, "iban": 0.8, "ssn": 0.3}
MIN_SCORE = 0.5
BEFORE, AFTER = 40, 20          # code points of context
RAISE, LOWER = 0.35, 0.35

# words that speak for or against a kind, compared in lower case (parameters)
FOR = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "card_part": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
}
AGAINST = {
    "ip": ("version", "release", "section", "chapter"),
    "card_part": ("isbn", "order", "serial", "checksum"),
    "iban": ("serial", "model"),
    "ssn": ("part number", "serial", "isbn"),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_RUN = re.compile(r"[0-9]++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", re.ASCII)
_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice (its digits added)."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod_97(account: str) -> bool:
    """The first four characters go to the end, letters become 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """A domain at each @, and the run of local characters before it (not before the end of
    the span before): the leftmost match, since @ is no local character."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def addresses(text: str) -> Iterator[Span]:
    """Every four parts in a row of a dotted chain of numbers."""
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        runs = [r.span() for r in _RUN.finditer(text, *m.span())]
        for i in range(0, len(runs) - 3, 4):
            parts = (text[a:b].lstrip("0") for a, b in runs[i:i + 4])
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield runs[i][0], runs[i + 3][1]


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def cards(text: str) -> Iterator[tuple[Span, bool]]:
    """((start, end), whole): chains of digits with single spaces or hyphens that are cards
    as a whole, and cards inside those that are not."""
    for m in _CHAIN.finditer(text):
        start, end = m.span()
        if end - start < 13:
            continue
        runs = [r.span() for r in _RUN.finditer(text, start, end)]
        if sum(b - a for a, b in runs) <= 19 and is_card("".join(text[a:b] for a, b in runs)):
            yield (start, end), True
            continue
        i = 0
        while i < len(runs):
            size = 1
            if not is_card(text[slice(*runs[i])] if runs[i][1] - runs[i][0] <= 19 else ""):
                size = next((len(g) for g in _GROUPS
                             if tuple(b - a for a, b in runs[i:i + len(g)]) == g
                             and luhn("".join(text[a:b] for a, b in runs[i:i + len(g)]))), 0)
            if size:
                yield (runs[i][0], runs[i + size - 1][1]), False
            i += size or 1


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[Span]:
    m = _IBAN.search(text)
    while m:
        found, at = m.group(), m.start()
        then = at + 4
        for end in range(len(found), 14, -1):
            after = text[at + end:at + end + 1]
            plain = found[:end].replace(" ", "")
            if found[end - 1] != " " and not after.isalnum() and len(plain) >= 15 and mod_97(plain):
                then = at + end
                yield at, then
                break
        m = _IBAN.search(text, then)


def social_numbers(text: str) -> Iterator[Span]:
    for m in _SSN.finditer(text):
        area, group, number = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and number != "0000" \
                and text[max(0, m.start() - 1):m.start()] != "-":
            yield m.span()


def _words(words: tuple[str, ...]):
    """Words by their beginning, so that 'mail' also speaks in 'mailing'."""
    return re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + ")") if words else None


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    score: float
    base: bool


class Detector:
    """Findings of a text, by kind in the order of KINDS, then start."""

    def __init__(self, min_score: float = MIN_SCORE):
        self.min_score = min_score
        self.speaks_for = {k: _words(FOR.get(k, ())) for k in KINDS}
        self.speaks_against = {k: _words(AGAINST.get(k, ())) for k in KINDS}

    def score(self, kind: str, text: str, start: int, end: int) -> float:
        around = text[max(0, start - BEFORE):start].lower() + " " + text[end:end + AFTER].lower()
        good, bad = self.speaks_for[kind], self.speaks_against[kind]
        score = PRIOR[kind] + (RAISE if good and good.search(around) else 0) \
            - (LOWER if bad and bad.search(around) else 0)
        return round(min(1.0, max(0.0, score)), 2)

    def find(self, text: str) -> list[Finding]:
        proposed: dict[str, list[Span]] = {"email": [], "ip": [], "card": [], "phone": [], "card_part": [],
                                           "iban": list(accounts(text)), "ssn": list(social_numbers(text))}
        if "@" in text:
            proposed["email"] = list(emails(text))
        proposed["ip"] = list(addresses(text))
        for span, whole in cards(text):
            proposed["card" if whole else "card_part"].append(span)
        if "+" in text:
            proposed["phone"] = list(phones(text))
        out = []
        for kind in KINDS:
            for start, end in proposed[kind]:
                score = self.score(kind, text, start, end)
                if kind in BASE or score >= self.min_score:
                    out.append(Finding(kind, start, end, score, kind in BASE))
        return out


def mask(text: str, found: list[Finding]) -> str:
    """Findings become [KIND]; of findings that overlap, the first (then the longest, then the
    first kind) names the place."""
    out, at = [], 0
    spans = sorted(found, key=lambda f: (f.start, -f.end, KINDS.index(f.kind)))
    i = 0
    while i < len(spans):
        end, j = spans[i].end, i + 1
        while j < len(spans) and spans[j].start < end:
            end = max(end, spans[j].end)
            j += 1
        out += [text[at:spans[i].start], f"[{spans[i].kind.upper()}]"]
        at, i = end, j
    return "".join(out) + text[at:]


_FINDING = "struct<kind:string,start:int,end:int,score:double,base:boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.float64()), ("base", pa.bool_())]))


def _detect(min_score: float, with_masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(min_score)
        for batch in batches:
            found, masked = [], []
            for value in batch.column(1):
                text = value.as_py()
                here = detector.find(text) if text else []
                found.append([vars(f) for f in here])
                masked.append(mask(text, here) if with_masked and text is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, _ARROW), pa.array(masked, pa.string())],
                names=["row", "findings", "masked"])
    return run


def detect(docs: DataFrame, keep: list[Column] | None = None, text_col: str = "text",
           min_score: float = MIN_SCORE, with_masked: bool = False) -> DataFrame:
    """row (struct of the columns in `keep`; all by default), findings (array of kind, start,
    end, score, base), masked (the text with findings replaced, if asked for)."""
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).alias("t"))
    schema = T.StructType([rows.schema["row"],
                           T.StructField("findings", T._parse_datatype_string(f"array<{_FINDING}>")),
                           T.StructField("masked", T.StringType())])
    return rows.mapInArrow(_detect(min_score, with_masked), schema)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
