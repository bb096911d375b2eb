r"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds anchors: at-signs,
plus signs, digits, URL schemes and words that announce an identifier.
Deterministic local parsers then expand from each anchor to both sides:

* ``email`` from ``@``: ``[A-Za-z0-9._%+-]+`` to the left, at least two dotted
  labels to the right;
* ``ip``, ``card`` from the first digit of a run: four dotted numbers of at
  most 255; 16 to 19 digits, single spaces or hyphens between, passing Luhn;
* ``phone`` from ``+``: 8 to 15 digits among spaces, dots, brackets, hyphens;
* ``account`` after an account word: an IBAN with valid check digits, or 6 to
  20 digits in groups; ``secret`` after a credential word and ``=`` or ``:``;
  ``url`` from ``://`` where the address carries a user name.

Within a kind, spans are leftmost and do not overlap; a match that fails its
test is dropped and not tried again from within.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "account", "secret", "url"]
#: Words that announce an identifier.
ACCOUNT_CUES = ["iban", "account", "konto", "cuenta", "compte", "ssn", "passport"]
SECRET_CUES = ["token", "secret", "password", "api_key", "apikey"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[ :#.=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?: (?:no|nr|number)\b\.?)?[ :#.=-]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9A-Za-z])", re.I)
_SECRET = re.compile(r"[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9_+/.-]{16,})")
_HOST = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+")
_DIGITS = "0123456789"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    for anchor, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(anchor, (kind, len(anchor)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive; a null text has none."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    email_end = ip_end = card_end = 0
    last_digit = -2
    for end, (kind, size) in _automaton().iter(text):
        begin = end - size + 1
        if kind == "digit":
            first = begin != last_digit + 1
            last_digit = begin
            if not first:
                continue
            if begin >= ip_end and (m := _IP.match(text, begin)):
                ip_end = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    spans["ip"].append(m.span())
            if begin >= card_end and (m := _CARD.match(text, begin)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif kind == "at":
            left = begin
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < begin and (m := _DOMAIN.match(text, end + 1)):
                email_end = m.end()
                spans["email"].append((left, m.end()))
        elif kind == "plus":
            if (m := _PHONE.match(text, begin)) and 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                spans["phone"].append(m.span())
        elif kind == "scheme":
            left = begin
            while left > 0 and text[left - 1].isascii() and text[left - 1].isalpha() and begin - left < 16:
                left -= 1
            if left < begin and (m := _HOST.match(text, end + 1)):
                spans["url"].append((left, m.end()))
        elif begin and text[begin - 1].isalnum():
            continue
        elif kind == "account":
            if (m := _IBAN.match(text, end + 1)) and iban(m[1]) or (m := _NUMBER.match(text, end + 1)):
                spans["account"].append(m.span(1))
        elif m := _SECRET.match(text, end + 1):
            spans["secret"].append(m.span(1))
    return spans


def written(spans: dict[str, list[tuple[int, int]]], kinds: list[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    found = sorted((a, -b, k) for k, xs in find(text).items() for a, b in xs)
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]]) if found else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base kinds, the digest of base spans and all spans of every row.

    Null and empty texts have no spans.  Ids are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [find(t) for t in part.column("text").to_pylist()]
                counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
                digest = pa.array([hashlib.sha256(written(f, BASE).encode()).hexdigest() for f in found], pa.string())
                spans = pa.array([written(f, KINDS) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, spans], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts masked; other columns, order of columns and all rows stay."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                k = part.schema.get_field_index(text_col)
                yield part.set_column(k, part.schema.field(k), pa.array([mask(t) for t in part.column(k).to_pylist()], part.schema.field(k).type))

    return docs.mapInArrow(run, schema)
