"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, schemes, cues such as "token", and the starts of
numbers. A parser for each kind expands the anchor to both sides and validates the boundaries.
Places are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Kinds in the order in which spans with one start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "url")
SCHEMES = ("http://", "https://", "ftp://")
#: Cues of a secret or an account number; what follows after ":" or "=" is taken if it looks like one.
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "account", "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_OCTETS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9+/_.-]{8,})")
_ADDRESS = re.compile(r"[^\s<>\"']+")
_BREAK = re.compile(r"[^0-9]")

Span = tuple[int, int]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("number" if c in _DIGITS else c, 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for s in CUES:
        for form in {s, s.upper(), s.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign; its local part starts at `floor` at the earliest."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start < at and (m := _DOMAIN.match(text, at + 1)):
        return start, m.end()
    return None


def ip_fits(m: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())


def card_fits(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def phone_fits(found: str) -> bool:
    return 10 <= sum(c in _DIGITS for c in found) <= 15


def find(text: str, anchors) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in the order of KINDS within a start.

    Per base kind the matches are leftmost and do not overlap; a match that fails validation is used up all the same.
    """
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    number = 0  # where the run of digits now passed ends
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "@":
            if at >= done["email"] and (s := email_at(text, at, done["email"])):
                done["email"] = s[1]
                out.append((*s, "email"))
        elif kind == "number":
            if at >= number:  # the first digit of a run
                stop = _BREAK.search(text, at)
                number = stop.start() if stop else len(text)
                # a quad starts with a whole run, or in its midst where the last one ended: then nothing is left of the run
                if at >= done["ip"] and (m := _OCTETS.match(text, at)):
                    done["ip"] = m.end()
                    if ip_fits(m):
                        out.append((at, m.end(), "ip"))
                if at >= done["card"] and (m := _GROUPED.match(text, at)):
                    done["card"] = m.end()
                    if card_fits(m[0]):
                        out.append((at, m.end(), "card"))
        elif kind == "+":
            if at >= done["phone"] and (m := _DIALLED.match(text, at)):
                done["phone"] = m.end()
                if phone_fits(m[0]):
                    out.append((at, m.end(), "phone"))
        elif kind == "cue":
            if at >= done["secret"] and (m := _VALUE.match(text, last + 1)) and any(c in _DIGITS for c in m[1]):
                done["secret"] = m.end(1)
                out.append((m.start(1), m.end(1), "secret"))
        elif at >= done["url"] and (m := _ADDRESS.match(text, last + 1)):
            end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
            if end > last + 1:
                done["url"] = end
                out.append((at, end, "url"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, end, kind), for each row of docs.

    Null and empty texts have no spans. Repeated rows are kept, rows without a doc_id left out. Other columns are ignored. A text is held whole
    in a task's memory, whatever its length; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in find(t, anchors)] if t else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    return C.identified(docs).mapInPandas(run, "doc_id long, spans array<struct<start: int, end: int, kind: string>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; other columns stay as they are.

    Spans that overlap are replaced as one, under the kind that starts first (then first in KINDS). Null text stays null.
    """

    def run(batches):
        anchors = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [masked(t, find(t, anchors)) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)
