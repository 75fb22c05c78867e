"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  From each
anchor a small local parser expands to both sides as far as its kind allows and validates what it found.

Base kinds equal the leftmost non-overlapping matches of fixed patterns: a match that fails its check is dropped and
still uses up its characters.  Added kinds: ``link`` (mailto: and tel: addresses, web addresses with user information)
and ``account`` (a checked IBAN, or an identifier of 6 to 18 digits behind a cue such as 'account no.').
Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as listed in ``KINDS``.

Defined cases: null text is empty.  Digits and letters are ASCII.  Overlapping spans of different kinds all stay;
redaction joins them and keeps the label of the first.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import annotate

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "link", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")

# Cues that announce an identifier, and the schemes of personal links.
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "konto", "kontonummer", "compte", "cuenta", "pasaporte", "passeport")
SCHEMES = ("mailto:", "tel:", "://")

_LINK_REST = re.compile(r"[^\s<>\"'()\[\]{}]+")
_SCHEME_NAME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_CUE_GAP = re.compile(r"[ \t]*(?:(?:no|nr|num|number|nummer|numero|número|id)\b\.?)?[ \t]*[:#=]?[ \t]*", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_IDENTIFIER = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_length(text: str, start: int) -> int:
    """End of a valid IBAN at ``start`` (mod 97 is 1), the longest one; 0 if there is none."""
    match = _IBAN.match(text, start)
    end = match.end() if match else 0
    while end > start + 14:
        compact = text[start:end].replace(" ", "")
        if len(compact) < 15:
            break
        if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] == " ":
            end -= 1
    return 0


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            found.add_word(form, ("scheme", len(form)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


class Finder:
    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        used = dict.fromkeys(KINDS, 0)  # up to where each kind has consumed the text
        found: list[tuple[str, int, int]] = []
        last_digit = -2
        for end, (anchor, length) in self.anchors.iter(text):
            start = end - length + 1
            if anchor == "digit":
                if start != last_digit + 1:  # the start of a run of digits
                    self._numbers(text, start, used, found)
                last_digit = start
            elif anchor == "@":
                self._email(text, start, used, found)
            elif anchor == "+":
                if start >= used["phone"] and (match := _PHONE.match(text, start)):
                    used["phone"] = match.end()
                    if 10 <= sum(c in _DIGITS for c in match.group()) <= 15:
                        found.append(("phone", start, match.end()))
            elif anchor == "scheme":
                self._link(text, start, end + 1, used, found)
            else:
                self._account(text, start, end + 1, used, found)
        found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return found

    @staticmethod
    def _email(text, at, used, found) -> None:
        start = at
        while start > used["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            used["email"] = match.end()
            found.append(("email", start, match.end()))

    @staticmethod
    def _numbers(text, start, used, found) -> None:
        if start >= used["ip"] and (match := _IP.match(text, start)):
            used["ip"] = match.end()
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in (digits.lstrip("0") for digits in match.groups())):
                found.append(("ip", start, match.end()))
        if start >= used["card"] and (match := _CARD.match(text, start)):
            used["card"] = match.end()
            digits = match.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", start, match.end()))

    @staticmethod
    def _link(text, start, after, used, found) -> None:
        if start < used["link"] or not (rest := _LINK_REST.match(text, after)):
            return
        body = rest.group().rstrip(".,;:!?")
        if text[start:after] == "://":
            name = _SCHEME_NAME.search(text, max(used["link"], start - 16), start)
            authority = re.split(r"[/?#]", body, maxsplit=1)[0]
            user, sign, host = authority.rpartition("@")
            if not (name and sign and user and host):
                return
            start = name.start()
        elif not ("@" in body or sum(c in _DIGITS for c in body) >= 7):
            return
        used["link"] = after + len(body)
        found.append(("link", start, used["link"]))

    @staticmethod
    def _account(text, start, after, used, found) -> None:
        if start < used["account"] or (start and text[start - 1].isalpha()):
            return
        at = _CUE_GAP.match(text, after).end()
        end = iban_length(text, at)
        if not end and (match := _IDENTIFIER.match(text, at)):
            end = match.end()
        if end:
            used["account"] = end
            found.append(("account", at, end))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Put [KIND] in place of every span; spans that overlap become one."""
    joined: list[list] = []
    for kind, start, end in spans:
        if joined and start < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], end)
        else:
            joined.append([kind, start, end])
    cuts = [0, *(x for _, start, end in joined for x in (start, end)), len(text)]
    parts = [text[a:b] for a, b in pairwise(cuts)]
    for i, (kind, _, _) in enumerate(joined):
        parts[2 * i + 1] = f"[{kind.upper()}]"
    return "".join(parts)


def _per_text(result):
    def make():
        finder = Finder()

        def work(texts: pa.Array) -> list:
            return list(zip(*(result(t, finder.spans(t)) for t in texts.to_pylist()), strict=True))

        return work

    return make


def _join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _digest(text, spans):
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
    return (*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))


def _found(text, spans):
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans], redact(text, spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with pii_spans (kind, start, end) and redacted (the text with labels instead of spans)."""
    return annotate(docs, _per_text(_found), "pii_spans array<struct<kind string, start int, end int>>, redacted string")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return annotate(docs.select("doc_id", "text"), _per_text(_digest), fields).drop("text")
