"""Operator 1, PII by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at
signs, ``://`` and ``mailto:``-like schemes, plus signs, digits and identifier
cues. Every hit is expanded by a local parser that looks only at the characters
around it and validates what it found (domain labels, octets, digit counts,
Luhn, IBAN checksum).

Kinds and order: email, ip, card, phone (the base kinds: leftmost,
non-overlapping per kind, failing matches dropped without retries), then the
added kinds ``url`` (scheme, host with a dot; ``mailto:`` and an address;
``tel:`` and 5 to 15 digits), ``address`` (house number, words, street word;
``rue`` or ``calle``, a capitalised name and a number before or after; a name
ending in or followed by ``straße``, and a number) and ``account`` (identifier after a cue: a
checked IBAN, a long token, or a number of 6 and more digits).

Defined results: a null text is empty, and an empty text has no spans; a null
id stays a row with a null id; repeated rows give repeated rows; other columns
are ignored; an empty table gives an empty result. Offsets are code points,
end exclusive; texts are read whole, in batches of bounded bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import map_batches, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "address", "account")

# Anchor words.
SCHEMES = ("://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "token", "secret", "api_key",
                "password")
STREET_CUES = ("street", "avenue", "road", "lane", "boulevard", "straße", "strasse", "rue", "calle")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_URL_TAIL = re.compile(r"(?:[^\s/?#@<>\"']*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_IDENT = re.compile(r"[\x20:=#\"'.]{1,6}([A-Za-z0-9][A-Za-z0-9_-]{5,63})(?![A-Za-z0-9_-])")
_IBAN = re.compile(r"[\x20:=#\"'.]{1,6}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_BEFORE_STREET = re.compile(r"(?<![\w.+-])[0-9]{1,5}[A-Za-z]?,?(?:\x20[^\W\d_][\w'’-]{0,30}){1,3}\x20\Z")
# Forms whose cue does not end them: what stands before and after the cue.
_NAME = r"[^\W\d_a-zß-öø-ÿ][\w'’-]{0,30}"
_AFTER_RUE = re.compile(r"(?:\x20(?:d[eu]|des|del|la|le|les|las|los|el))*\x20(?:[dlDL]['’])?" + _NAME + r"(?:\x20" + _NAME + r"){0,2}")
_NUMBER_AFTER = re.compile(r",?\x20(?:n[º°]\x20?)?[0-9]{1,5}[A-Za-z]?(?!\w)")
_NUMBER_BEFORE = re.compile(r"(?<![\w.+-])[0-9]{1,5}(?:[A-Za-z]|\x20(?:bis|ter))?,?\x20\Z")
_BEFORE_STRASSE = re.compile(r"(?<![\w-])(?:" + _NAME + r"\x20|[^\W\d_][^\W\d_-]{0,40}(?:-[^\W\d_-]{1,40}){0,3}-?)?\Z")
_MAILTO = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TEL = re.compile(r"[+(]?[0-9](?:[().-]{0,2}[0-9]){4,14}(?![0-9])")


def _street(text: str, at: int, end: int, low: int) -> tuple[int, int] | None:
    """The address around a cue at ``at`` to ``end``, from ``low`` on at the
    earliest, where the number or the name follows the cue."""
    cue = text[at:end].lower()
    if cue in ("rue", "calle"):
        name = None if text[at - 1:at].isalnum() else _AFTER_RUE.match(text, end)
        if name:
            before, after = _NUMBER_BEFORE.search(text[low:at]), _NUMBER_AFTER.match(text, name.end())
            if before or after:
                return low + before.start() if before else at, after.end() if after and not before else name.end()
    elif cue in ("straße", "strasse"):
        number, before = _NUMBER_AFTER.match(text, end), _BEFORE_STRASSE.search(text[low:at])
        if number and before:
            return low + before.start(), number.end()
    return None


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    if not 15 <= len(text) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def automaton():
    """Anchors of every kind; a word cue in lower case, capitalised and upper
    case. A value is the group of the anchor and its length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for d in "0123456789":
        found.add_word(d, ("0", 1))
    for group, words in (("s", SCHEMES), ("c", ACCOUNT_CUES), ("a", STREET_CUES)):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                found.add_word(form, (group, len(form)))
    found.make_automaton()
    return found


def expand(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each in ascending order."""
    spans: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)  # per kind, the end of what has been consumed

    def add(kind: str, start: int, end: int) -> None:
        spans.setdefault(kind, []).append((start, end))
        done[kind] = end

    for last, (group, size) in anchors.iter(text):
        at = last - size + 1
        if group == "0":
            if at >= done["card"]:
                m = _DIGITS.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        add("card", at, m.end())
            if at >= done["ip"]:
                m = _DOTTED.match(text, at)
                done["ip"] = m.end()
                parts = m.group().split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k:k + 4]
                    if all(map(_octet, four)):
                        start = at + sum(map(len, parts[:k])) + k
                        spans.setdefault("ip", []).append((start, start + sum(map(len, four)) + 3))
        elif group == "@":
            m = _DOMAIN.match(text, at + 1)
            if m:
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    add("email", start, m.end())
        elif group == "+":
            m = _PHONE.match(text, at) if at >= done["phone"] else None
            if m:
                done["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    add("phone", at, m.end())
        elif group == "s":
            if size == 3 and at >= done["url"]:
                start = at
                while start > done["url"] and at - start < 16 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                m = _URL_TAIL.match(text, last + 1)
                if m and start < at:
                    add("url", start, m.end())
            elif size > 3 and at >= done["url"] and not text[at - 1:at].isalnum():
                m = (_TEL if size == 4 else _MAILTO).match(text, last + 1)
                if m:
                    add("url", at, m.end())
        elif group == "c":
            if at >= done["account"] and not text[at - 1:at].isalnum():
                m = _IBAN.match(text, last + 1)
                if m and _iban(m.group(1)):
                    add("account", *m.span(1))
                else:
                    m = _IDENT.match(text, last + 1)
                    if m and sum(c.isdigit() for c in m.group(1)) >= 6:
                        add("account", *m.span(1))
        elif not text[last + 1:last + 2].isalnum():
            low = max(done["address"], at - 110)
            m = _BEFORE_STREET.search(text[low:at])
            found = (low + m.start(), last + 1) if m else at >= done["address"] and _street(text, at, last + 1, low)
            if found:
                add("address", *found)
    return spans


_ANCHORS = None


def _find(columns: list[list]) -> list[list]:
    global _ANCHORS
    if _ANCHORS is None:
        _ANCHORS = automaton()
    ids, texts = columns
    found = []
    for text in texts:
        spans = expand(text, _ANCHORS)
        found.append([{"kind": kind, "start": s, "end": e, "value": text[s:e]}
                      for kind in KINDS for s, e in spans.get(kind, ())])
    return [ids, found]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: one row per input row, the spans of every kind in
    the order of ``KINDS``, then by start. A map over the rows, no shuffle."""
    kind = dict(texts_of(docs, id_col, text_col).dtypes)["doc_id"]
    return map_batches(texts_of(docs, id_col, text_col), _find,
                       f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with every span replaced by ``[KIND]``; of spans that
    overlap the earliest stays, then the longest."""
    def run(columns):
        global _ANCHORS
        if _ANCHORS is None:
            _ANCHORS = automaton()
        out = []
        for text in columns[1]:
            parts, at = [], 0
            every = sorted((s, -e, k) for k, v in expand(text, _ANCHORS).items() for s, e in v)
            for s, e, k in every:
                if s >= at:
                    parts += [text[at:s], f"[{k.upper()}]"]
                    at = -e
            out.append("".join(parts) + text[at:])
        return [columns[0], out]

    kind = dict(texts_of(docs, id_col, text_col).dtypes)["doc_id"]
    return map_batches(texts_of(docs, id_col, text_col), run, f"doc_id {kind}, text string")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of the query ``op1_pii``."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find_pii(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[4:]])
