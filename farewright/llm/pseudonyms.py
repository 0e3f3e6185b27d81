"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass the check of their kind (Luhn, mod 97, issued ranges, the calendar, an
address's octets, a dialling plan, an address's shape) are replaced by a keyed permutation within
the same format: a Feistel network over the rank of the value, walked until it fits the format
again, and then printed as the value was found. The same value gets the same pseudonym in every
document and in every way of writing it (a date by numbers or by its month's name, an e-mail address
in any case, a telephone number with or without its country's code), unless other digits next to it
would make its pseudonym read as another value there: then it is permuted on. Different values get
different ones; with the key the step can be undone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import fresh, pieces

ROUNDS = 10

#: The lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30}
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: A year of two digits is one of the hundred from here on.
FIRST_SHORT_YEAR = 1930

#: English names of months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "(?:" + "|".join(case(n) for m in MONTHS for n in (m, m[:3]) for case in (str, str.upper, str.lower)) + ")"
_LETTERS = [[chr(c) for c in codes if chr(c).islower() and len(chr(c).upper()) == 1 and chr(c).upper().lower() == chr(c) != chr(c).upper()]
            for codes in (range(0x61, 0x7B), range(0xDF, 0x180), range(0x3B1, 0x3CA), range(0x430, 0x450))]
#: What a letter or digit of an e-mail's local part is permuted among: its own alphabet, in lower case.
_ALPHABETS = {c: alphabet for alphabet in (*_LETTERS, list("0123456789")) for c in alphabet}
_LOCAL = "0-9" + "".join(c + c.upper() for alphabet in _LETTERS for c in alphabet)
#: A local part has 64 characters and a label 63 at most, so a search reads no further from where it starts.
_EMAIL = (rf"""(?<![{_LOCAL}])(?:[{_LOCAL}][{_LOCAL}._%+'!#$&*/=?^`{{|}}~-]{{0,63}}+|"[^"@\\\r\n]{{1,62}}")@"""
          r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_SHAPES = {
    "email": _EMAIL,
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}",
    "ip": r"(?<!\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.[0-9A-Za-z])",
    "ip6": r"(?<!:)(?:[0-9a-f]{1,4}:{1,2}|[0-9A-F]{1,4}:{1,2}){1,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?!:)",
    "date": (rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{1,2}}/\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}"
             r"|(?<!/)\d{1,2}/\d{1,2}/\d{2}(?!/[0-9A-Za-z])|(?<!\.)\d{1,2}\.\d{1,2}\.\d{2}(?!\.[0-9A-Za-z])"
             rf"|\d{{1,2}}\.? {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}})"),
    "ssn": r"(?<!-)\d{3}(?:-\d{2}-| \d{2} )\d{4}(?!-)",
    "phone": (r"(?<!\+)(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}"
              r"|0\d{1,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2})"),
    "card": r"\d(?:[ -]?\d){11,18}"}
#: All kinds start where no letter or digit precedes; what only looks like one fails its check later.
_PATTERN = re.compile(
    rf'(?<![A-Za-z0-9])(?=[{_LOCAL}+("])(?:' + "|".join(f"(?P<{kind}>{shape})" for kind, shape in _SHAPES.items()) + r")(?![A-Za-z0-9])")
#: The same for each kind alone; of some, a shorter reading can be right where the longest is not.
_ALONE = {kind: re.compile(shape + r"(?![A-Za-z0-9])") for kind, shape in _SHAPES.items()}
_SHORTER = ("iban", "phone", "card")
#: No check but that of an e-mail's length reads further than this from where it starts.
_REACH = 80
#: Nothing can be found in a text without one of these.
_HINT = re.compile(r"[@0-9]")


def _round(key: bytes, tweak: str, number: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{number}|{value}".encode(), key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network on a * b >= size, repeated
    (cycle walking) until the value is below size."""
    a = max(1, isqrt(size))
    b = -(-size // a)
    rounds = range(ROUNDS)
    while True:
        left, right = divmod(value, b)
        for i in reversed(rounds) if undo else rounds:
            sign = -1 if undo else 1
            if i % 2:
                left = (left + sign * _round(key, tweak, i, right)) % a
            else:
                right = (right + sign * _round(key, tweak, i, left)) % b
        value = left * b + right
        if value < size:
            return value


def _digits(text: str, key: bytes, tweak: str, undo: bool) -> str:
    """Permutes the digits of a text among numbers of as many digits; all else stays."""
    d = re.sub(r"\D", "", text)
    if not d:
        return text
    new = iter(str(permute(int(d), 10 ** len(d), key, f"{tweak}{len(d)}", undo)).zfill(len(d)))
    return re.sub(r"\d", lambda _: next(new), text)


def _walk(text: str, step, fits) -> str:
    """step until the value fits its format; a value that fits always comes to one that does."""
    while True:
        text = step(text)
        if fits(text):
            return text


def _luhn(d: str) -> int:
    return sum(n if i % 2 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(d)))) % 10


def _is_card(t: str) -> bool:
    d = re.sub(r"\D", "", t)
    return 13 <= len(d) <= 19 and d[0] != "0" and len(set(d)) > 1 and _luhn(d[:-1]) == (10 - int(d[-1])) % 10


def _card(t: str, key: bytes, undo: bool) -> str:
    """Permutes all digits but the last, which is the check digit of the others."""

    def step(t: str) -> str:
        new = _digits(re.sub(r"\D", "", t)[:-1], key, "card", undo)
        out = iter(new + str((10 - _luhn(new)) % 10))
        return re.sub(r"\d", lambda _: next(out), t)

    return _walk(t, step, _is_card)


def _is_ip(t: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in t.split("."))


def _ip(t: str, key: bytes, undo: bool) -> str:
    n = permute(int.from_bytes(bytes(map(int, t.split("."))), "big"), 1 << 32, key, "ip", undo)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _is_ssn(t: str) -> bool:
    a, b, c = re.split("[ -]", t)
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def _is_ip6(t: str) -> bool:
    """Written as addresses are printed (RFC 5952), in one case, not starting with a colon. One of fewer than
    four groups is in the ranges that are given out (2000::/3, fc00::/7, fe80::/10, ff00::/8)."""
    try:
        if str(ipaddress.IPv6Address(t)) != t.lower() or t not in (t.lower(), t.upper()) or t[0] == ":" or not any(c.isdigit() for c in t):
            return False
        groups = [g for g in t.lower().split(":") if g]
        return len(groups) > 3 or len(groups[0]) == 4 and bool(re.match("[23]|f[cdf]|fe[89ab]", groups[0]))
    except ValueError:
        return False


def _ip6(t: str, key: bytes, undo: bool) -> str:
    def step(t: str) -> str:
        return str(ipaddress.IPv6Address(permute(int(ipaddress.IPv6Address(t)), 1 << 128, key, "ip6", undo)))

    upper, shape = t != t.lower(), re.compile(_SHAPES["ip6"])
    new = _walk(t, step, lambda x: _is_ip6(x) and shape.fullmatch(x) and (not upper or x != x.upper()))
    return new.upper() if upper else new


def _day(t: str) -> tuple[dt.date, str] | None:
    """The day a text names, and which part of it (y, m, d) each of its fields is; of day/month and
    month/day the first that is a valid day."""
    fields = re.findall(r"\d+|[A-Za-z]+", t)
    for roles in ("ymd", "dmy", "mdy"):
        got = dict(zip(roles, fields, strict=True))
        if not got["y"].isdigit() or not got["d"].isdigit() or len(got["y"]) != 4 and (roles == "ymd" or len(got["y"]) != 2):
            continue
        year = int(got["y"])
        if len(got["y"]) == 2:
            year += (FIRST_SHORT_YEAR - year + 99) // 100 * 100
        month = int(got["m"]) if got["m"].isdigit() else [m[:3] for m in MONTHS].index(got["m"][:3].title()) + 1
        try:
            day = dt.date(year, month, int(got["d"]))
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return day, roles
    return None


def _look(day: dt.date) -> tuple[int, bool, bool]:
    """What of a day decides how it can be written: digits of day and month, whether the number of the
    day can be that of a month, and whether two digits can be its year."""
    return (day.day > 9) + (day.day > 12), day.month > 9, 0 <= day.year - FIRST_SHORT_YEAR < 100


@lru_cache(maxsize=1)
def _days() -> dict[tuple[int, bool, bool], list[int]]:
    """All days of the range, by their look."""
    out = defaultdict(list)
    for n in range(FIRST_DAY, LAST_DAY + 1):
        out[_look(dt.date.fromordinal(n))].append(n)
    return out


def _date(t: str, key: bytes, undo: bool) -> str:
    """Permutes the day's rank among the days of 1900 to 2099 with its look, so that every way of
    writing the day can write its pseudonym. An abbreviated month does not become May, which has no
    abbreviation."""
    day, roles = _day(t)
    short = re.search(r"(?<![A-Za-z])(?![Mm][Aa][Yy])[A-Za-z]{3}(?![A-Za-z])", t)
    same = _days()[_look(day)]
    while True:
        n = permute(bisect_left(same, day.toordinal()), len(same), key, f"date{_look(day)}", undo)
        day = dt.date.fromordinal(same[n])
        if not (short and day.month == 5):
            break
    left = iter(roles)

    def field(m: re.Match) -> str:
        old, new = m[0], {"y": day.year, "m": day.month, "d": day.day}[next(left)]
        if old.isdigit():
            return str(new)[-2:] if len(old) == 2 and new > 99 else str(new).zfill(len(old))
        name = MONTHS[new - 1][: 3 if short else None]
        return name.upper() if old.isupper() else name.lower() if old.islower() else name

    return re.sub(r"\d+|[A-Za-z]+", field, t)


def _is_iban(t: str) -> bool:
    s = t.replace(" ", "")
    return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(t: str, key: bytes, undo: bool) -> str:
    """Permutes the digits after the check digits, and sets those anew."""
    s = t.replace(" ", "")
    body = _digits(s[4:], key, "iban" + s[:2] + re.sub(r"\d", "0", s[4:]), undo)
    check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
    new = iter(f"{s[:2]}{check:02d}{body}")
    return re.sub(r"\S", lambda _: next(new), t)


def _is_phone(t: str) -> bool:
    return (9 if t[0] == "0" else 10) <= len(re.sub(r"\D", "", t)) <= 15


def _phone(t: str, key: bytes, undo: bool) -> str:
    """A country code, or the 0 that stands for it, stays; the digits after it are permuted."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{2}|0|", t)[0]
    zero = lambda x: re.search(r"\d", x)[0] == "0"
    return code + _walk(t[len(code) :], lambda x: _digits(x, key, "phone", undo), lambda x: zero(x) == zero(t[len(code) :]))


def _email(t: str, key: bytes, undo: bool) -> str:
    """Letters and digits before the @ are permuted as numbers of their own alphabets (plain and accented
    Latin, Greek, Cyrillic), letters keeping the case they are found in; signs and the domain stay."""
    local, domain = t.split("@")
    own = [_ALPHABETS.get(c, [c]) for c in local.lower()]
    rank, size = 0, 1
    for c, alphabet in zip(local.lower(), own, strict=True):
        rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
    rank = permute(rank, size, key, "email" + "".join(alphabet[0] for alphabet in own) + "@" + domain.lower(), undo)
    out = []
    for old, alphabet in zip(reversed(local), reversed(own), strict=True):
        rank, c = divmod(rank, len(alphabet))
        out.append(alphabet[c].upper() if old.isupper() else alphabet[c])
    return "".join(reversed(out)) + "@" + domain


#: kind: (check, pseudonym). Checked in the order of the pattern.
_KINDS = {
    "email": (lambda t: len(t) <= 254, _email), "iban": (_is_iban, _iban), "ip": (_is_ip, _ip), "ip6": (_is_ip6, _ip6),
    "date": (lambda t: _day(t) is not None, _date),
    "ssn": (_is_ssn, lambda t, key, undo: _walk(t, lambda x: _digits(x, key, "ssn", undo), _is_ssn)),
    "phone": (_is_phone, _phone), "card": (_is_card, _card)}


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> str | None:
    """The value's pseudonym, or the value of a pseudonym; None if it fails its kind's check."""
    valid, make = _KINDS[kind]
    return make(value, key, undo) if valid(value) else None


def _readings(text: str, m: re.Match):
    """(kind, end) of all that may start where m does, the longest of each kind first; m itself first
    of all. Shorter ones end before a separator."""
    start = m.start()
    yield m.lastgroup, m.end()
    for kind, shape in _ALONE.items():
        if not (whole := shape.match(text, start)):
            continue
        yield kind, whole.end()
        if kind in _SHORTER:
            for end in range(whole.end() - 1, start + 9, -1):
                if not text[end].isalnum() and text[end - 1].isalnum() and shape.fullmatch(text, start, end):
                    yield kind, end
    if m.lastgroup == "phone":
        yield "card", m.end()


def _next(text: str, look: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of the first valid value from look on. A match that fails its check in all
    readings is searched from its second character on; but the digits of an IBAN of its country's
    length, whose check digits are wrong, are nothing else."""
    while m := _PATTERN.search(text, look):
        look = m.start() + 1
        for kind, end in _readings(text, m):
            value = text[m.start() : end]
            if _KINDS[kind][0](value):
                return kind, m.start(), end
            if kind == "iban" and IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")):
                look = end
    return None


def replace(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in code points of the new text (the
    same as in the old: formats keep their length, but for addresses and unpadded dates).

    What is read as a value depends on what its neighbours read as, so a pseudonym must leave all
    values near it where they were; one that would not is permuted again. Values are replaced from
    the last to the first, and undone from the first to the last, so both see the same neighbours."""
    if not _HINT.search(text):
        return text, []
    found, look = [], 0
    while v := _next(text, look):
        found.append(v)
        look = v[2]
    values = [text[a:b] for _, a, b in found]
    ends = [0, *(b for *_, b in found)]
    gaps = [text[e:a] for e, (_, a, _) in zip(ends, found)] + [text[ends[-1] :]]
    for k in range(len(found)) if undo else reversed(range(len(found))):
        kind, first = found[k][0], k
        while first and sum(len(values[i]) + len(gaps[i + 1]) for i in range(first - 1, k)) < _REACH:
            first -= 1
        while True:
            values[k] = pseudonym(kind, values[k], key, undo)
            if _stays(found, values, gaps, first, k):
                break
    out, spans, size = [], [], 0
    for (kind, *_), gap, value in zip(found, gaps, values):
        out += [gap, value]
        spans.append((kind, size + len(gap), size + len(gap) + len(value)))
        size = spans[-1][2]
    return "".join([*out, gaps[-1]]), spans


def _stays(found: list, values: list[str], gaps: list[str], first: int, last: int) -> bool:
    """Whether the values from first to last are read as they are, in what surrounds them."""
    before = values[first - 1][-1:] if first else ""
    parts, size, after = [before], 0, last
    for i in range(first, last + 1):
        parts += [gaps[i], values[i]]
    while after + 1 < len(values) and size < _REACH:
        parts += [gaps[after + 1], values[after + 1]]
        size, after = size + len(parts[-1]) + len(parts[-2]), after + 1
    if after + 1 == len(values):
        parts.append(gaps[-1])
    text, look = "".join(parts), len(before)
    for i in range(first, last + 1):
        start = look + len(gaps[i])
        if _next(text, look) != (found[i][0], start, start + len(values[i])):
            return False
        look = start + len(values[i])
    return True


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """docs with its text replaced, and a column pii: array of (kind, start, stop) of the pseudonyms.
    key: 1 to 64 secret bytes.

    Numbers that fail their check in every reading stay as they are. A null text stays null and an empty one empty,
    both with no pii. Repeated rows each get the same answer. pii takes another name if docs has a
    column of that name; other columns stay as they are."""
    (pii,) = fresh(docs, "pii")
    at = docs.columns.index(text)

    def run(batches):
        for batch in pieces(batches):
            texts, spans = [], []
            for t in batch.column(at).to_pylist():
                new, found = (None, []) if t is None else replace(t, key, undo)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            columns = [*batch.columns, pa.array(spans, kind)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, pii])

    schema = docs.withColumn(pii, F.array().cast("array<struct<kind: string, start: int, stop: int>>")).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(run, schema)
