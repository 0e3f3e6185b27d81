"""Values found and linked however they are written, long texts, and a plain scan of all substrings."""

import datetime as dt
import ipaddress
import random
import re
import time

import pytest

from farewright.llm import pseudonyms
from tests.llm.fixtures import empty

KEY = b"secret"


def new(value):
    return pseudonyms.replace(value, KEY)[0]


@pytest.mark.parametrize("text, kind", [
    ("1984/02/29", "date"), ("02-29-1984", "date"), ("3 March 1984", "date"), ("MARCH 3, 1984", "date"), ("3 Mar 1984", "date"), ("3. may 1984", "date"), ("1.02.2003", "date"),
    ("3/14/85", "date"), ("12.3.84", "date"), ("02/29/00", "date"), ("123 45 6789", "ssn"), ("2001:db8::1", "ip6"), ("fe80::1", "ip6"), ("FD00:1::", "ip6"), ("2001:db8::", "ip6"), ("SA0380000000608010167519", "iban"),
    ("TR330006100519786457841326", "iban"), ("john.o'brien@example.com", "email"), ("jürgen@example.com", "email"), ("Ünal.Öz@example.com", "email"), ("иван7@example.com", "email"), ('"john smith"@example.com', "email"),
    ("2001:db8::ff00:42:8329", "ip6"), ("2001:DB8:0:A:FF00:42:8329:1", "ip6"), ("030 901820", "phone"), ("020 7946 0958", "phone"), ("4845168114407329 123", "card"), ("4845 1681 1440 7329 12/27", "card"),
    ("DE89370400440532013000 EUR", "iban"), ("DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606", "iban")])
def test_found_and_undone(text, kind):
    for k in range(20):
        changed, found = pseudonyms.replace(text, b"%d" % k)
        assert {f[0] for f in found} == {kind} and len(found) == 1 + ("FR14" in text)
        assert pseudonyms.replace(changed, b"%d" % k, undo=True)[0] == text
    assert changed != text


@pytest.mark.parametrize("text", ["dead::beef", "12:30:45", "aa:bb:cc:dd:ee:ff", "a::b::c::d", "2001:0db8::1:2:3", "std::v1", "a1::b2", "12::30", "1.2.34.567", "1/2/34/5", "13/13/85", "900 45 6789", "13/13/2001", "30 February 2001", "5551234567", "March 1984", "1:2:3:4:5:6:7:8:9"])
def test_left_alone(text):
    assert pseudonyms.replace(text, KEY) == (text, [])


def test_one_day_in_every_format():
    r = random.Random(2)
    for _ in range(300):
        day = dt.date.fromordinal(r.randrange(dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()))
        name = f"{day:%B}"
        texts = [f"{day:%Y-%m-%d}", f"{day.year}/{day.month}/{day.day}", f"{day:%d/%m/%Y}", f"{day.day}.{day.month}.{day.year}", f"{day.day} {name} {day.year}", f"{name.upper()} {day.day}, {day.year}"]
        if day.day > 12:
            texts.append(f"{day:%m-%d-%Y}")
        if 1930 <= day.year < 2030:
            texts += [f"{day:%d/%m/%y}", f"{day.day}.{day.month}.{day:%y}"]
        assert len({pseudonyms._day(new(t))[0] for t in texts}) == 1
        assert all(pseudonyms.replace(new(t), KEY, undo=True)[0] == t for t in texts)


def test_case_and_country_code():
    assert new("John.B7@x.com").lower() == new("john.b7@X.com").lower() and new("John.B7@x.com")[0].isupper()
    assert new("+1 555-123-4567") == "+1 " + new("555-123-4567")
    assert new("+49 30 901820")[4:] == new("030 901820")[1:]


def test_signs_and_letters_of_addresses():
    """All letters and digits before the @ are of the pseudonym's alphabet; signs, case and domain stay."""
    for value in ("john.o'brien@x.com", "jürgen@x.com", "Ünal_Öz+1@x.com", "ω7@x.com", '"a b"@x.com'):
        got = new(value)
        assert len(got) == len(value) and got.endswith("@x.com") and got != value
        assert [(c.isalpha(), c.isdigit(), c.isupper(), c if not c.isalnum() else "") for c in got] == [(c.isalpha(), c.isdigit(), c.isupper(), c if not c.isalnum() else "") for c in value]


def luhn(d):
    return sum(n if i % 2 == 0 else 2 * n - 9 * (2 * n > 9) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def day(y, m, d):
    try:
        return dt.date(int(y), int(m), int(d)) and 1900 <= int(y) < 2100
    except ValueError:
        return False


def kinds_of(s):
    """The kinds of s as a whole, stated plainly and apart from the library."""
    d = re.sub("[^0-9]", "", s)
    out = set()
    if re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9 ]*[A-Z0-9]", s) and "  " not in s:
        x = s.replace(" ", "")
        if pseudonyms.IBAN_LENGTHS.get(x[:2]) == len(x) and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
            out.add("iban")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", s):
        try:
            ipaddress.IPv4Address(s)
            out.add("ip")
        except ValueError:
            pass
    p = re.split("[-/.]", s)
    if len(p) == 3 and all(x.isdigit() for x in p) and s[len(p[0])] == s[-len(p[2]) - 1]:
        wide = [len(x) for x in p]
        if wide[0] == 4 and (("-" in s and wide[1:] == [2, 2]) or ("/" in s and max(wide[1:]) <= 2)) and day(*p):
            out.add("date")
        if wide[2] == 4 and max(wide[:2]) <= 2 and (day(p[2], p[1], p[0]) or day(p[2], p[0], p[1])):
            out.add("date")
        if "-" not in s and wide[2] == 2 and max(wide[:2]) <= 2:
            year = str(1900 + int(p[2]) + 100 * (int(p[2]) < 30))
            if day(year, p[1], p[0]) or day(year, p[0], p[1]):
                out.add("short date")
        if "-" in s and wide == [3, 2, 4] and p[0] not in ("000", "666") and p[0][0] != "9" and p[1] != "00" and p[2] != "0000":
            out.add("ssn")
    if re.fullmatch(r"\d{3} \d\d \d{4}", s) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
        out.add("ssn")
    if re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", s):
        out.add("phone")
    if re.fullmatch(r"0\d{1,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}", s) and len(d) > 8:
        out.add("phone from 0")
    if re.fullmatch(r"\d(?:[ -]?\d)*", s) and 13 <= len(d) <= 19 and d[0] != "0" and len(set(d)) > 1 and luhn(d):
        out.add("card")
    return out


ORDER = ["iban", "ip", "date", "short date", "ssn", "phone", "phone from 0", "card"]


def scan(text):
    """(kind, start, end): from each place where no letter or digit precedes, of all substrings that end
    where none follows, the first kind in order, the longest of it. Digits of an IBAN of its country's
    length with wrong check digits are nothing."""
    found, at = [], 0
    while at < len(text):
        if not (text[at].isalnum() and not text[at - 1 : at].isalnum()):
            at += 1
            continue
        ends = [e for e in range(min(len(text), at + 60), at, -1) if text[e - 1].isalnum() and not text[e : e + 1].isalnum()]
        part_of_more = lambda k, e: k == "ip" and (text[at - 1 : at] == "." or re.match(r"\.[0-9A-Za-z]", text[e:])) or k == "ssn" and "-" in (text[at - 1 : at], text[e : e + 1]) or k == "short date" and (
            (sign := re.search("[./]", text[at:e])[0]) == text[at - 1 : at] or text[e : e + 1] == sign and text[e + 1 : e + 2].isalnum())
        best = min(((ORDER.index(k), -e) for e in ends for k in kinds_of(text[at:e]) if not part_of_more(k, e)), default=None)
        if best:
            found.append(("date" if ORDER[best[0]] == "short date" else ORDER[best[0]].split()[0], at, -best[1]))
            at = -best[1]
        else:
            wrong = [e for e in ends if re.fullmatch(r"[A-Z]{2}\d\d( ?[A-Z0-9])+", text[at:e]) and pseudonyms.IBAN_LENGTHS.get(text[at : at + 2]) == len(text[at:e].replace(" ", ""))]
            at = min(wrong, default=at + 1)
    return found


def test_scan_of_all_substrings():
    """Parts are joined by words, so that readings of neighbours do not mix, and by blanks."""
    r = random.Random(11)
    parts = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "192.168.1.10", "1.2.2003", "2024-01-31", "1984/2/29", "02-29-1984", "3/14/85", "12.3.84", "123 45 6789", "123-45-6789", "555-123-4567", "030 901820", "12/27", "999", "EUR"]
    joins = [" and ", ", ", " ", "; x", " (", "\n"]
    seen = 0
    for _ in range(3000):
        text = ""
        for _ in range(r.randrange(1, 5)):
            part = r.choice(parts)
            if r.random() < 0.3:
                i = r.randrange(len(part))
                part = part[:i] + r.choice("0123456789 -.") + part[i + 1 :]
            text += part + r.choice(joins)
        want = scan(text)
        got, look = [], 0
        while v := pseudonyms._next(text, look):
            got.append(v)
            look = v[2]
        assert got == want, text
        seen += len(want)
    assert seen > 4000


@pytest.mark.parametrize("text", [
    "a" * 230 + "@b.com", "x" * 60 + "@b.com", "a." * 2_500_000, "a." * 500_000 + "@", "a@" + "b." * 1_000_000 + "1", "a@" + "b" * 2_000_000, "1 " * 100_000, "12-" * 60_000, "AB12 " * 50_000, "a:" * 500_000, "+" * 500_000 + "1"],
    ids=["longer local part", "long local part", "dots", "dots before at", "labels", "label", "digits", "dashes", "like ibans", "colons", "plus"])
def test_long_texts(spark, text):
    docs = empty(spark).unionByName(spark.createDataFrame([(1, text, "en", "s", 1)], empty(spark).schema))
    begun = time.monotonic()
    got = pseudonyms.pseudonymise(docs, KEY).first()
    assert time.monotonic() - begun < 60
    assert pseudonyms.replace(got.text, KEY, undo=True)[0] == text
    assert len(got.pii) == (text[:2] == "xx")
