"""Valid numbers next to other digits or capitals."""

import random

import pytest

from farewright.llm import pseudonyms

IBAN = "DE89 3704 0044 0532 0130 00"
KEY = b"secret"


@pytest.mark.parametrize("text, values", [
    ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
    ("4111111111111111 123", ["4111111111111111"]),
    ("2 4111111111111111", ["4111111111111111"]),
    ("4111111111111111 192.168.1.10", ["4111111111111111", "192.168.1.10"]),
    (f"{IBAN} BIC COBADEFFXXX", [IBAN]),
    ("DE89370400440532013000 AND MORE", ["DE89370400440532013000"]),
    (f"{IBAN} 2024-01-31", [IBAN, "2024-01-31"]),
    (f"{IBAN} 4111 1111 1111 1111 123 10.1.2.3", [IBAN, "4111 1111 1111 1111", "10.1.2.3"])])
def test_neighbours(text, values):
    new, found = pseudonyms.replace(text, KEY)
    assert len(found) == len(values) and not any(v in new for v in values)
    assert pseudonyms.replace(new, KEY, undo=True)[0] == text


def test_undo_among_digits():
    """Any row of numbers comes back, though a pseudonym may make its neighbours valid or not."""
    r = random.Random(4)
    parts = ["4111 1111 1111 1111", "4111111111111111", IBAN, "192.168.1.10", "1.2.2003", "2024-01-31", "123-45-6789", "+1 (017) 555-7713", "378282246310005", "5555-5555-5555-4444"]
    for _ in range(1500):
        text = " ".join(r.choice([*parts, str(r.randrange(10 ** r.randrange(1, 7)))]) for _ in range(r.randrange(1, 9)))
        new, found = pseudonyms.replace(text, KEY)
        assert [k for k, *_ in pseudonyms.replace(new, KEY)[1]] == [k for k, *_ in found], text
        assert pseudonyms.replace(new, KEY, undo=True)[0] == text, (text, new)
