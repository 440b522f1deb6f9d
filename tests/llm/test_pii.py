import datetime as dt
import random
import re

import helpers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablewash.llm import pii

KEY = "a test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    network = pii.Feistel(KEY, "test", size)
    images = [network.permute(v) for v in range(size)]
    assert sorted(images) == list(range(size))
    assert [network.permute(v, back=True) for v in images] == list(range(size))


@given(st.integers(1, 10 ** 40), st.data())
def test_feistel_round_trip(size, data):
    value = data.draw(st.integers(0, size - 1))
    network = pii.Feistel(KEY, "test", size)
    assert 0 <= network.permute(value) < size and network.permute(network.permute(value), back=True) == value


CASES = {
    "card": "4111 1111 1111 1111", "phone": "+1 (017) 555-7713", "ip": "97.51.17.173", "ssn": "219-09-9999",
    "iban": "DE89 3704 0044 0532 0130 00", "email": "Jane.Doe42@mail7.example.com",
    "secret": 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
}


@pytest.mark.parametrize("kind", CASES)
def test_formats_are_kept_and_values_linked(kind):
    value = CASES[kind]
    forth, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    text = f"before {value} after {value}."
    new, found = forth.replace(text)
    assert found == [kind, kind] and value not in new
    one, other = re.fullmatch(r"before (.*) after (.*)\.", new).groups()
    assert one == other
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", s)))
    if kind in ("card", "phone", "ssn", "email"):
        assert shape(one) == shape(value)
    assert back.replace(new)[0] == text
    assert pii.Pseudonyms("another key").replace(text)[0] != new
    assert forth.replace(f"elsewhere {value}!")[0] == f"elsewhere {one}!"


def test_separators_do_not_matter():
    forth = pii.Pseudonyms(KEY)
    plain, dashed = forth.replace("4111111111111111")[0], forth.replace("4111-1111-1111-1111")[0]
    assert dashed.replace("-", "") == plain and pii.luhn(plain)


@pytest.mark.parametrize("text", [
    "9807915762804491", "1111111111111111", "300.1.2.3", "1.2.3", "version 1.2.3.4.5", "000-12-3456", "666-12-3456",
    "2020-02-30", "31/02/2020", "1850-01-01", "DE89 3704 0044 0532 0130 01", "a@b", "12345", "Version 2.0.",
    "Licensed under CC BY-NC 4.0.", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "20/20/2020"])
def test_what_fails_its_check_stays(text):
    assert pii.Pseudonyms(KEY).replace(text) == (text, [])


@pytest.mark.parametrize("kind, value, before, after", [
    ("card", "4111111111111111", "", " 12/25"), ("card", "4111 1111 1111 1111", "", " 123"),
    ("card", "4111-1111-1111-1111", "", "-12"), ("card", "4111111111111111", "12 ", ""),
    ("card", "4111 1111 1111 1111", "AB12 ", " 5500005555555559"), ("card", "378282246310005", "", " 1234 5678"),
    ("iban", "BE68539007547034", "", " EUR"), ("iban", "BE68 5390 0754 7034", "", " BANK"),
    ("iban", "DE89 3704 0044 0532 0130 00", "", " EUR 100"), ("date", "2024-03-05", "", "T10:00:00Z"),
    ("date", "2024-03-05", "", " 10:00")])
def test_numbers_are_found_before_and_after_others(kind, value, before, after):
    forth, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    text = f"paid {before}{value}{after} today"
    new, found = forth.replace(text)
    assert found[0] == kind and new.startswith(f"paid {before}") and value not in new
    alone = forth.replace(value)[0]
    assert alone != value and new.startswith(f"paid {before}{alone}")
    assert len(found) > 1 or new == f"paid {before}{alone}{after} today"
    assert back.replace(new)[0] == text


def test_cards_with_numbers_after_them_go_back():
    forth, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    rng = random.Random(7)
    for _ in range(300):
        head = str(rng.randrange(10 ** 14, 10 ** rng.choice([15, 16, 18])))
        card = head + next(d for d in "0123456789" if pii.luhn(head + d))
        shaped = " ".join(card[n:n + 4] for n in range(0, len(card), 4)) if rng.random() < 0.5 else card
        text = f"{shaped} {rng.randrange(1000)}"
        new, found = forth.replace(text)
        assert found == ["card"] and back.replace(new) == (text, ["card"])


def test_dates_are_permuted_within_their_format():
    forth, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    rng = random.Random(1)
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y"):
        seen = set()
        for _ in range(150):
            day = dt.date.fromordinal(rng.randrange(pii.Pseudonyms.FIRST, pii.Pseudonyms.LAST + 1))
            text = f"born {day.strftime(form)} here"
            new, found = forth.replace(text)
            assert found == ["date"] and back.replace(new)[0] == text
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
            seen.add((text, new))
        assert len({new for _, new in seen}) == len({text for text, _ in seen})
    for text in ("on 3/14/2001", "on 14/3/2001", "on 1.2.1999", "on 7/8/2010"):
        new = forth.replace(text)[0]
        assert new != text and back.replace(new)[0] == text


def test_table(spark):
    documents = helpers.clashing(helpers.edge_documents(spark))
    found = pii.pseudonymise(documents, KEY)
    assert found.count() == documents.count() and set(found.columns) == set(documents.columns)
    same = pii.pseudonymise(documents, KEY, kinds=None)
    assert same.schema == documents.schema and helpers.rows(same) == helpers.rows(documents)
    text = "card 4111111111111111, a.7@mail1.example.com +1 (974) 555-3436 64.147.79.24"
    table = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(table, KEY).collect()}
    assert rows[1].text == rows[2].text != text and rows[3].text is None and rows[3].pii_kinds == []
    assert rows[1].pii_kinds == ["card", "email", "phone", "ip"]
    undone = pii.pseudonymise(pii.pseudonymise(table, KEY), KEY, back=True)
    assert [r.text for r in undone.orderBy("doc_id").collect()] == [text, text, None]
    assert pii.pseudonymise(documents.limit(0), KEY).count() == 0
