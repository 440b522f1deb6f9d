"""Pseudonyms for personal numbers and dates that keep their format."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType

from .tokens import in_pieces

ROUNDS = 8
# Signs that are permuted together; longer texts are cut into blocks.
BLOCK = 32
# Fewest digits of a card number.
CARD_LEAST = 13


class Feistel:
    """A keyed permutation of ``range(size)``, one for each ``kind``.

    An unbalanced Feistel network over the pairs of two digits whose bases span ``size``; values that leave the
    range, or that ``valid`` refuses, are permuted again, which keeps it a permutation.
    """

    def __init__(self, key: str, kind: str, size: int):
        self.size = size
        self.low = 1 << -(-size.bit_length() // 2)
        self.high = -(-size // self.low)
        self.secret = hashlib.blake2b(f"{kind}/{size}".encode(), key=hashlib.sha256(key.encode()).digest()).digest()

    def _round(self, number: int, value: int) -> int:
        text = number.to_bytes(1, "big") + value.to_bytes(64, "big")
        return int.from_bytes(hashlib.blake2b(text, key=self.secret, digest_size=40).digest(), "big")

    def _once(self, value: int, order, sign: int) -> int:
        left, right = divmod(value, self.low)
        for number in order:
            if number % 2:
                right = (right + sign * self._round(number, left)) % self.low
            else:
                left = (left + sign * self._round(number, right)) % self.high
        return left * self.low + right

    def permute(self, value: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        order, sign = (range(ROUNDS)[::-1], -1) if back else (range(ROUNDS), 1)
        while True:
            value = self._once(value, order, sign)
            if value < self.size and valid(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def _card_ok(digits: str) -> bool:
    return luhn(digits) and len(set(digits)) > 1


def _iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


# Signs of an IBAN, by country.
IBAN_LENGTHS = {country: int(length) for length, countries in (part.split(":") for part in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,DZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for country in countries.split(",")}


def _into(shape: str, signs: str) -> str:
    """``shape`` with its letters and digits replaced by ``signs`` in turn."""
    rest = iter(signs)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


# Alphabets of the signs of a text, by the sign's own kind.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _alphabet(sign: str) -> str:
    return _DIGITS if sign in _DIGITS else _LOWER if sign in _LOWER else _UPPER if sign in _UPPER else sign


class Pseudonyms:
    """Replaces what it finds in a text; ``back`` undoes it with the same key."""

    # One expression for all, so that a text is scanned once; what matches is then validated by its kind.
    FIND = re.compile(
        r"(?P<email>(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))"
        r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
        r"|(?P<secret>(?i:(?:token|secret|password|api[_-]?key)\s*[=:]\s*\"?)(?P<value>[0-9a-fA-F]{32,64})(?![0-9A-Za-z]))"
        r"|(?P<phone>(?<![\w+(.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}"
        r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-]|\.\d))"
        r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
        r"|(?P<iso>(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d)|(?![\w-])))"
        r"|(?P<date>(?<![\w/.-])\d{1,2}(?P<mark>[/.-])\d{1,2}(?P=mark)\d{4}(?![\w/-]|\.\d))"
        r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
        r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))")
    FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = key, back
        self.networks: dict[tuple[str, int], Feistel] = {}

    def _permute(self, kind: str, size: int, value: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        network = self.networks.get((kind, size))
        if network is None:
            if len(self.networks) > 1000:
                self.networks.clear()
            network = self.networks[kind, size] = Feistel(self.key, kind, size)
        return network.permute(value, valid, self.back)

    def _signs(self, kind: str, text: str) -> str:
        """Every letter by a letter of its case and every digit by a digit, in blocks; other signs stay."""
        return "".join(self._block(f"{kind}{at}", text[at:at + BLOCK]) for at in range(0, len(text), BLOCK))

    def _block(self, kind: str, text: str) -> str:
        sets = [_alphabet(c) for c in text]
        value, size = 0, 1
        for sign, alphabet in zip(text, sets):
            value, size = value * len(alphabet) + alphabet.index(sign), size * len(alphabet)
        value = self._permute(kind, size, value)
        out = []
        for alphabet in reversed(sets):
            value, at = divmod(value, len(alphabet))
            out.append(alphabet[at])
        return "".join(reversed(out))

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c in _DIGITS)
        if not _card_ok(digits):
            return None
        # Any digits but the last have exactly one last digit that makes the sum right. Beginnings that would pass as
        # cards themselves stay so and others do not become so, whatever the separators: `back` ends where this ended.
        body = len(digits) - 1
        shorter = [(n, _card_ok(digits[:n])) for n in range(CARD_LEAST, len(digits))]

        def valid(value: int) -> bool:
            head = f"{value:0{body}d}"
            return len(set(head)) > 1 and all(_card_ok(head[:n]) == was for n, was in shorter)

        new = self._permute("card", 10 ** body, int(digits[:-1]), valid)
        head = f"{new:0{body}d}"
        return _into(text, head + next(d for d in _DIGITS if luhn(head + d)))

    def phone(self, text: str) -> str | None:
        lead = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        kept = lead[0] if lead else ""
        digits = "".join(c for c in text[len(kept):] if c in _DIGITS)
        if not 7 <= len(digits) <= 15:
            return None
        return kept + _into(text[len(kept):], f"{self._permute('phone', 10 ** len(digits), int(digits)):0{len(digits)}d}")

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
            return None
        value = self._permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def valid(value: int) -> bool:
            area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not valid(value):
            return None
        return _into(text, f"{self._permute('ssn', 10 ** 9, value, valid):09d}")

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or not _iban_ok(plain):
            return None
        country, body = plain[:2], self._signs("iban", plain[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return _into(text, f"{country}{check:02d}{body}")

    def email(self, text: str) -> str | None:
        local, domain = text.rsplit("@", 1)
        new = self._signs("email", local)
        return f"{new}@{domain}"

    def secret(self, text: str, value: str) -> str:
        return text[:len(text) - len(value)] + self._hex(value)

    def _hex(self, value: str) -> str:
        digits = value.lower()
        new = f"{self._permute('secret', 16 ** len(digits), int(digits, 16)):0{len(digits)}x}"
        return new.upper() if value.isupper() else new

    def _day(self, kind: str, value: int, valid: Callable[[int], bool] = lambda _: True) -> dt.date:
        new = self._permute(kind, self.LAST - self.FIRST + 1, value - self.FIRST, lambda v: valid(v + self.FIRST))
        return dt.date.fromordinal(new + self.FIRST)

    def iso(self, text: str) -> str | None:
        day = _date(*map(int, text.split("-")))
        if day is None or not self.FIRST <= day.toordinal() <= self.LAST:
            return None
        return self._day("date", day.toordinal()).isoformat()

    def date(self, text: str) -> str | None:
        mark = re.search(r"[/.-]", text)[0]
        one, two, year = text.split(mark)
        # Month first with a slash wherever that reads as a date, else day first; each stays among its own.
        month_first = mark == "/" and _date(int(year), int(one), int(two)) is not None
        day = _date(int(year), int(one), int(two)) if month_first else _date(int(year), int(two), int(one))
        if day is None or not self.FIRST <= day.toordinal() <= self.LAST:
            return None
        widths = (len(one), len(two))

        def valid(value: int) -> bool:
            new = dt.date.fromordinal(value)
            pair = (new.month, new.day) if month_first else (new.day, new.month)
            if mark == "/" and not month_first and new.day <= 12:
                return False
            # Numbers written with one digit stay below 10, and those written with two can hold any.
            return all(width == 2 or number < 10 for number, width in zip(pair, widths))

        kind = f"date{mark}{month_first}{widths}" if min(widths) == 1 or mark == "/" and not month_first else "date"
        new = self._day(kind, day.toordinal(), valid)
        pair = (new.month, new.day) if month_first else (new.day, new.month)
        return mark.join([f"{number:0{width}d}" for number, width in zip(pair, widths)] + [f"{new.year:04d}"])

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds found, in order."""
        found: list[str] = []

        out, done, at = [], 0, 0
        while (match := self.FIND.search(text, at)) is not None:
            kind = match.lastgroup if match.lastgroup not in ("value", "mark") else \
                "secret" if match["secret"] is not None else "date"
            for whole in self._endings(kind, match[0]):
                new = self.secret(whole, match["value"]) if kind == "secret" else getattr(self, kind)(whole)
                if new is not None:
                    out += [text[done:match.start()], new]
                    at = done = match.start() + len(whole)
                    found.append("date" if kind == "iso" else kind)
                    break
            else:
                at = match.start() + self._passed(kind, match[0])
        return "".join(out) + text[done:], found

    @classmethod
    def _passed(cls, kind: str, text: str) -> int:
        """How much of a match that failed is passed over: what begins at a later blank of it can still be valid.

        The digits of what is as long as an IBAN of its country are its own.
        """
        if kind == "iban" and (size := IBAN_LENGTHS.get(text[:2])) is not None:
            first = cls._endings(kind, text)[0]
            if len(first.replace(" ", "")) == size:
                return len(first)
        return text.find(" ") + 1 or len(text)

    @staticmethod
    def _endings(kind: str, text: str) -> list[str]:
        """The beginnings of a match, up to a separator, that are tried in turn: words and numbers may follow a number.

        Those of a card shortest first, as ``back`` then ends at the same; but the whole match alone where a short
        number stands before. Those of an IBAN as long as its country's first, then the longest.
        """
        if kind == "card":
            groups = re.split("[ -]", text)
            cuts = [at for at, sign in enumerate(text) if sign in " -"] if len(groups[0]) >= 4 else []
            return [text[:at] for at in cuts if sum(c in _DIGITS for c in text[:at]) >= CARD_LEAST] + [text]
        if kind == "iban":
            ends = [text[:at] for at in range(len(text), 0, -1) if at == len(text) or text[at] == " "]
            return sorted(ends, key=lambda end: len(end.replace(" ", "")) != IBAN_LENGTHS.get(text[:2]))
        return [text]


def _date(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


_HINT = re.compile(r"[0-9@]")


def pseudonymise(documents: DataFrame, key: str, back: bool = False, kinds: str | None = "pii_kinds") -> DataFrame:
    """``documents`` with personal numbers and dates in ``text`` replaced by others of the same format.

    Replaced are payment card numbers (Luhn sum), IBANs (check digits), US social security numbers, telephone
    numbers, IPv4 addresses, calendar dates from 1900 to 2099, local parts of email addresses and labelled hexadecimal
    secrets. A number may be followed by words or other numbers. What does not pass its check stays. A value has one pseudonym under a key, whatever its
    separators, so that equal values stay linked across documents; the key holder can turn it ``back``.
    ``kinds`` names a column of the kinds found in order, or is None. Null texts stay null.
    One pass, no shuffle; a clashing column is replaced.
    """
    schema = documents.schema if kinds is None else documents.drop(kinds).schema.add(kinds, ArrayType(StringType()))
    source = documents if kinds is None else documents.drop(kinds)
    place = source.columns.index("text")

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, back)
        for batch in in_pieces(batches, "text", 4 << 20):
            texts, found = [], []
            for text in batch["text"].to_pylist():
                new, what = pseudonyms.replace(text) if text is not None and _HINT.search(text) else (text, [])
                texts.append(new)
                found.append(what)
            batch = batch.set_column(place, "text", pa.array(texts, pa.string()))
            yield batch if kinds is None else batch.append_column(kinds, pa.array(found, pa.list_(pa.string())))

    return source.mapInArrow(replaced, schema)
