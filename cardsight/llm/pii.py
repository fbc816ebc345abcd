"""Operator 5: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their checks (card numbers by Luhn, IBANs by their
check digits, social-security numbers by their ranges, IPv4 addresses, calendar
dates), phone numbers and mail addresses are replaced by others of the same
format. Phone numbers of the North American plan stay in it, those that it does
not assign stay outside it. Each kind has a keyed permutation of its valid values: a Feistel network
on the least even number of bits that holds the domain, walked on until it lands
on a valid value again. Equal values get equal pseudonyms in every document, and
different ones different pseudonyms, with no table of them to keep or share.
Check digits are worked out anew; separators, lengths and letter case stay.

Work is per row, in Arrow batches; nothing is shuffled.

Defined results: null texts stay null, empty texts empty; rows without such
values are unchanged; repeated rows are changed alike; an empty table gives an
empty result; all other columns pass through, whatever their names. Values that
fail their checks are left alone, dates only between 1900 and 2099 are moved.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cardsight.llm.common import in_arrow

KINDS = ("email", "iban", "ip", "ssn", "date", "card", "phone")

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})"
            r"(?!\d)",
    "phone": r"(?<!\d)(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
             r"|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4})(?!\d)",
}
_NUMBERS = "(?=[0-9+(A-Z])(?:" + "|".join(f"(?P<{kind}>{_PATTERNS[kind]})" for kind in KINDS[1:]) + ")"
_FIRST = {False: re.compile(_NUMBERS), True: re.compile(f"(?P<email>{_PATTERNS['email']})|{_NUMBERS}")}
_EACH = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
_HINT = re.compile("[0-9@]")

ROUNDS = 8
SMALL = 1_000   # smaller domains are turned by a keyed step, which leaves no value in place


class Feistel:
    """Keyed permutations of ranges of integers."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int) -> int:
        data = tweak + bytes([i]) + half.to_bytes(32, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _network(self, x: int, bits: int, tweak: bytes) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (self._round(tweak, i, right) & mask)
        return left << bits | right

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The image of ``x`` in the permutation of the valid values below ``size``."""
        named = f"{tweak}:{size}:".encode()
        if size < SMALL:
            step = 1 + self._round(named, 0, 0) % max(1, size - 1)
            x = (x + step) % size
            while not valid(x):
                x = (x + step) % size
            return x
        bits = ((size - 1).bit_length() + 1) // 2
        while True:
            x = self._network(x, bits, named)
            if x < size and valid(x):
                return x


def _refill(shape: str, digits: str, is_part: Callable[[str], bool] = str.isdigit) -> str:
    """``shape`` with the characters that ``is_part`` tells replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if is_part(c) else c for c in shape)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _card(f: Feistel, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_sum(digits) % 10 or not digits.strip("0"):
        return None
    n = len(digits) - 2  # the first digit stays, the last is the check digit
    body = digits[0] + str(f.permute(int(digits[1:-1]), 10 ** n, "card")).zfill(n)
    return _refill(found, body + str(-luhn_sum(body + "0") % 10))


_IBAN_LENGTHS = {country: int(n) for n, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for country in countries.split(",")}


def _readings(kind: str, found: str) -> list[str]:
    """What may be the value: an IBAN's match can hold words that follow it."""
    if kind != "iban":
        return [found]
    whole_words = [found[:m.end()] for m in re.finditer("[A-Z0-9]+", found)][::-1]
    length = _IBAN_LENGTHS.get(found[:2])
    if length is None:
        return whole_words
    return [r for r in whole_words[1:] if len(r.replace(" ", "")) == length] + whole_words[:1]


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _iban(f: Feistel, found: str) -> str | None:
    code = found.replace(" ", "")
    if not 15 <= len(code) <= 34 or _iban_rest(code) != 1:
        return None
    body = _mixed(f, code[4:], "iban" + code[:2])
    check = 98 - _iban_rest(code[:2] + "00" + body)
    return _refill(found, f"{code[:2]}{check:02d}{body}", str.isalnum)


def _ip(f: Feistel, found: str) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None

    def scope(x: int) -> int:
        a, b = x >> 24, x >> 16 & 255
        if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
            return 1
        return 2 if a in (0, 127) or a >= 224 else 0

    x = int.from_bytes(bytes(octets), "big")
    y = f.permute(x, 1 << 32, "ip", lambda y: scope(y) == scope(x))
    return ".".join(map(str, y.to_bytes(4, "big")))


def _ssn(f: Feistel, found: str) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(found.replace("-", ""))
    return _refill(found, str(f.permute(x, 10 ** 9, "ssn", valid)).zfill(9)) if valid(x) else None


_DAY_FORMATS = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _date(f: Feistel, found: str) -> str | None:
    form = _DAY_FORMATS[next(c for c in found if not c.isdigit())]
    for shape in (form, form.replace("%d/%m", "%m/%d")):
        try:
            day = dt.datetime.strptime(found, shape).date().toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        moved = _FIRST_DAY + f.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date")
        return dt.date.fromordinal(moved).strftime(shape)
    return None


def _phone(f: Feistel, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not found.startswith("+") or digits[0] == "1" and len(digits) == 11:  # the North American plan
        def assigned(x: int) -> bool:
            return x // 10 ** 9 >= 2 and x // 10 ** 6 % 10 >= 2

        x = int(digits[-10:])
        y = f.permute(x, 10 ** 10, "phone", lambda y: assigned(y) == assigned(x))
        return _refill(found, digits[:-10] + str(y).zfill(10))
    if not 8 <= len(digits) <= 15:
        return None
    n = len(digits) - 2  # the country's first digits stay
    return _refill(found, digits[:2] + str(f.permute(int(digits[2:]), 10 ** n, "phone" + digits[:2])).zfill(n))


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mixed(f: Feistel, text: str, tweak: str) -> str:
    """Letters and digits permuted together, each staying in its class; other characters stay."""
    classes = [next((a for a in _ALPHABETS if c in a), c) for c in text]
    size, x = 1, 0
    for c, a in zip(text, classes):
        if len(a) > 1:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join("-" if len(a) < 2 else str(_ALPHABETS.index(a)) for a in classes)
    if size < 2:
        return text
    x = f.permute(x, size, f"{tweak}:{shape}")
    out = []
    for a in reversed(classes):
        if len(a) > 1:
            x, i = divmod(x, len(a))
            out.append(a[i])
        else:
            out.append(a)
    return "".join(reversed(out))


def _email(f: Feistel, found: str) -> str:
    """The local part and the host's first names; the last two names of the host stay."""
    head, *tail = found.rsplit(".", 2)
    if "@" not in head or len(tail) < 2:
        head, host = found.split("@")
        return f"{_mixed(f, head, 'email')}@{host}"
    return ".".join([_mixed(f, head, "email"), *tail])


_CHANGE: dict[str, Callable[[Feistel, str], str | None]] = {
    "email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone}


def pseudonyms(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """(the text with its valid values replaced, how many of each kind)."""
    if not _HINT.search(text):
        return text, {}
    counts: dict[str, int] = {}
    out, at, search = [], 0, 0
    first = _FIRST["@" in text]
    while m := first.search(text, search):
        search = m.start() + 1
        # What is not valid as the first kind that matches here may be valid as a later one.
        for kind in KINDS[KINDS.index(m.lastgroup):]:
            found = _EACH[kind].match(text, m.start())
            new = None
            for value in _readings(kind, found[0]) if found else []:
                new = _CHANGE[kind](f, value)
                if new is not None:
                    break
            if new is not None:
                out += [text[at:m.start()], new]
                at = search = m.start() + len(value)
                counts[kind] = counts.get(kind, 0) + 1
                break
    return "".join([*out, text[at:]]), counts


def pseudonymize(docs: DataFrame, key: bytes, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``counts``, columns ``n_email`` and so on follow."""
    place = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if counts:
        schema += "".join(f", n_{kind} long" for kind in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [(None, {}) if t is None else pseudonyms(t, f) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            names = list(batch.schema.names)
            if counts:
                columns += [pa.array([n.get(kind, 0) for _, n in done], pa.int64()) for kind in KINDS]
                names += [f"n_{kind}" for kind in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs, run, schema)
