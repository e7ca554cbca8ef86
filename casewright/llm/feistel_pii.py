"""Personal data under format-preserving pseudonyms.

Numbers and dates that pass their own checks (Luhn, IBAN modulus, numbering plans,
octets, calendar) are mapped onto others of the same format by a keyed permutation: a
Feistel network over the integers of the format, walked on until the value is valid
again. Equal values become equal pseudonyms in every document and punctuation, and the
key turns them back. Signs, spaces and brackets stay where they are, and so does the width
of every part: a day of one digit becomes a day of one digit, and is linked to those alone.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm.common import table

#: Rounds of a network; an even number, so that the halves end where they began.
ROUNDS = 10
#: Name of the Spark setting with the secret key; without it a key for tests is used.
KEY_SETTING = "spark.casewright.pii.key"
TEST_KEY = "not a secret"
#: Characters on both sides of a value that are read with its pseudonym.
AROUND = 100
#: Characters of an IBAN by country.
IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Permutation:
    """Keyed permutations of 0 .. n - 1, one for each name and n."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, name: str, n: int, k: int, half: int) -> int:
        """As many bits as a half of ``n`` has, and more."""
        data = f"{name} {n:x} {k} {half:x}".encode()
        parts = (hashlib.blake2b(data, digest_size=32, key=self.key, salt=at.to_bytes(8, "big")).digest()
                 for at in range(n.bit_length() // 384 + 1))
        return int.from_bytes(b"".join(parts), "big")

    def _network(self, name: str, n: int, value: int, back: bool) -> int:
        """On pairs (left, right) with left < a, right < b, a * b >= n: rounds add to each in turn.
        A number from ``n`` on is walked over."""
        b = isqrt(n - 1) + 1
        a = -(-n // b)
        while True:
            left, right = divmod(value, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    right = (right + sign * self._round(name, n, k, left)) % b
                else:
                    left = (left + sign * self._round(name, n, k, right)) % a
            value = left * b + right
            if value < n:
                return value

    def of(self, name: str, n: int, value: int, valid: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """The pseudonym of ``value``: through the network, a secret distance on, and back through
        it, which maps no number onto itself; on along this cycle until it meets a number that
        is ``valid``. ``value`` must be such a number itself, so the walk ends there at last."""
        if n == 1:
            return value
        distance = 1 + self._round(name, n, ROUNDS, 0) % (n - 1)
        while True:
            place = self._network(name, n, value, False)
            value = self._network(name, n, (place + (-distance if back else distance)) % n, True)
            if valid(value):
                return value


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _put(digits: str, text: str) -> str:
    """``digits`` in the places that digits have in ``text``."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in text)


#: Whether a pseudonym may stand where the value stood.
Accept = Callable[[str], bool]


@dataclass(frozen=True)
class Kind:
    """``check`` tells whether a match is one; ``change`` is (match, permutation, back, accept) -> pseudonym;
    ``parts`` are the places in a match that are checked, in this order."""

    name: str
    pattern: re.Pattern
    check: Callable[[str], bool]
    change: Callable[[str, Permutation, bool, Accept], str]
    parts: Callable[[str], Iterable[tuple[int, int]]] = lambda text: [(0, len(text))]


_GROUP = re.compile("[0-9]+")


def _shorter(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a run of digit groups that could be a card, long ones and early ones first."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    yield from sorted(((a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:]), key=lambda s: (s[0] - s[1], s[0]))


def _card_ok(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def _card(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    body = _digits(text)[:-1]

    def put(v: int) -> str:
        new = body[0] + str(v).zfill(len(body) - 1)  # the first digit names the kind of card and stays
        return _put(new + str(luhn(new)), text)

    return put(p.of("card " + body[0], 10 ** (len(body) - 1), int(body[1:]), lambda v: (v > 0 or body[0] != "0") and accept(put(v)), back))


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_rest(plain) == 1


def _iban_parts(text: str) -> list[tuple[int, int]]:
    """Capitals and digits that follow may be none of the number: the groups that make up the country's
    size, then the whole match, then, of a country without a known size, all with fewer groups."""
    ends, own = [k for k, c in enumerate(text + " ") if c == " "], IBAN_SIZES.get(text[:2])
    fits = [e for e in ends if e - text.count(" ", 0, e) == own]
    return [(0, e) for e in [*fits, *(ends[::-1] if own is None else ends[-1:])]]


def _iban(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    """Letters and digits of the account keep their kind and place; the check digits follow."""
    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    shape = "".join("9" if c.isdigit() else "A" for c in account)
    value = n = 0
    for c, s in zip(account, shape, strict=True):
        base, digit = (10, int(c)) if s == "9" else (26, ord(c) - 65)
        value, n = value * base + digit, (n or 1) * base

    def put(v: int) -> str:
        new = []
        for s in reversed(shape):
            v, digit = divmod(v, 10 if s == "9" else 26)
            new.append(str(digit) if s == "9" else chr(65 + digit))
        account = "".join(reversed(new))
        new_plain = iter(f"{country}{98 - iban_rest(country + '00' + account):02d}{account}")
        return "".join(c if c == " " else next(new_plain) for c in text)

    return put(p.of(f"iban {country} {shape}", n, value, lambda v: accept(put(v)), back))


def _plan(national: str) -> bool:
    """North American numbering plan: area and exchange begin with 2 to 9."""
    return len(national) == 10 and national[0] > "1" and national[3] > "1"


def _abroad(text: str) -> str | None:
    """Digits behind the sign of a country, a plus or two zeros; None without a sign."""
    digits = _digits(text)
    return digits if text.startswith("+") else digits[2:] if text.startswith("00") else None


def _phone_ok(text: str) -> bool:
    """The sign of a country is enough; without it the number must follow the numbering plan."""
    abroad = _abroad(text)
    if abroad is None:
        return _plan(_digits(text))
    return len(abroad) == 11 if abroad.startswith("1") else 8 <= len(abroad) <= 15


def _phone_parts(text: str) -> Iterator[tuple[int, int]]:
    """The whole match, then without its last groups: digits that follow a number may be none of its own."""
    return ((0, m.end()) for m in reversed(list(re.finditer(r"[0-9]+\)?", text))))


def _phone(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    digits, abroad = _digits(text), _abroad(text)
    if abroad is not None and not abroad.startswith("1"):
        kept, rest = abroad[:2], abroad[2:]  # the country stays
        put = lambda v: _put(digits[:len(digits) - len(abroad)] + kept + str(v).zfill(len(rest)), text)
        return put(p.of(f"phone {kept}", 10 ** len(rest), int(rest), lambda v: accept(put(v)), back))
    # Numbers inside the numbering plan stay inside, others outside.
    inside = _plan(digits[-10:])
    put = lambda v: _put(digits[:-10] + str(v).zfill(10), text)
    return put(p.of("phone", 10 ** 10, int(digits[-10:]), lambda v: _plan(str(v).zfill(10)) == inside and accept(put(v)), back))


def _social_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _social(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    shown = lambda v: f"{v // 10 ** 6:03d}-{v // 10 ** 4 % 100:02d}-{v % 10 ** 4:04d}"
    return shown(p.of("social", 10 ** 9, int(_digits(text)), lambda v: _social_ok(shown(v)) and accept(shown(v)), back))


def _address_ok(text: str) -> bool:
    return all(int(part) < 256 and str(int(part)) == part for part in text.split("."))


def _address(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    shown = lambda v: ".".join(map(str, v.to_bytes(4, "big")))
    return shown(p.of("address", 2 ** 32, value, lambda v: accept(shown(v)), back))


def _long_address_ok(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text)


def _long_address(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    """Hexadecimal digits in their places. In capitals, a number has a letter that shows it."""
    digits = text.replace(":", "")
    capitals = digits != digits.lower()
    shown = lambda v: f"{v:0{len(digits)}x}"
    place = lambda new: iter(new.upper() if capitals else new)

    def put(new: str) -> str:
        rest = place(new)
        return "".join(c if c == ":" else next(rest) for c in text)

    valid = lambda v: _long_address_ok(put(shown(v))) and (not capitals or not shown(v).isdigit()) and accept(put(shown(v)))
    return put(shown(p.of(f"address {len(digits)}", 16 ** len(digits), int(digits, 16), valid, back)))


# Names of the months.
MONTHS = ("January February March April May June July August September October November December").split()
_SHORT = [name[:3] for name in MONTHS]
_NAMED = "|".join([*MONTHS, *_SHORT])
#: Years of two digits are those of the century that begins here.
CENTURY = 1950


@dataclass(frozen=True)
class DateForm:
    """How a date is written: the order of its parts, and which are short. A month of three
    letters is a short name, also May; a long name is never May."""

    order: str
    month: int  # digits, or 3 for a short and 4 for a long name
    day: int
    year: int

    def fits(self, when: date) -> bool:
        return ((self.month != 1 or when.month < 10) and (self.month != 4 or when.month != 5) and (self.day != 1 or when.day < 10)
                and (self.year != 2 or CENTURY <= when.year < CENTURY + 100))

    def written(self, when: date, like: list[str]) -> list[str]:
        parts = {"y": f"{when.year % 10 ** self.year:0{self.year}d}", "d": f"{when.day:0{self.day}d}", "m": f"{when.month:0{self.month % 4}d}"}
        if self.month > 2:
            name, old = (_SHORT if self.month == 3 else MONTHS)[when.month - 1], like[self.order.index("m")]
            parts["m"] = name.upper() if old.isupper() else name.lower() if old.islower() else name
        return [parts[c] for c in self.order]


_DATE_PARTS = re.compile("[0-9]+|[A-Za-z]+")


def _read_date(text: str) -> tuple[date, DateForm, list[str]] | None:
    """The day, its form, and its parts as written (without the ending of an ordinal)."""
    parts = _DATE_PARTS.findall(text)
    if parts[0].isalpha():
        order = "mdy"
    elif parts[1].isalpha():
        order = "dmy"
    elif len(parts[0]) == 4:
        order = "ymd"
    else:
        order = "mdy" if "/" in text else "dmy"
    named = dict(zip(order, parts, strict=True))
    month, short = named["m"], len(named["m"]) == 3
    number = (_SHORT if short else MONTHS).index(month.title()) + 1 if month.isalpha() else int(month)
    year = int(named["y"])
    if len(named["y"]) == 2:
        year += 1900 + 100 * (year < CENTURY - 1900)
    try:
        when = date(year, number, int(named["d"]))
    except ValueError:
        return None
    form = DateForm(order, (3 if short else 4) if month.isalpha() else len(month), len(named["d"]), len(named["y"]))
    return (when, form, parts) if FIRST_DAY <= when.toordinal() <= LAST_DAY and form.fits(when) else None


def _day(text: str) -> date | None:
    found = _read_date(text)
    return found and found[0]


def _date(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    when, form, parts = _read_date(text)
    of = lambda v: date.fromordinal(FIRST_DAY + v)

    def put(v: int) -> str:
        written = iter(form.written(of(v), parts))
        return _DATE_PARTS.sub(lambda _: next(written), text)

    return put(p.of("date", LAST_DAY - FIRST_DAY + 1, when.toordinal() - FIRST_DAY, lambda v: form.fits(of(v)) and accept(put(v)), back))


def _email(text: str, p: Permutation, back: bool, accept: Accept) -> str:
    """Letters and digits of the local part keep their kind; the host stays."""
    local, host = text.split("@")
    bases = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in local]
    value, n = 0, 1
    for c, base in zip(local, bases, strict=True):
        value, n = value * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0), n * base
    shape = "".join({10: "9", 26: "a"}.get(base, c) for c, base in zip(local, bases, strict=True))

    def put(v: int) -> str:
        out = []
        for c, base in zip(reversed(local), reversed(bases), strict=True):
            v, digit = divmod(v, base)
            out.append(str(digit) if base == 10 else chr((65 if c.isupper() else 97) + digit) if base == 26 else c)
        return "".join(reversed(out)) + "@" + host

    return put(p.of(f"email {shape} {host.lower()}", n, value, lambda v: accept(put(v)), back))


_D = r"(?<![0-9])"
_E = r"(?![0-9])"
KINDS = (
    Kind("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
         lambda t: True, _email),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban_ok, _iban, _iban_parts),
    Kind("card", re.compile(_D + r"[0-9](?:[ -]?[0-9]){12,18}" + _E), _card_ok, _card, _shorter),
    Kind("phone", re.compile(r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _E
                             + r"|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _E
                              + r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}" + _E
                             + r"|(?<![0-9+])00[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,5}\)?(?:[ .-]?\(?[0-9]{1,5}\)?){1,5}" + _E), _phone_ok, _phone, _phone_parts),
    Kind("social", re.compile(_D + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E), _social_ok, _social),
    Kind("address", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _address_ok, _address),
    Kind("address", re.compile(r"(?<![0-9A-Za-z:.])(?:::|(?:[0-9A-Fa-f]{1,4}:){1,7}:?)[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){0,7}(?![0-9A-Za-z:.]*[0-9A-Za-z:])"),
         _long_address_ok, _long_address),
    Kind("date", re.compile(_D + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})(?!/?[0-9])"
                            + r"|(?<![0-9./])(?:[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2})(?![./]?[0-9])"
                            + rf"|(?i:(?<![0-9A-Za-z])(?:(?:{_NAMED})\.? [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}}\.? (?:{_NAMED})\.?,? [0-9]{{4}}))" + _E),
         lambda t: _day(t) is not None, _date),
)
#: Names of kinds, each once.
NAMES = list(dict.fromkeys(kind.name for kind in KINDS))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all personal data, in order; kinds listed first win where matches overlap."""
    if not re.search("[0-9].?[0-9]|@|::", text):
        return []
    found: list[tuple[int, int, int]] = []
    other = bytearray(len(text))
    # Phones last: of their parts those come first that leave what other kinds have found.
    for number, kind in sorted(enumerate(KINDS), key=lambda k: k[1].name == "phone"):
        at = 0
        while m := kind.pattern.search(text, at):
            a = m.start()
            spans = ((a + i, a + j) for i, j in kind.parts(m.group()))
            if kind.name == "phone":
                spans = sorted(spans, key=lambda s: any(other[s[0]:s[1]]))
            span = next(((i, j) for i, j in spans if kind.check(text[i:j])), None)
            if span:
                found.append((*span, number))
                if kind.name != "phone":
                    other[span[0]:span[1]] = b"\1" * (span[1] - span[0])
            # A match that fails its check may hide one that begins a little later.
            at = span[1] if span else _next_group(text, a)
    found.sort(key=lambda f: (f[2], f[0]))
    kept: list[tuple[int, int, int]] = []
    taken = bytearray(len(text) + 1)
    for a, b, number in found:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            kept.append((a, b, number))
    return sorted(kept)


def _next_group(text: str, at: int) -> int:
    """Behind the first run of letters or digits from ``at`` on."""
    m = re.compile("[^A-Za-z0-9]*[A-Za-z0-9]*").match(text, at)
    return max(m.end(), at + 1)


def pseudonymize(text: str, permutation: Permutation, back: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with all personal data replaced, and where it stood.

    A pseudonym that would be read otherwise among the words around it (a telephone number
    whose digits are a card's, say) is passed over for the next one. For that the words
    before a value are those of the result and the words behind it are the given ones; the
    way back goes from the end, and so sees the same words.
    """
    spans = find(text)
    out: list[str] = []
    done = len(text) if back else 0  # so far text is taken over, from this end
    near = ""  # of the result, beside what is next
    for a, b, number in reversed(spans) if back else spans:
        between = text[b:done] if back else text[done:a]
        near = (between + near)[:AROUND] if back else (near + between)[-AROUND:]
        left, right = (text[max(0, a - AROUND):a], near) if back else (near, text[b:b + AROUND])
        seen = _reading(find(left + text[a:b] + right), len(left), b - a)

        def accept(new: str, left=left, right=right, seen=seen) -> bool:
            return _reading(find(left + new + right), len(left), len(new)) == seen

        new = KINDS[number].change(text[a:b], permutation, back, accept)
        out += [between, new]
        near, done = ((new + near)[:AROUND], a) if back else ((near + new)[-AROUND:], b)
    out.append(text[:done] if back else text[done:])
    return "".join(reversed(out) if back else out), spans


def _reading(found: list[tuple[int, int, int]], begin: int, size: int) -> list[tuple[int, int, int]]:
    """What was found, with places behind the value counted from its end."""
    end = begin + size
    place = lambda at: at if at <= begin else -1 if at == end else at - end if at > end else at - begin + 10 ** 6
    return [(place(a), place(b), k) for a, b, k in found]


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and n_<kind> counts, which take the place of
    columns of these names; all other columns stay.

    Null texts stay null and have counts of 0. A text without personal data stays as it is. Every row is handled by itself, and equal values agree because
    the permutation has no state, so nothing is shuffled.
    """
    counts = [f"n_{name}" for name in NAMES]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(key)
        for part in parts:
            texts, numbers = [], []
            for text in part["old"]:
                text = text.as_py()
                new, spans = (None, []) if text is None else pseudonymize(text, permutation)
                texts.append(new)
                numbers.append([sum(KINDS[s[2]].name == name for s in spans) for name in NAMES])
            columns = [pa.array([n[k] for n in numbers], pa.int64()) for k in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.string()), *columns], names=["row", "new", *counts])

    others = [c for c in docs.columns if c not in ("text", *counts)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").alias("old"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, new string, " + ", ".join(f"{c} long" for c in counts)
    return rows.mapInArrow(batches, schema).select(
        *(F.col("row")[c].alias(c) for c in others), F.col("new").alias("text"), *counts)


def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data, and how much of each kind there was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms(docs, spark.conf.get(KEY_SETTING, TEST_KEY))
