"""Format-preserving pseudonyms by a keyed Feistel permutation.

Validated values are found in the whole text and replaced by others of the same format that are valid too: card
numbers (Luhn), phone numbers, IPv4 and IPv6 addresses, social security numbers, IBANs (mod 97), calendar dates, the
local part of e-mail addresses, and secrets (access keys, passwords, tokens).

Phone numbers are a country code (the longest-known prefix rule of the numbering plan) and national digits, whatever
the layout: '+49 30 1234567', '+49301234567' and '+49 (0)30 1234567' have one pseudonym, and so have '+1 (212)
555-0123', '1-212-555-0123' and '212-555-0123'. North American numbers that the plan rules out, such as '+1 (017)
555-7713', are replaced by others that it rules out; digits behind a number are not part of it. Dates have the year in
front or behind, one or two digits for day and month, or the month as a word (English, German, French, Spanish), and
may have a time behind them (which stays); slash dates are month/day and others day-month, or the other way where only
that is a day. Dates with the year in two digits are left, and so are national numbers of other plans without a
country code. What follows 'password:' and the like is a secret if it is no plain word; behind '=' anything is.

A value is read as a number x below the N of its format. P is a keyed balanced Feistel network over the next even
number of bits, walked until it falls below N; the pseudonym is the value of P^-1(P(x) + 1 mod N), taken again while
that is of another format. That is a permutation without fixed points, so equal values stay equal in all documents,
different ones stay different, nothing stays as it was, and the key gives values back.

Defined results: null text stays null, text without values stays as it is; values that overlap are taken from left
to right, the longer first; texts of any length are read whole; rows are treated one by one, so ties and repeats do
not matter; an empty table stays empty; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices
from .tokenizing import forget_encoders

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Permuter:
    """Keyed permutations of the integers below n, one for each kind and n."""

    def __init__(self, key: bytes):
        self.key, self.seen = hashlib.blake2b(key, digest_size=32).digest(), {}

    def _round(self, tag: bytes, i: int, value: int, bits: int) -> int:
        size = -(-bits // 8)
        out, block = b"", 0
        data = value.to_bytes(size, "big")
        while len(out) < size:
            out += hashlib.blake2b(tag + bytes([i, block]) + data, key=self.key).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, kind: str, n: int, x: int, back: bool) -> int:
        half = max(1, -(-(n - 1).bit_length() // 2))
        mask, tag = (1 << half) - 1, f"{kind}:{n}:".encode()
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(tag, i, a, half), a
                else:
                    a, b = b, a ^ self._round(tag, i, b, half)
            x = a << half | b
            if x < n:
                return x

    def shift(self, kind: str, n: int, x: int, by: int = 1) -> int:
        """The pseudonym of x (by = 1), or the value that has the pseudonym x (by = -1)."""
        if n < 2:
            return x
        return self._walk(kind, n, (self._walk(kind, n, x, False) + by) % n, True)


def luhn(digits: str) -> int:
    """Check digit behind these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def refill(shape: str, symbols: str, is_slot: Callable[[str], bool]) -> str:
    """Puts symbols into the slots of a text, keeping what stands between them."""
    it = iter(symbols)
    return "".join(next(it) if is_slot(c) else c for c in shape)


HEX = {"0123456789abcdef", "0123456789ABCDEF"}


def _hex(s: str) -> str | None:
    """The digits of a hex number with letters and digits, in one case."""
    return next((h for h in HEX if len(s) >= 8 and set(s) <= set(h) and set(s) & set(h[:10]) and set(s) & set(h[10:])), None)


def _by_class(p: Permuter, kind: str, s: str, by: int, hexes: bool = False) -> str:
    """Permutes the ASCII letters and digits of s, each within its class; with hexes, a hex number stays one."""
    digits = _hex(s) if hexes else None
    sets = {c: digits or ("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in s if c.isascii() and c.isalnum()}
    x, n = 0, 1
    for c in s:
        if c in sets:
            x, n = x * len(sets[c]) + sets[c].index(c), n * len(sets[c])
    # the classes are part of the format
    tag = kind + ":" + "".join("h" if digits else "d" if c.isdigit() else "l" if c.islower() else "u" for c in s if c in sets)
    while True:
        x, out = p.shift(tag, n, x, by), []
        left = x
        for c in reversed(s):
            if c in sets:
                left, d = divmod(left, len(sets[c]))
                out.append(sets[c][d])
            else:
                out.append(c)
        new = "".join(reversed(out))
        if not hexes or _hex(new) == digits:  # else the next value that is read as one of the same kind
            return new


def card(p: Permuter, m: re.Match, by: int) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or set(digits) == {"0"}:
        return None
    n = len(digits) - 1
    new = f"{p.shift('card', 10**n, int(digits[:-1]), by):0{n}d}"
    return refill(m[0], new + str(luhn(new)), str.isdigit)


# Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def _national(text: str) -> tuple[int, str, list[int], bool] | None:
    """Of a phone match: the length of its front that is the number, its country code, the places of its national digits,
    and whether it is a valid number of North America. A match takes digit groups behind the number in; it is cut at
    spaces: at ten national digits in North America, else at twelve at most."""
    places = [i for i, c in enumerate(text) if c.isdigit()]
    if text[0] == "+":
        digits = "".join(text[i] for i in places[:3])
        code = next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits)
        if digits[0] == "0" or not text[1 : len(code) + 1].isdigit():
            return None
        places = places[len(code) :]
        trunk = text.find("(0)")
        places = [i for i in places if i != trunk + 1] if trunk >= 0 else places
    else:
        code, places = "1", places[-10:]
    fronts = [(n, sum(i < n for i in places)) for n in [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] == " ")]]
    fit = code == "1" and [n for n, k in fronts if k == 10] or [n for n, k in fronts if 6 <= k <= 12]
    if not fit:
        return None
    places = [i for i in places if i < fit[0]]
    return fit[0], code, places, code == "1" and len(places) == 10 and text[places[0]] not in "01" and text[places[3]] not in "01"


def phone(p: Permuter, m: re.Match, by: int) -> str | None:
    """The pseudonym of the front of the match, as long as that front. Numbers that North America's plan rules out, and
    those of other lengths and countries, are permuted among their own kind over all national digits."""
    if (read := _national(m[0])) is None:
        return None
    end, code, places, valid = read
    digits = "".join(m[0][i] for i in places)
    x, n = int(digits), len(digits)
    while True:
        if valid:
            x = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
            x = p.shift("phone", 800 * 800 * 10_000, x, by)
            digits = f"{x // 8_000_000 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}"
        else:
            x = p.shift("phone" + code, 10**n, x, by)
            digits = f"{x:0{n}d}"
            if code == "1" and n == 10 and digits[0] not in "01" and digits[3] not in "01" or code != "1" and (digits[0] == "0") != (m[0][places[0]] == "0"):
                continue  # the next value that is one of the same kind
        new = list(m[0][:end])
        for i, d in zip(places, digits, strict=True):
            new[i] = d
        return "".join(new)


def ipv4(p: Permuter, m: re.Match, by: int) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    x = p.shift("ipv4", 2**32, int.from_bytes(bytes(map(int, parts)), "big"), by)
    return ".".join(map(str, x.to_bytes(4, "big")))


def ipv6(p: Permuter, m: re.Match, by: int) -> str | None:
    """Permutes the digits of the written groups; zeros in front, groups of a zero and '::' stay. What holds no decimal digit is read as a name like a::b."""
    try:
        IPv6Address(m[0])
    except AddressValueError:
        return None
    if not re.search(r"\d", m[0]) or m[0] != m[0].lower() and m[0] != m[0].upper():
        return None
    digits = "0123456789ABCDEF" if m[0] != m[0].lower() else "0123456789abcdef"
    places = []  # and whether a digit is the first of its group, which is no zero
    for g in re.finditer(r"[0-9A-Fa-f]+", m[0]):
        lead = len(g[0]) - len(g[0].lstrip("0"))
        places += [(g.start() + i, int(i == lead)) for i in range(lead, len(g[0]))]
    x, n = 0, 1
    for i, first in places:
        x, n = x * (16 - first) + digits.index(m[0][i]) - first, n * (16 - first)
    if n < 2:
        return None
    used = {i for i, _ in places}
    tag = "ipv6" + "".join("x" if i in used else c for i, c in enumerate(m[0]))
    while True:
        x = p.shift(tag, n, x, by)
        left, new = x, list(m[0])
        for i, first in reversed(places):
            left, d = divmod(left, 16 - first)
            new[i] = digits[d + first]
        out = "".join(new)
        if (out != out.lower()) == (m[0] != m[0].lower()):  # letters show the case
            return out


def ssn(p: Permuter, m: re.Match, by: int) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    x = p.shift("ssn", 898 * 99 * 9999, (rank * 99 + group - 1) * 9999 + serial - 1, by)
    area = x // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _valid_iban(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban(p: Permuter, m: re.Match, by: int) -> str | None:
    """The longest front of the match that is valid, ending at a space or the end: words may stand behind it."""
    for end in [len(m[0]), *(i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]:
        s = m[0][:end].replace(" ", "")
        if _valid_iban(s):
            new = _by_class(p, "iban" + s[:2], s[4:], by)
            check = 98 - int("".join(str(int(c, 36)) for c in new + s[:2] + "00")) % 97
            return refill(m[0][:end], f"{s[:2]}{check:02d}{new}", lambda c: c != " ")
    return None


def _day(m: re.Match) -> tuple[datetime.date, bool, tuple] | None:
    """The day of a date, whether the month stands before the day, and the widths of both. Slash dates are month/day,
    others day-month; where that is no day, the other order holds."""
    iso = m["y1"] is not None
    y, a, b = (m["y1"], m["m1"], m["d1"]) if iso else (m["y2"], m["d2"], m["m2"])
    first = iso or m["sep2"] == "/"
    # one digit beside '07' or '11' is another format than one beside any two digits
    widths = (2, 2) if len(a) == len(b) == 2 else ((len(a), a[0] == "0"), (len(b), b[0] == "0"))
    for month_first in [first] if iso else [first, not first]:
        try:
            day = datetime.date(int(y), *map(int, (a, b) if month_first else (b, a)))
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            return day, month_first, widths
    return None


def date(p: Permuter, m: re.Match, by: int) -> str | None:
    if (read := _day(m)) is None:
        return None
    day, month_first, widths = read
    iso, sep = m["y1"] is not None, m["sep1"] or m["sep2"]
    a, b = (m["m1"], m["d1"]) if iso else (m["d2"], m["m2"])
    while True:  # the next day that is written and read in the same format
        x = p.shift("date", (LAST_DAY - FIRST_DAY).days + 1, (day - FIRST_DAY).days, by)
        day = FIRST_DAY + datetime.timedelta(days=x)
        one, two = (day.month, day.day) if month_first else (day.day, day.month)
        parts = [f"{one:0{len(a)}d}", f"{two:0{len(b)}d}"]
        new = sep.join([f"{day.year:04d}", *parts] if iso else [*parts, f"{day.year:04d}"])
        if (again := DATE.fullmatch(new)) and _day(again) == (day, month_first, widths):
            return new


# Names of the months, and their short forms in English.
MONTHS = [
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
NAMES = "|".join(sorted({n for names in MONTHS for n in names}, key=lambda n: (-len(n), n)))
CASES = (str.lower, str.upper, str.title)
WRITTEN = re.compile(rf"(?i)(?<![\w./-])(?:(?P<d1>\d{{1,2}})(?P<o1>st|nd|rd|th|\.)?(?P<a1> (?:de |of )?)(?P<m1>{NAMES})(?P<b1>,? (?:de )?)(?P<y1>\d{{4}})|(?P<m2>{NAMES})(?P<a2> )(?P<d2>\d{{1,2}})(?P<o2>st|nd|rd|th)?(?P<b2>,? )(?P<y2>\d{{4}}))(?!\w)")


def _written(text: str) -> tuple[datetime.date, tuple] | None:
    """The day of a date with the month as a word, and its format."""
    if not (m := WRITTEN.fullmatch(text)):
        return None
    k = "1" if m["d1"] else "2"
    name = m["m" + k]
    for i, names in enumerate(MONTHS):
        for j, n in enumerate(names):
            for c, case in enumerate(CASES):
                if case(n) == name:
                    try:
                        day = datetime.date(int(m["y" + k]), j + 1, int(m["d" + k]))
                    except ValueError:
                        return None
                    ordinal = m["o" + k]
                    if ordinal and ordinal != "." and ordinal != _ordinal(day.day):
                        return None
                    return (day, (k, i, c, len(m["d" + k]), m["d" + k][0] == "0", ordinal and ordinal == ".", m["a" + k], m["b" + k], bool(ordinal))) if FIRST_DAY <= day <= LAST_DAY else None
    return None


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def written(p: Permuter, m: re.Match, by: int) -> str | None:
    if (read := _written(m[0])) is None:
        return None
    day, form = read
    k, language, case, width, _, dot, a, b, ordinal = form
    while True:  # the next day that is written and read in the same format
        day = FIRST_DAY + datetime.timedelta(days=p.shift("date", (LAST_DAY - FIRST_DAY).days + 1, (day - FIRST_DAY).days, by))
        name, number = CASES[case](MONTHS[language][day.month - 1]), f"{day.day:0{width}d}" + ("." if dot else _ordinal(day.day) if ordinal else "")
        new = f"{number}{a}{name}{b}{day.year:04d}" if k == "1" else f"{name}{a}{number}{b}{day.year:04d}"
        if _written(new) == (day, form):
            return new


def email(p: Permuter, m: re.Match, by: int) -> str | None:
    return _by_class(p, "email", m["local"], by) + m[0][len(m["local"]) :]


def _plain(value: str) -> bool:
    """Whether a value may be a word of prose: letters alone, of one case or with a capital in front."""
    return value.isalpha() and (value[1:].islower() or value.isupper())


def secret(p: Permuter, m: re.Match, by: int) -> str | None:
    value = m["value"]
    if m["sign"] == ":" and _plain(value):
        return None
    a = m.start("value") - m.start()
    while True:  # never a plain word
        value = _by_class(p, "secret", value, by, hexes=True)
        if m["sign"] == "=" or not _plain(value):
            return m[0][:a] + value + m[0][a + len(value) :]


def access_key(p: Permuter, m: re.Match, by: int) -> str | None:
    return m[0][:4] + _by_class(p, "key", m[0][4:], by)


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: An IPv4 address: no part of a phone number before it.
ADDRESS = rf"{OCTET}(?:\.{OCTET}){{3}}(?![\w-]|\.\d)"

#: A date, with a time behind it at most.
DATE = re.compile(r"(?<![\w./-])(?:(?P<y1>\d{4})(?P<sep1>[-/.])(?P<m1>\d{1,2})(?P=sep1)(?P<d1>\d{1,2})|(?P<d2>\d{1,2})(?P<sep2>[-/.])(?P<m2>\d{1,2})(?P=sep2)(?P<y2>\d{4}))(?=[Tt]\d{2}(?::?\d{2})?|(?![\w-]|[/.]\d))")

#: Kinds: pattern, and what gives the pseudonym of a match or None if it is no valid value.
KINDS: dict[str, tuple[re.Pattern, Callable]] = {
    "email": (re.compile(r"(?<![\w.+%-])(?P<local>[A-Za-z0-9_.+%-]*[A-Za-z0-9][A-Za-z0-9_.+%-]*)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    "secret": (re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s?(?P<sign>[=:])\s?[\"']?(?P<value>[A-Za-z0-9+/_.-]*[A-Za-z0-9][A-Za-z0-9+/_-]{5,})"), secret),
    "access_key": (re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), access_key),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), iban),
    "card": (re.compile(r"(?<![\w+-])(?<!\d\.)(?:\d{13,19}|\d{4}(?P<s1>[ -])\d{4}(?P=s1)\d{4}(?P=s1)\d{1,7}|\d{4}(?P<s2>[ -])\d{6}(?P=s2)\d{5})(?![\w-])"), card),
    "ssn": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), ssn),
    "phone": (re.compile(rf"(?<![\w+.-])(?:\+\d{{1,15}}(?:(?:(?: (?!{ADDRESS})|[./-])?\(\d{{1,5}}\)(?: (?!{ADDRESS})|[./-])?|(?: (?!{ADDRESS})|[./-]))\d{{1,12}}){{0,6}}|(?:1[ .-])?(?:\(\d{{3}}\) ?|\d{{3}}(?P<s>[ .-]))\d{{3}}[ .-]\d{{4}})(?![\w-])"), phone),
    "ipv4": (re.compile(r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)"), ipv4),
    "ipv6": (re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?=:)|:(?=:))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)"), ipv6),
    "date": (DATE, date),
    "written": (WRITTEN, written),
}
#: Kinds of which a match may hold more than the value; a pseudonym is as long as the value it stands for.
FRONTS = {"phone", "iban"}
#: What any value holds: a digit, an at sign, or what stands before a secret.
HINT = re.compile(r"[0-9@=:]")


def find(p: Permuter, text: str, by: int = 1) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values of a text, from left to right, without overlaps."""
    if not HINT.search(text):
        return []
    found = []
    for order, (kind, (pattern, f)) in enumerate(KINDS.items()):
        at = 0
        while m := pattern.search(text, at):
            new = f(p, m, by)
            if new is None:
                # values may start inside of what was none
                at = m.start() + 1 if kind in FRONTS else m.end()
                continue
            at = m.start() + len(new) if kind in FRONTS else m.end()
            found.append((m.start(), -at, order, "date" if kind == "written" else kind, new))
    out, at = [], 0
    for a, b, _, kind, new in sorted(found):
        if a >= at:
            out.append((a, -b, kind, new))
            at = -b
    return out


def replace(p: Permuter, text: str, by: int = 1) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds replaced."""
    found = find(p, text, by)
    if not found:
        return text, []
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), [k for _, _, k, _ in found]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text column; with kinds_col, a further array column of the kinds replaced."""
    names = docs.columns
    out_kinds = fresh(names, kinds_col or "kinds_replaced")
    place = next(i for i, n in enumerate(names) if n.lower() == text_col.lower())

    def run(batches):
        forget_encoders()
        p = Permuter(key)
        for b, _ in slices(batches, place):
            new, kinds = [], []
            for t in b.column(place).to_pylist():
                x, k = (None, []) if t is None else replace(p, t)
                new.append(x)
                kinds.append(k)
            columns = list(b.columns)
            columns[place] = pa.array(new, pa.string())
            if kinds_col:
                columns.append(pa.array(kinds, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, out_kinds] if kinds_col else names)

    typed = docs.withColumn(names[place], F.col(f"`{names[place]}`").cast("string"))
    schema = typed.schema
    if kinds_col:
        schema = typed.withColumn(out_kinds, F.array().cast("array<string>")).schema
    return typed.mapInArrow(run, schema)
