"""Personal data: keyed surrogates that keep type, format, gender and script.

Patterns with checksums and context find mail, network and street addresses,
phone, card, account and social security numbers, access keys, secrets, days of
birth and names after titles. Every entity has a canonical form (digits of a
number, lower case of an address or name), and its surrogate is a function of
key, type and canonical form, so one entity has one surrogate wherever and
however it is written. All
distinct entities are then checked against each other: no two of a type share
a surrogate, and no surrogate is an entity of the texts. Losers draw again; the
draws beyond the first are all that the replacing pass has to be told.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm import textkernel as K
from strandmap.llm.common import free_name, lean, maybe_broadcast, ship, stored, text_slices

#: Entities with later draws, and their bytes, that are broadcast at most; draws of an entity at most before its format widens.
BROADCAST_DRAWS, BROADCAST_BYTES, DRAWS = 200_000, 32_000_000, 40
_SLICE = 4_000_000

# Titles that announce a name, by gender (m, f, or n for either).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f"}

# Words of street addresses, by the side of the name they stand on; words before a date of birth; months.
_AFTER_NAME = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Crescent"
_BEFORE_NAME = "rue|avenue|boulevard|place|chemin|allée|quai|Calle|Avenida|Plaza|Paseo|улица|ул|проспект|переулок"
_SMALL_WORDS = "de|du|des|la|le|les|del|los|las|d|l"
_BORN = r"born(?: on)?|date of birth|birth ?date|d\.?o\.?b\.?|né le|née le|date de naissance|geboren(?: am)?|geburtsdatum|nacid[oa] el|fecha de nacimiento|родил(?:ся|ась)|дата рождения"
MONTHS = [m.split() for m in (
    "January February March April May June July August September October November December",
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)]
_MONTH = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))
#: Days of birth that are replaced; another range of days would be another permutation.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2031, 12, 31)
# Openings of access keys of public services, with what follows.
_KEYS = r"sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
# Words that make a run of hexadecimal digits a digest of public content, not a secret.
_DIGEST = re.compile(r"(?i)(?:sha-?\d*|md5|digest|checksum|commit|revision|etag|hash)\W{0,4}$")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORDS = r"[A-ZÀ-ÞА-Я][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_STREET = rf"(?:{_BEFORE_NAME})\.? (?:(?:{_SMALL_WORDS})(?: |['’]))*{_WORDS}(?: {_WORDS}){{0,2}}"
_NUMBERS = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    rf"|(?P<apikey>(?<![\w-])(?:{_KEYS})(?![\w-]))"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?P<address>(?<![\w.,-])\d{{1,5}}[A-Za-z]? (?:{_WORDS} ){{1,3}}(?:{_AFTER_NAME})(?!\w)|(?<!\w)[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|allee|gasse|platz|weg) \d{{1,4}}[a-z]?(?!\w)|(?<![\w.,-])\d{{1,4}}(?: bis| ter)?,? {_STREET}(?!\w)|(?<!\w){_STREET},? \d{{1,4}}[A-Za-z]?(?!\w))"
    rf"|(?:(?<!\w)(?i:{_BORN})[ :,\t]{{1,3}}(?P<birthdate>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|\d{{1,2}}(?:st|nd|rd|th|\.|er)? (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{_MONTH}) \d{{1,2}},? \d{{4}})(?!\d))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![\w:]))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]))"
)
_TITLE = "|".join(TITLES)
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
_TITLED = re.compile(rf"(?<!\w)({_TITLE})(?!\w)")
# What may stand between a title or an initial and the next word, and between two words: no end of a paragraph, one line break at most.
_AFTER_TITLE, _AFTER_WORD = re.compile(r"\.\s*|\s+"), re.compile(r"[^\S\r\n]*(?:\r?\n)?[^\S\r\n]*")
# Words in lower case inside a name, which stay.
_PARTICLES = frozenset("van von der den de del della di da dos du la le ten ter zu zum zur bin ibn al el y".split())
_TITLE_BYTES = [t.encode() for t in TITLES]
_NAME_KINDS = ("given_m", "given_f", "given_n", "surname")
TYPES = ("email", "secret", "apikey", "iban", "address", "birthdate", "ip", "ip6", "phone", "ssn", "card", *_NAME_KINDS)


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in word) else "latin"


@lru_cache(maxsize=1)
def _lower_words(text: str) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(text) if w.islower())


def _run(text: str, at: int) -> tuple[str, list[tuple[int, int]], int]:
    """(gender or "", (begin, end) of the words, end) of the name behind a title that ends at ``at``.

    The name is a run of words with a capital, initials and particles between
    them. More titles may come first. A word that follows a word over a line
    break belongs to the name unless the text has it in lower case too.
    """
    gender, words, end, gap = "", [], at, _AFTER_TITLE.match(text, at)
    while gap:
        m = _WORD.match(text, gap.end())
        while m and m.group() in _PARTICLES:
            space = _AFTER_WORD.match(text, m.end())
            m = _WORD.match(text, space.end()) if space.end() > m.end() else None
        if not m or not any(c.isupper() for c in m.group()):
            break
        word, a, b = m.group(), m.start(), m.end()
        if word in TITLES:
            if words:
                break
            gender = gender or TITLES[word].replace("n", "")
            gap, end = _AFTER_TITLE.match(text, b), b
            continue
        if words and re.search(r"[\r\n]", text[end:a]) and len(word) > 1 and words[-1][1] - words[-1][0] > 1 and word.lower() in _lower_words(text):
            break
        if words and text[b : b + 1] == "@":
            break
        owner = len(word) > 3 and word[-2] in "'’" and word[-1] in "sS"
        b -= 2 * owner
        words.append((a, b))
        end = b
        if owner:
            break
        if b - a == 1 and text[b : b + 1] == ".":
            gap = _AFTER_TITLE.match(text, b)
        else:
            space = _AFTER_WORD.match(text, b)
            gap = space if space.end() > b else None
    return gender, words, end


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, and the same words in the rest of the text.

    A word has one gender in a text: that of its titles, if they agree or only
    some of them tell one; a word alone behind a title is a given name if it is
    one elsewhere in the text. So a person keeps one surrogate under all titles.
    """
    out, known, end = [], {}, 0
    found: list[tuple[int, int, bool]] = []
    givens, surnames = set(), set()
    genders: dict[str, set[str]] = {}
    for m in _TITLED.finditer(text):
        if m.start() < end:
            continue
        more, words, end = _run(text, m.end())
        gender = TITLES[m.group(1)]
        gender = more or "n" if gender == "n" else gender
        for i, (a, b) in enumerate(words):
            found.append((a, b, i == len(words) - 1))
            genders.setdefault(text[a:b].lower(), set()).add(gender)
        if len(words) > 1:
            givens |= {text[a:b].lower() for a, b in words[:-1]}
            surnames.add(text[words[-1][0] : words[-1][1]].lower())
    for a, b, last in found:
        word = text[a:b]
        told = genders[word.lower()] - {"n"}
        gender = told.copy().pop() if len(told) == 1 else "n"
        last = last and not (word.lower() in givens and word.lower() not in surnames)
        entity = ("surname" if last else f"given_{gender}", f"{gender if _script(word) == 'cyrillic' else 'n'}:{word.lower()}")
        out.append((a, b, *entity))
        if b - a > 1:
            for form in (word, word.upper(), word.title(), word.capitalize()):
                known.setdefault(form, entity)
    if known:
        titled = {a for a, *_ in out}
        for m in _WORD.finditer(text):
            at, word = m.start(), m.group()
            # The word itself, without its 's, or its parts.
            for part in (word, word[:-2]) if word[-2:-1] in ("'", "’") else (word,):
                if part in known:
                    spans = [(at, at + len(part), *known[part])]
                    break
            else:
                spans = [(at + p.start(), at + p.end(), *known[p.group()]) for p in _PART.finditer(word) if p.group() in known] if len(word) > 2 else []
            out += [e for e in spans if e[0] not in titled]
    return out


def _groups(value: str) -> list[tuple[int, str]]:
    """(place of eight, digits) of each group that an IPv6 address writes out."""
    head, gap, tail = value.partition("::")
    left, right = (part.split(":") if part else [] for part in (head, tail))
    return list(enumerate(left)) + [(8 - len(right) + i, g) for i, g in enumerate(right)] if gap else list(enumerate(left))


def iban_ok(value: str) -> bool:
    """Whether the check digits of an IBAN without spaces are right."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _date(value: str) -> tuple[dt.date, list[str]] | None:
    """A written date and the order of its parts (d, m, y, M for a month's name, - for other words); days come before months unless that is no date."""
    parts = re.findall(r"[^\W_]+", value)
    named = [i for i, p in enumerate(parts) if not p[0].isdigit() and p != "de"]
    numbers = [i for i, p in enumerate(parts) if p[0].isdigit()]
    year = next((i for i in numbers if len(re.match(r"\d+", parts[i]).group()) == 4), numbers[-1])
    rest = [i for i in numbers if i != year]
    if named:
        trials = [(rest[0], named[0], "M")]
    elif year == 0:
        trials = [(rest[1], rest[0], "m")]
    else:
        trials = [(rest[0], rest[1], "m"), (rest[1], rest[0], "m")]
    number = lambda i: int(re.match(r"\d+", parts[i]).group())
    for day, month, kind in trials:
        m = next(n.index(parts[month]) + 1 for n in MONTHS if parts[month] in n) if kind == "M" else number(month)
        y = number(year) + (1900 if number(year) < 100 else 0)
        try:
            found = dt.date(y, m, number(day))
        except ValueError:
            continue
        order = ["-"] * len(parts)
        order[day], order[month], order[year] = "d", kind, "y"
        return found, order
    return None


def _write_date(day: dt.date, written: str) -> str:
    """A date in the layout and language of another one."""
    order = iter(_date(written)[1])

    def part(m):
        old, what = m.group(), next(order)
        if what == "y":
            return str(day.year)[-2:] if len(old) == 2 else str(day.year)
        if what == "M":
            return next(n for n in MONTHS if old in n)[day.month - 1]
        if what == "-":
            return old
        digits, suffix = re.match(r"(\d+)(.*)", old).groups()
        value = day.day if what == "d" else day.month
        if suffix in ("st", "nd", "rd", "th"):
            suffix = "th" if value in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(value % 10, "th")
        return str(value).rjust(2, "0") + suffix if len(digits) == 2 else f"{value}{suffix}"

    return re.sub(r"[^\W_]+", part, written)


@lru_cache(maxsize=4)
def _days(key: bytes) -> np.ndarray:
    """A permutation of all days that the key draws, so that different days stay different."""
    seed = int.from_bytes(hmac.new(key, b"birthdate", hashlib.sha256).digest(), "big")
    return np.random.default_rng(seed).permutation((LAST_DAY - FIRST_DAY).days + 1)


# Letters that initials may be, by script.
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


@lru_cache(maxsize=16)
def _initials(key: bytes, script: str) -> dict[str, str]:
    """A permutation of the letters that the key draws, without a letter that stays itself, so different initials stay different."""
    letters = _LETTERS[script]
    seed = int.from_bytes(hmac.new(key, f"initials|{script}".encode(), hashlib.sha256).digest(), "big")
    ring = [letters[i] for i in np.random.default_rng(seed).permutation(len(letters)).tolist()]
    return dict(zip(ring, ring[1:] + ring[:1], strict=True))


def _canonical(kind: str, value: str, text: str, at: int) -> str | None:
    """What all ways to write an entity have in common; None if a check tells that it is none."""
    if kind == "email":
        return value.lower()
    if kind == "secret":
        return None if _DIGEST.search(text, max(0, at - 20), at) else value.lower()
    if kind in ("apikey", "ip"):
        return value
    if kind == "iban":
        plain = value.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_ok(plain) else None
    if kind == "address":
        return " ".join(re.findall(r"[^\W_]+", value.lower()))
    if kind == "birthdate":
        day = _date(value)
        return day[0].isoformat() if day and FIRST_DAY <= day[0] <= LAST_DAY else None
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(value).exploded if any(c.isdigit() for c in value) else None
        except ValueError:
            return None
    if kind == "card" and len(value) != 16 and value.isdigit() and not luhn(value):
        return None  # neither the usual length nor a card's checksum: a time, the number of a book
    if kind == "phone" and value[0] == "+":
        country = re.match(r"\+\d+", value).group()
        return f"{country if len(country) <= 4 and len(country) < len(value) else '+'}|{re.sub(r'[^0-9]', '', value)}"
    return re.sub(r"[^0-9]", "", value)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical) of each entity of a text, in order, without overlaps."""
    out = []
    at = 0
    while m := _NUMBERS.search(text, at):
        kind = m.lastgroup
        canonical = _canonical(kind, m.group(kind), text, m.start())
        if canonical is not None:
            out.append((*m.span(kind), kind, canonical))
        at = m.start() + 1 if canonical is None else m.end()
    out += _names(text)
    # Of those that begin at one place the longest counts: an address may begin with a name.
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


class _Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.seed = hmac.new(key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.pool, self.turn = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest()
            self.turn += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, items):
        return items[self.below(len(items))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: _Stream, n: int) -> str:
    return "".join(s.pick("0123456789") for _ in range(n))


# Syllables and endings of made-up names.
_SYLLABLES = {"latin": ["ba", "be", "da", "do", "el", "fa", "ga", "hel", "ja", "ka", "ke", "la", "lo", "ma", "mi", "na", "no", "pe", "ra", "ro", "sa", "se", "ta", "ve"], "cyrillic": ["ба", "бе", "ва", "во", "га", "да", "до", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "па", "ра", "ро", "са", "се", "та", "ти", "фе"], "greek": ["βα", "γα", "δα", "δο", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νο", "πα", "ρα", "ρο", "σα", "σε", "τα", "τι", "φα", "χα", "λο"]}
_ENDINGS = {("latin", "m"): ["n", "s", "rt", "k"], ("latin", "f"): ["na", "la", "ria", "ta"], ("latin", "n"): ["n", "r", "l", "s"], ("cyrillic", "m"): ["н", "р", "с", "й"], ("cyrillic", "f"): ["на", "ла", "рия", "та"], ("cyrillic", "n"): ["н", "р", "л", "с"], ("greek", "m"): ["νος", "ρης", "κος", "λης"], ("greek", "f"): ["να", "λα", "ρια", "τα"], ("greek", "n"): ["ν", "ρ", "ξ", "ς"]}
_SURNAME_ENDINGS = {("latin", "n"): ["son", "berg", "well", "ton"], ("cyrillic", "m"): ["нов", "лев", "рин", "ский"], ("cyrillic", "f"): ["нова", "лева", "рина", "ская"], ("cyrillic", "n"): ["ко", "ук", "юк", "енко"], ("greek", "n"): ["ίδης", "άκης", "πουλος", "άτος"]}


# Words of an address that tell its kind, and stay.
_KEPT = frozenset(f"{_AFTER_NAME}|{_BEFORE_NAME}|{_SMALL_WORDS}|bis|ter".lower().split("|"))
_STEM = re.compile(r"(.+)(straße|strasse|str|allee|gasse|platz|weg)$")


def _made_up(s: _Stream, word: str, draw: int) -> str:
    """Another word or number of an address; the words that tell its kind stay."""
    if word in _KEPT:
        return word
    if word[0].isdigit():
        number = re.match(r"\d+", word).group()
        return s.pick("123456789") + _digits(s, len(number) - 1) + word[len(number) :]
    stem = _STEM.match(word)
    made = "".join(s.pick(_SYLLABLES[_script(word)]) for _ in range(2 + s.below(2) + (draw + 3) // 4))
    return made + (stem.group(2) if stem else "")


@lru_cache(maxsize=200_000)
def surrogate(key: bytes, kind: str, canonical: str, draw: int = 0) -> str:
    """The canonical form of the surrogate at a draw; draws from ``DRAWS`` on may be longer."""
    s = _Stream(key, kind, canonical, draw)
    wide = max(0, draw - DRAWS + 1)
    if kind == "email":
        head, _, tail = canonical.rpartition(".")
        letters = "abcdefghijklmnopqrstuvwxyz"
        return "".join(s.pick(letters) if c.isalpha() else s.pick("0123456789") if c.isdigit() else c for c in _digits(s, wide) + head) + "." + tail
    if kind == "secret":
        return "".join(s.pick("0123456789abcdef") for _ in range(len(canonical) + wide))
    if kind == "apikey":
        body = re.match(r"sk-|AKIA|gh._|xox.-|AIza|eyJ", canonical).end()
        return canonical[:body] + "".join(s.pick("0123456789") if c.isdigit() else s.pick("abcdefghijklmnopqrstuvwxyz") if c.islower() else s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c for c in canonical[body:]) + _digits(s, wide)
    if kind == "iban":
        body = "".join(s.pick("0123456789") if c.isdigit() else s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canonical[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2]) + "00") % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "address":
        return " ".join(_made_up(s, w, draw) for w in canonical.split(" "))
    if kind == "birthdate":
        return (FIRST_DAY + dt.timedelta(int(_days(key)[(dt.date.fromisoformat(canonical) - FIRST_DAY).days]))).isoformat()
    if kind == "ip6":
        groups = (g.lstrip("0") for g in canonical.split(":"))
        return ":".join((s.pick("123456789abcdef") + "".join(s.pick("0123456789abcdef") for _ in g[1:]) if g else "").rjust(4, "0") for g in groups)
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        octets = []
        for o in canonical.split("."):
            low, high = (0, 255) if wide else ranges[len(o)]
            octets.append(str(low + s.below(high - low + 1)))
        return ".".join(octets)
    if kind == "phone":
        country, bar, digits = canonical.rpartition("|")
        fixed = country[1:]
        return f"{country}{bar}{fixed}{_digits(s, len(digits) - len(fixed) + wide)}"
    if kind == "card":
        body = canonical[0] + _digits(s, len(canonical) - 2 + wide)
        checks = [body + d for d in "0123456789"]
        good = [c for c in checks if luhn(c) == luhn(canonical)]
        return s.pick(good)
    if kind == "ssn":
        return _digits(s, len(canonical) + wide)
    gender, _, word = canonical.partition(":")
    script = _script(word)
    if len(word) == 1:
        return f"{gender}:{_initials(key, script).get(word, word)}"
    if kind == "surname":
        endings = _SURNAME_ENDINGS[(script, gender)]
    else:
        endings = _ENDINGS[(script, kind[-1])]
    n = 2 + s.below(2) + (draw + 3) // 4
    return f"{gender}:" + "".join(s.pick(_SYLLABLES[script]) for _ in range(n)) + s.pick(endings)


def _as_written(new: str, old: str) -> str:
    return new.upper() if len(old) > 1 and old.isupper() else new[:1].upper() + new[1:] if old[0].isupper() else new


def render(kind: str, written: str, canonical: str) -> str:
    """A canonical surrogate in the layout and case of what it replaces."""
    if kind in ("email", "secret"):
        return canonical.upper() if written.upper() == written and written.lower() != written else canonical
    if kind in ("ip", "apikey"):
        return canonical
    if kind == "iban":
        letters = iter(canonical)
        return "".join(next(letters, "") if c != " " else c for c in written) + "".join(letters)
    if kind == "birthdate":
        return _write_date(dt.date.fromisoformat(canonical), written)
    if kind == "address":
        parts = iter(canonical.split(" "))
        return re.sub(r"[^\W_]+", lambda m: _as_written(next(parts), m.group()), written)
    if kind == "ip6":
        groups, told = canonical.split(":"), iter(_groups(written))
        new = re.sub(r"[0-9A-Fa-f]+", lambda m: groups[next(told)[0]][-len(m.group()) :], written)
        return new.upper() if written.upper() == written and written.lower() != written else new
    if kind in _NAME_KINDS:
        word = canonical.partition(":")[2]
        if len(written) == 1:  # an initial stays one
            return word.upper()
        return word.upper() if len(written) > 1 and written.isupper() else word.capitalize()
    digits = iter(canonical.rpartition("|")[2])
    out = "".join(next(digits, "0") if c.isdigit() else c for c in written)
    return out + "".join(digits)


_HAS_DIGIT_OR_AT = np.zeros(256, bool)
_HAS_DIGIT_OR_AT[48:58] = True
_HAS_DIGIT_OR_AT[ord("@")] = True
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
# What access keys without a digit begin with.
_KEY_BYTES = [b"sk-", b"AKIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"AIza", b"eyJ"]


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold an entity: a digit, an @, a title, what a key begins with, or 32 hexadecimal digits in a row.

    Every type but these has a digit in its pattern: ``find`` has nothing for other rows.
    """
    raw = data.tobytes()
    places = [np.flatnonzero(_HAS_DIGIT_OR_AT[data])]
    for word in (*_TITLE_BYTES, *_KEY_BYTES):
        at, found = raw.find(word), []
        while at >= 0:
            found.append(at)
            at = raw.find(word, at + 1)
        places.append(np.array(found, np.int64))
    # A run may go on over the end of a row; one of 32 within a row holds a multiple of 16 of the run.
    stops = np.concatenate([[-1], np.flatnonzero(~_IS_HEX[data]), [len(data)]])
    for i in np.flatnonzero(np.diff(stops) > 32).tolist():
        places.append(np.arange(stops[i] + 1, stops[i + 1], 16))
    return np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1)


def _suspect_texts(column):
    """(row, text) of the suspects of a column."""
    data, offsets = K.flat(column)
    for a, b in text_slices(np.diff(offsets), _SLICE):
        part = offsets[a : b + 1] - offsets[a]
        for row in _suspects(data[offsets[a] : offsets[b]], part).tolist():
            yield a + row, data[offsets[a + row] : offsets[a + row + 1]].tobytes().decode()


def _distinct_entities(batches):
    for batch in batches:
        seen = {(kind, canonical) for _, text in _suspect_texts(batch.column("text")) for _, _, kind, canonical in find(text)}
        if seen:
            kinds, values = zip(*sorted(seen), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["type", "canonical"])


def _draw(key: bytes):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("type", "canonical", "draw")]
            out = [surrogate(key, *row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["type", "canonical", "draw", "surrogate"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, canonical, draw, surrogate): distinct surrogates, none of which is an entity itself.

    entities: distinct (type, canonical). Of several with one surrogate the
    smallest stays and the others draw again. Days of birth and initials are too
    few to avoid each other's: they are permuted, so they stay distinct, but the
    surrogate of one may be another's.
    """
    schema = "type string, canonical string, draw int, surrogate string"
    # Initials are a letter behind their gender.
    _permuted = (F.col("type") == "birthdate") | (F.col("type").isin(*_NAME_KINDS) & (F.length(F.substring_index("canonical", ":", -1)) == 1))
    taken = entities.select("type", F.col("canonical").alias("surrogate"))
    new = stored(entities.select("type", "canonical", F.lit(0).alias("draw")).mapInArrow(lean(_draw(key)), schema), "surrogates")
    settled = None
    for _ in range(3 * DRAWS):
        # Only new draws are judged: among themselves, against entities, and against what is settled.
        drawn = maybe_broadcast(new.select("type", "surrogate").distinct(), BROADCAST_DRAWS)
        used = taken if settled is None else taken.unionByName(settled.select("type", "surrogate"))
        used = used.join(drawn, ["type", "surrogate"], "left_semi").distinct().withColumn("_used", F.lit(True))
        winners = new.groupBy("type", "surrogate").agg(F.min("canonical").alias("winner"))
        judged = new.join(winners, ["type", "surrogate"]).join(used, ["type", "surrogate"], "left")
        judged = stored(judged.select("type", "canonical", "draw", "surrogate", (~_permuted & ((F.col("canonical") != F.col("winner")) | F.col("_used").isNotNull())).alias("bad")), "judged")
        good = judged.where("not bad").drop("bad")
        settled = good if settled is None else settled.unionByName(good)
        bad = judged.where("bad").select("type", "canonical", (F.col("draw") + 1).alias("draw"))
        if bad.isEmpty():
            return settled
        new = stored(bad.mapInArrow(lean(_draw(key)), schema), "surrogates")
    raise ValueError("no distinct surrogates found")


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with entities of the text column replaced, and n_entities and entities (type, begin, end, in characters of the old text).

    Null texts stay null and have no entities; all other columns stay as they
    are, except those named n_entities or entities, which are replaced. Rows
    are kept, repeated ones and those with null ids too; an empty table gives
    no rows. Whole texts are searched. Draws beyond the first are broadcast up
    to ``BROADCAST_DRAWS`` entities of ``BROADCAST_BYTES`` bytes; past that they
    are joined to the documents' entities and travel with each row.
    """
    ship(docs.sparkSession)
    column = F.col(f"`{text}`").cast("string")
    found = docs.select(column.alias("text")).mapInArrow(lean(_distinct_entities), "type string, canonical string").distinct()
    entities = stored(found, "entities")
    later = assign(entities, key).where("draw > 0").select("type", "canonical", "draw")
    others = [c for c in docs.columns if c not in ("n_entities", "entities", text)]
    body, draws_of = free_name(docs, "_text"), free_name(docs, "_draws")
    rows = docs.select(*(F.col(f"`{c}`") for c in others), column.alias(body))
    shared = None
    held = later.agg(F.count("*").alias("n"), F.sum(F.octet_length("canonical") + 100).alias("bytes")).first()
    if held.n <= BROADCAST_DRAWS and (held.bytes or 0) <= BROADCAST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast({(r.type, r.canonical): r.draw for r in later.collect()})
        rows = rows.withColumn(draws_of, F.lit(None).cast("map<string,int>"))
    else:
        rows = _with_draws(rows, later, body, draws_of)
    schema = T.StructType([docs.schema[c] for c in others]).add(text, "string").add("n_entities", "integer").add("entities", T.ArrayType(T.StructType().add("type", "string").add("begin", "integer").add("end", "integer")))
    spans = pa.list_(pa.struct([("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        draws = shared.value if shared is not None else {}
        for batch in batches:
            texts = batch.column(len(others))
            counts, where = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            changed: dict[int, str] = {}
            for row, old in _suspect_texts(texts):
                own = dict(batch.column(len(others) + 1)[row].as_py() or ()) if shared is None else draws
                pieces, at = [], 0
                for a, b, kind, canonical in find(old):
                    draw = own.get((kind, canonical) if shared is not None else f"{kind} {canonical}", 0)
                    pieces += [old[at:a], render(kind, old[a:b], surrogate(key, kind, canonical, draw))]
                    at = b
                    where[row].append({"type": kind, "begin": a, "end": b})
                if at:
                    changed[row] = "".join(pieces) + old[at:]
                    counts[row] = len(where[row])
            if changed:
                new = texts.to_pylist()
                for row, value in changed.items():
                    new[row] = value
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), texts, pa.array(counts), pa.array(where, spans)], names=[*others, text, "n_entities", "entities"])

    out = rows.mapInArrow(lean(run), schema)
    return out.select(*[c for c in docs.columns if c not in ("n_entities", "entities")], "n_entities", "entities")


def _with_draws(rows: DataFrame, later: DataFrame, body: str, draws_of: str) -> DataFrame:
    """Add to each row the later draws of its own entities, joined by a hash of its text."""
    mark = free_name(rows, "_hash")

    def run(batches):
        for batch in batches:
            pairs = [(row, kind, canonical) for row, text in _suspect_texts(batch.column("text")) for kind, canonical in {e[2:] for e in find(text)}]
            if pairs:
                r, kinds, values = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("hash").take(pa.array(r)), pa.array(kinds), pa.array(values)], names=["hash", "type", "canonical"])

    rows = rows.withColumn(mark, F.sha2(F.col(body), 256))
    mine = rows.select(F.col(mark).alias("hash"), F.col(body).alias("text")).mapInArrow(lean(run), "hash string, type string, canonical string").distinct()
    mine = mine.join(later, ["type", "canonical"]).groupBy(F.col("hash").alias(mark)).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "type", "canonical"), "draw"))).alias(draws_of))
    return rows.join(mine, mark, "left").drop(mark)
