"""Personal data replaced by keyed surrogates of the same type and format.

An entity has a kind and a canonical value (digits of a number, lower-case address, ...), so
spellings of one entity share a surrogate wherever they stand: a phone number with its country code, run together or
without the code of North America is one, and a part of a name is one in all texts, whatever it stands behind.  Whether it is a
given or a family name, and the gender that titles tell, is settled by most of the texts that have it.  It is written in the original's format:
digits stay digits, case, script and separators stay, a Chinese family name becomes another one, the same for all who
bear it, a number that passed the Luhn or IBAN check passes it again.

Numbers and addresses of machines come from finite spaces, which a corpus may fill.  A keyed permutation
without fixed points of each space gives them surrogates that are distinct whatever stands in the corpus; such a
surrogate may be another entity's real value.  Names, e-mail addresses and secrets are drawn from
an HMAC of kind, value and attempt.  Spark looks for those that two entities share, or that are some
entity's real value; the later of them take their next attempt, which draws from a larger
space, so the rounds end; the last of LAST rounds draws from one so large that it needs no check.

Names are found behind titles and labels, before honorifics, next to an e-mail address that holds them,
wherever else in such a text their parts stand, and, without any of these, by what the corpus
taught: two capitalised words inside a sentence, the first of which at least LEARNED different texts
show as a given name.
"""
from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import BROADCAST_ROWS, cut, fresh, lean, saved, table

_TITLES = {
    "Mr": "m", "Mr.": "m", "Herr": "m", "Señor": "m", "Sr.": "m", "Monsieur": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra.": "f", "Madame": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
}
#: Titles that tell no gender; they also stand behind another title.
_NEUTRAL = ("Dr.", "Dr", "Prof.", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Mx.", "Mx", "Доктор", "Профессор", "Δρ.")
#: Titles as they are and in capitals.
_GENDER = {f: g for t, g in _TITLES.items() for f in (t, t.upper())}
_PLAIN_FORMS = tuple(dict.fromkeys(f for t in _NEUTRAL for f in (t, t.upper())))
#: Small words inside names.
_PARTICLES = frozenset("de del della di da do dos das du des la las los le van von der den dem ter ten zu zum bin binti ibn al el af av y e".split())
#: Words behind names in scripts without capitals, with the gender that they tell.
_HONORIFICS = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "教授": "n", "博士": "n", "醫師": "n", "医生": "n", "律師": "n", "律师": "n", "さん": "n", "様": "n", "氏": "n", "씨": "n", "님": "n", "선생님": "n"}
#: Chinese function words, which end up before a name when nothing else parts them.
_BEFORE = "的了和與与及見见到是在向對对由給给跟請请找問问叫"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PATTERN = re.compile(
    r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<card>(?<![\d.+-])(?:\d{4}[ -]){3}\d{1,7}(?![\d-])|(?<![\d.+-])\d{13,19}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])|(?<![\d.-])09\d{2}-\d{3}-\d{3}(?![\d-]))"
)
#: Country codes of one and two digits; all others have three.
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NORTH_AMERICAN = re.compile(r"1?[2-9]\d{2}[2-9]\d{6}")
_THREE_THREE_FOUR = re.compile(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}")
#: Family names, and characters of male and female given names, that stand for Chinese ones.
_HAN_FAMILY = "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾彭游詹胡施沈余盧梁趙顏柯翁魏孫戴范方宋鄧杜傅侯曹薛丁卓阮馬董溫唐藍石蔣古紀姚連馮歐程湯"
_HAN_GIVEN = {"m": "志明俊傑建宏家豪文雄國強偉哲宗翰承恩冠廷育誠", "f": "淑芬美玲雅婷怡君佳穎惠如麗華秀英詩涵欣思妤慧貞"}
_HAN = re.compile(r"[一-鿿]+")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_TEL = re.compile(r"(?i)(?<!\w)(?:telephone|telefono|teléfono|telefon|téléphone|phone|mobile|mobil|móvil|handy|cell|tel|tél|tfno|fax)(?: ?(?:no|nr|number))?\.?[:\s]{0,3}(\+?\(?\d[\d ()/.\-]{4,22}\d)(?!\d)")
_TEL_HINTS = ("el", "EL", "él", "ÉL", "hon", "HON", "obil", "OBIL", "óvil", "andy", "fax", "Fax", "FAX", "fno")
_LABEL = re.compile(r"(?i)\b(?:token|api[_-]?key|secret|password|passwd|pwd)\b[\"']?[\s|]*[=:][\s|]*(?:[\"']([0-9A-Za-z_\-+/.]{8,})[\"']|([0-9A-Za-z_\-+/.@!#$%^&*]{8,}))")
_WORDS = re.compile(r"(?i)token|api[_-]?key|secret|passw|pwd")
_ANY = "|".join(re.escape(t) for t in sorted([*_GENDER, *_PLAIN_FORMS], key=len, reverse=True))
_PLAIN = "|".join(re.escape(t) for t in sorted(_PLAIN_FORMS, key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)((?:{_ANY})(?: (?:{_PLAIN}))*)(?= )")
_FORM = re.compile(r"(?im)^\W{0,3}(?:full name|first name|last name|surname|name|author|contact|signed|signed by|from|attn|nombre|nom|auteur|kontakt|autor|имя|όνομα)[ \t]*[:：](?= )")
_FORM_HINTS = ("name", "Name", "NAME", "uthor", "ontact", "igned", "rom", "ttn", "om", "utor", "onta", "uteur", "имя", "Имя", "νομα")
_PART = re.compile(rf" (?:[^\W\d_]\.|({_NAME}))")
_CJK = r"぀-ヿ㐀-鿿"
_HONOURED = re.compile(rf"(?:([一-鿿]{{2,3}})(先生|女士|小姐|太太|教授|博士|醫師|医生|律師|律师)|([{_CJK}]{{1,4}}?)(さん|様|氏)|([가-힣]{{2,4}}?) ?(선생님|씨|님)(?![가-힣]{{2}}))")
_BARE_HINTS = tuple(_HONORIFICS)
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯΑ-Ω", "a-zß-öø-ÿа-яёά-ώ"
_CAPITALS = re.compile(rf"(?<=[{_LOW},;:<(] )([{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)?) ([{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)?)(?!\w)")
_HINTS = tuple({t.rstrip(".") for t in (*_GENDER, *_PLAIN_FORMS)})
_NUMBERS = re.compile(r"[\d@]")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters of a script by its first and last code point; those outside go to Latin.
_SCRIPTS = [(0x3B1, 0x3C1), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
_NAMES = ("given_m", "given_f", "given_n", "family")
#: Kinds whose surrogates a permutation of a finite space gives.
FINITE = ("ip", "ip6", "card", "ssn", "phone", "iban")
#: Consonants, vowels, and how male, female and other given names end.
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "o", "a", "e"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "н", "а", "е"), "greek": ("βγδζκλμνπρστ", "αειου", "ος", "α", "ι")}
#: Rounds in which colliding surrogates are drawn again, and texts that teach a given name.
LAST, LEARNED = 16, 2


# ------------------------------------------------------------ surrogates


def _draw(key: bytes, kind: str, value: str, attempt: int):
    """An endless stream of keyed numbers."""
    n = 0
    while True:
        block = hmac.new(key, f"{kind}\0{value}\0{attempt}\0{n}".encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(block[k : k + 4], "big") for k in range(0, 32, 4))
        n += 1


def _permuted(key: bytes, space: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network of 8 rounds, walked until it is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for k in reversed(range(8)) if back else range(8):
            if back:
                a, b = b ^ (int.from_bytes(hashlib.blake2b(b"%d" % k + a.to_bytes(n, "big"), key=key[:64], person=hashlib.blake2b(space.encode(), digest_size=16).digest()).digest()) & mask), a
            else:
                a, b = b, a ^ (int.from_bytes(hashlib.blake2b(b"%d" % k + b.to_bytes(n, "big"), key=key[:64], person=hashlib.blake2b(space.encode(), digest_size=16).digest()).digest()) & mask)
        x = a << half | b
        if x < size:
            return x


def other(key: bytes, space: str, x: int, size: int) -> int:
    """Another number below size: a permutation of the space without fixed points (size above 1)."""
    if size < 2:
        return x
    step = 1 + int.from_bytes(hmac.new(key, space.encode(), hashlib.sha256).digest()) % (size - 1)
    return _permuted(key, space, (_permuted(key, space, x, size) + step) % size, size, back=True)


def _mixed(key: bytes, space: str, digits: list[int], bases: list[int]) -> list[int]:
    """`other` for numbers of several bases."""
    x = size = 0
    size = 1
    for d, b in zip(digits, bases, strict=True):
        x, size = x * b + d, size * b
    y, out = other(key, space, x, size), []
    for b in reversed(bases):
        y, d = divmod(y, b)
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _like(c: str, r: int) -> str:
    """Another character of the same class, script and case."""
    if c.isdecimal():
        return chr(ord(c) - int(c) + r % 10)
    if not c.isalpha():
        return c
    low = c.lower()
    span = next(((a, b) for a, b in _SCRIPTS if len(low) == 1 and a <= ord(low) <= b), None)
    new = _LETTERS[r % 26] if span is None else chr(span[0] + r % (span[1] - span[0] + 1))
    return new.upper() if c != low else new


def _script(name: str) -> str:
    c = ord(name[0].lower())
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x500 else "latin"


def _finite(key: bytes, kind: str, value: str) -> str:
    """The image of a value in its space, which is told by what has to stay."""
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]

        def kept(p):
            return 1 if p[0] in (0, 10, 127) or p[0] >= 224 else 2 if p[:2] == [192, 168] or (p[0] == 172 and 16 <= p[1] < 32) else 0

        n = kept(parts)
        if n:
            return ".".join(map(str, parts[:n] + _mixed(key, f"ip {parts[:n]}", parts[n:], [256] * (4 - n))))
        while True:  # public addresses stay public
            parts = _mixed(key, "ip", parts, [256] * 4)
            if not kept(parts):
                return ".".join(map(str, parts))
    if kind == "ip6":
        x = int(ipaddress.IPv6Address(value))
        return str(ipaddress.IPv6Address(x >> 112 << 112 | other(key, f"ip6 {x >> 112}", x & (1 << 112) - 1, 1 << 112)))
    if kind == "card":
        off = _luhn_sum(value)  # 0 if it passes; kept
        body = "".join(map(str, _mixed(key, f"card {value[0]} {len(value)} {off}", [int(c) for c in value[1:-1]], [10] * (len(value) - 2))))
        new = value[0] + body
        return new + str((off - _luhn_sum(new + "0")) % 10)
    if kind == "phone":
        code, digits = value[1:].split(" ") if value[0] == "+" else ("", value)
        # What may start an area or an exchange stays apart from what may not, so no two numbers meet.
        bases = [(8 if digits[k] > "1" else 2) if len(digits) == 10 and k in (0, 3) else 10 for k in range(len(digits))]
        low = [2 * (b == 8) for b in bases]
        new = _mixed(key, f"phone {code} {bases}", [int(c) - a for c, a in zip(digits, low, strict=True)], bases)
        return (f"+{code} " if code else "") + "".join(str(d + a) for d, a in zip(new, low, strict=True))
    if kind == "iban":
        bases = [10 if c.isdecimal() else 26 for c in value[4:]]
        space = f"iban {value[:2]} {bases}"
        write = lambda ds: "".join(str(d) if b == 10 else chr(65 + d) for d, b in zip(ds, bases, strict=True))
        now = [int(c, 36) - 10 * (b == 26) for c, b in zip(value[4:], bases, strict=True)]
        if _mod97(value) == 1:
            body = write(_mixed(key, space, now, bases))
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02}{body}"
        return value[:4] + write(_mixed(key, f"{space} {value[2:4]}", now, bases))
    return "".join(map(str, _mixed(key, f"{kind} {len(value)}", [int(c) for c in value], [10] * len(value))))


def _space(kind: str) -> str:
    """Where surrogates have to be distinct: all names share one space."""
    return "name" if kind in _NAMES else kind


@lru_cache(1 << 14)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical value that stands for an entity."""
    if kind in FINITE:
        return _finite(key, kind, value)
    draw = _draw(key, _space(kind), value, attempt)
    if kind in _NAMES and _HAN.fullmatch(value):
        family = _draw(key, "family", value[:1], attempt if len(value) == 1 else 0)
        pool = _HAN_GIVEN.get(kind[-1], _HAN_GIVEN["m"] + _HAN_GIVEN["f"])
        return _HAN_FAMILY[next(family) % len(_HAN_FAMILY)] + "".join(pool[next(draw) % len(pool)] for _ in range(len(value) - 1 + attempt))
    if kind in _NAMES:
        if not all(ord(c) < 0x500 for c in value):
            return "".join(_like(c, next(draw)) for c in value + value[:1] * attempt)
        head, vowels, male, female, neutral = _SYLLABLES[_script(value)] if value else _SYLLABLES["latin"]
        # Longer names on later attempts: the room grows until every name is its own.
        n = 2 + (kind == "family") + attempt
        out = "".join(head[next(draw) % len(head)] + vowels[next(draw) % len(vowels)] for _ in range(n))
        return out[:-1] + {"given_m": male, "given_f": female, "given_n": neutral, "family": out[-1] + head[next(draw) % len(head)]}[kind]
    if kind == "secret":
        hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
        letters = "abcdef" if hexa else _LETTERS
        more = value + ("a" * 2 * attempt if attempt > 2 else "")
        return "".join(c if not c.isalnum() else (str(next(draw) % 10) if c.isdigit() else (letters[next(draw) % len(letters)].upper() if c.isupper() else letters[next(draw) % len(letters)])) for c in more)
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    kept = 2 if labels[-2] == "example" else 1
    new = [".".join("".join(_like(c, next(draw)) for c in x) for x in labels[:-kept]), *labels[-kept:]]
    return "".join(_like(c, next(draw)) for c in local + "a" * 2 * attempt) + "@" + ".".join(x for x in new if x)


# ------------------------------------------------------------ detection


def _free(spots: list[tuple[int, int, str, str]], a: int, b: int) -> bool:
    """Whether none of the spots, in order and apart, meets a .. b."""
    k = bisect_left(spots, (b,))
    return not k or spots[k - 1][1] <= a


def _phone(raw: str) -> str:
    """One form for the spellings of a number: "+", country code, space, the rest; only its digits where nothing tells the code."""
    digits = "".join(str(int(c)) for c in raw.replace("(0)", "") if c.isdecimal())
    if raw[0] == "+":
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _COUNTRIES), digits[:3])
        return f"+{code} {digits[len(code) :]}" if len(digits) > len(code) + 4 else digits
    return f"+1 {digits[-10:]}" if _THREE_THREE_FOUR.fullmatch(raw) or _NORTH_AMERICAN.fullmatch(digits) else digits


def _numbers(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in _PATTERN.finditer(text):
        kind, raw = m.lastgroup, m.group()
        a, b = m.span()
        digits = "".join(c for c in raw if c.isdecimal())
        if kind == "ip":
            if any(int(p) > 255 for p in raw.split(".")):
                continue
            raw = ".".join(str(int(p)) for p in raw.split("."))
        elif kind == "email":
            if raw[0] in ".%+-":
                a += len(raw) - len(raw.lstrip(".%+-"))
                raw = raw.lstrip(".%+-")
            if raw[0] == "@":
                continue
            raw = raw.lower()
        elif kind == "card":
            if not 13 <= len(digits) <= 19:
                continue
            raw = digits
        elif kind == "phone":
            if not 8 <= len(digits) <= 15:
                continue
            raw = _phone(raw)
        elif kind == "ssn":
            raw = digits
        elif kind == "iban":
            raw = raw.replace(" ", "")
            if not 15 <= len(raw) <= 34:
                continue
        out.append((a, b, kind, raw))
    return out


def found(text: str, taught: list[tuple[str, str]] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a text, in order, without overlap.

    taught: (kind, value) of names that other texts teach.
    """
    out = _numbers(text) if _NUMBERS.search(text) else []
    if "::" in text or text.count(":") > 6:
        for m in _IP6.finditer(text):
            try:
                address = ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            if address not in (ipaddress.IPv6Address(0), ipaddress.IPv6Address(1)) and any(c.isdigit() for c in m.group()) and _free(sorted(out), *m.span()):
                out.append((*m.span(), "ip6", str(address)))
    if any(h in text for h in _TEL_HINTS):
        out.sort()
        for m in _TEL.finditer(text):
            digits = "".join(c for c in m.group(1) if c.isdecimal())
            if 6 <= len(digits) <= 15 and _free(out, *m.span(1)):
                out = sorted([*out, (*m.span(1), "phone", _phone(m.group(1)))])
    # A sign that every labelled secret has is quicker to look for than the words.
    if ("=" in text or ":" in text) and _WORDS.search(text):
        for m in _LABEL.finditer(text):
            g = 1 if m.group(1) else 2
            value = m.group(g)
            if g == 2 and not (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
                continue
            value = value.rstrip(".") if g == 2 else value
            a, b = m.start(g), m.start(g) + len(value)
            if not any(x < b and a < y for x, y, _, _ in out):
                out.append((a, b, "secret", value))
    return sorted(out + _people(text, sorted(out), taught))


def _chain(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the capitalised words of the name that starts at the space `at`; small words may part them.

    From the third word on, a word that the text also has in lower case ends the name.
    """
    spans, small = [], 0
    while m := _PART.match(text, at):
        word, at = m.group(1), m.end()
        if word is None:  # an initial
            continue
        if word in _PARTICLES and small < 3:
            small += 1
            continue
        a, b = m.span(1)
        if not word[0].isupper() or len(spans) == 5 or word in _PLAIN_FORMS:
            break
        if len(spans) > 1 and re.search(rf"(?<!\w){re.escape(word.lower())}(?!\w)", text):
            break
        b -= 2 * (b - a > 3 and text[b - 2 : b] in ("'s", "’s"))
        spans.append((a, b))
        small = 0
        if b < at:
            break
    return spans


def _people(text: str, taken: list[tuple[int, int, str, str]], taught) -> list[tuple[int, int, str, str]]:
    """Names by their titles, labels, honorifics and addresses, and wherever else in the text they stand."""
    named: list[tuple[int, int, str, str]] = []

    def name(spans, kind):
        """The last word is the family's."""
        for k, (a, b) in enumerate(spans):
            if _free(taken, a, b):
                named.append((a, b, "family" if k + 1 == len(spans) else kind, text[a:b].lower()))

    if any(h in text for h in _HINTS):
        for m in _TITLED.finditer(text):
            kind = next((f"given_{_GENDER[t]}" for t in m.group(1).split(" ") if t in _GENDER), "given_n")
            name(_chain(text, m.end()), kind)
    if (":" in text or "：" in text) and any(h in text for h in _FORM_HINTS):
        for m in _FORM.finditer(text):
            spans = _chain(text, m.end())
            if len(spans) > 1:
                name(spans, "given_n")
    tokens = {t for _, _, k, v in taken if k == "email" for t in re.split(r"[^a-zà-ÿ]+", v.partition("@")[0]) if len(t) > 2}
    if tokens:
        for m in _CAPITALS.finditer(text):
            if {m.group(1).lower(), m.group(2).lower()} & tokens and not any(re.search(rf"(?<![\w.@]){re.escape(w.lower())}(?![\w.@])", text) for w in m.groups()):
                name([m.span(1), m.span(2)], "given_n")
    if any(h in text for h in _BARE_HINTS):
        for m in _HONOURED.finditer(text):
            k = m.lastindex - 1
            a, b = m.span(k)
            while b - a > 1 and text[a] in _BEFORE:
                a += 1
            if _free(taken, a, b):
                named.append((a, b, f"given_{_HONORIFICS[m.group(k + 1)]}", text[a:b]))
    if not named and not taught:
        return []
    # Titles and addresses may find a name twice; the first counts.
    apart: list[tuple[int, int, str, str]] = []
    for spot in named:
        if _free(apart, *spot[:2]):
            apart = sorted([*apart, spot])
    # A given name behind a neutral title is the one that stands behind a gendered title in the same text.
    known = {v: k for _, _, k, v in reversed(apart) if k in ("given_m", "given_f")}
    named = [(a, b, known.get(v, k) if k == "given_n" else k, v) for a, b, k, v in apart]
    kinds = {v: k for k, v in reversed(taught)} | {v: k for _, _, k, v in reversed(named) if len(v) > 1}
    cased = {f: v for v in kinds for f in (v.upper(), v[:1].upper() + v[1:]) if v.upper() != v and f not in _GENDER}
    cased |= {text[a:b]: v for a, b, _, v in named if v in kinds and v.upper() != v and text[a:b] not in _GENDER}
    plain = [v for v in kinds if v.upper() == v and len(v) > 1]
    taken = sorted([*taken, *named])
    for forms, edge in ((cased, r"(?<!\w)(?:{})(?!\w)"), ({v: v for v in plain}, "(?:{})")):
        if forms:
            bare = re.compile(edge.format("|".join(map(re.escape, sorted(forms, key=len, reverse=True)))))
            more = [(*m.span(), kinds[forms[m.group()]], forms[m.group()]) for m in bare.finditer(text) if _free(taken, *m.span())]
            named, taken = named + more, sorted(taken + more)
    return named


def unnamed(text: str) -> set[str]:
    """Pairs of capitalised words inside sentences, in lower case: names, if other texts teach so."""
    return {f"{a.lower()} {b.lower()}" for a, b in _CAPITALS.findall(text)}


def written(original: str, kind: str, new: str) -> str:
    """The surrogate in the original's format."""
    if kind == "phone":
        # A number without its country code takes the digits behind it; a trunk zero in brackets stays.
        parts = re.split(r"(\(0\))", original)
        n = sum(c.isdecimal() for x in parts if x != "(0)" for c in x)
        rest = iter([c for c in new if c.isdecimal()][-n:])
        return "".join(x if x == "(0)" else "".join(next(rest) if c.isdecimal() else c for c in x) for x in parts)
    if kind in ("card", "ssn", "iban"):
        rest = iter(new.replace("+", "").replace(" ", ""))
        return "".join(next(rest) if c.isalnum() else c for c in original)
    if kind == "email" or kind in _NAMES:
        return new.upper() if original.isupper() and original.lower() != original and len(original) > 1 else new if kind == "email" else new[:1].upper() + new[1:]
    return new


def rewrite(text: str, key: bytes, settled: dict[tuple[str, str], tuple[str, int]], taught: list[tuple[str, str]] = ()) -> tuple[str, int]:
    """The text with surrogates, and how many; settled[space, value] has the kind and attempt that the corpus tells, if others than these."""
    spots = found(text, taught)
    if not spots:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in spots:
        kind, attempt = settled.get((_space(kind), value), (kind, 0))
        out += [text[at:a], written(text[a:b], kind, surrogate(key, kind, value, attempt))]
        at = b
    return "".join([*out, text[at:]]), len(spots)


# ------------------------------------------------------------ over the corpus


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct (h, kind, value, taught): the entities of each text, by the text's hash.

    taught names are those that only other texts show to be names.  How many texts name a person is counted
    over all of them before the pairs of capitalised words meet it.
    """

    def run(batches):
        for batch in batches:
            rows = set()
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
                t = t.as_py() or ""
                rows |= {(h, k, v) for _, _, k, v in found(t)} | {(h, "pair", v) for v in unnamed(t)}
            cols = zip(*sorted(rows), strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["h", "kind", "value"])

    text = F.col("text").cast("string")
    seen = docs.where("text is not null").select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(lean(run), "h long, kind string, value string")
    seen = saved(seen.distinct(), "mentions")
    sure = seen.where("kind <> 'pair'")
    given = sure.where("kind like 'given%'").groupBy("value", "kind").agg(F.count("*").alias("n"))
    given = given.groupBy("value").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct("n", "kind")).alias("kind")).where(F.col("n") >= LEARNED)
    pairs = seen.where("kind = 'pair'").select("h", F.split("value", " ").alias("w"))
    taught = pairs.join(given.select(F.col("value").alias("first"), "kind"), F.col("w")[0] == F.col("first"))
    taught = taught.select("h", F.explode(F.array(F.struct("kind", F.col("first").alias("value")), F.struct(F.lit("family").alias("kind"), F.col("w")[1].alias("value")))).alias("x"))
    taught = taught.select("h", "x.kind", "x.value").join(sure, ["h", "kind", "value"], "left_anti").distinct()
    return saved(sure.withColumn("taught", F.lit(False)).unionByName(taught.withColumn("taught", F.lit(True))), "mentions")


_SPACE = f"case when kind in {_NAMES} then 'name' else kind end"


def settled(seen: DataFrame) -> DataFrame:
    """(space, value, kind, mixed) of the entities of `mentions`: for names the kind that most texts give them, and whether texts differ."""
    rows = seen.groupBy(F.expr(_SPACE).alias("space"), "value", "kind").agg(F.count("*").alias("n"))
    m, f, g, family = (F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in _NAMES)
    kind = F.when(F.col("space") != "name", F.min("kind")).when(family > m + f + g, "family").when(m + f == 0, "given_n").when(m >= f, "given_m").otherwise("given_f")
    return rows.groupBy("space", "value").agg(kind.alias("kind"), (F.count("*") > 1).alias("mixed"))


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(space, value, kind, attempt) of the entities(space, value, kind, mixed) whose first surrogate is taken or whose kind texts differ on."""

    def made(batches):
        for batch in batches:
            rows = batch.to_pylist()
            new = [surrogate(key, r["kind"], r["value"], r["attempt"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(new, pa.string())], [*columns, "made"])

    columns = ["space", "value", "kind", "mixed", "attempt"]
    schema = "space string, value string, kind string, mixed boolean, attempt int, made string"
    every = saved(entities.withColumn("attempt", F.lit(0)).select(*columns).mapInArrow(made, schema), "entities")
    real = every.where(~F.col("space").isin(*FINITE)).select("space", F.col("value").alias("made")).withColumn("real", F.lit(True))
    needed = (F.col("attempt") > 0) | F.col("mixed")
    for n in range(1, LAST + 1):
        # Few entities share a surrogate, so these groups are small; the settled ones come first.
        turn = F.row_number().over(Window.partitionBy("space", "made").orderBy("attempt", "value"))
        rows = every.withColumn("turn", turn).join(real, ["space", "made"], "left")
        rows = saved(rows.withColumn("taken", (F.col("turn") > 1) | F.col("real").isNotNull()).select(*columns, "made", "taken"), "entities")
        clash = rows.where("taken")
        if clash.isEmpty():
            return rows.where(needed).select("space", "value", "kind", "attempt")
        moved = clash.withColumn("attempt", F.lit(n)).select(*columns).mapInArrow(made, schema)
        every = rows.where("not taken").select(*columns, "made").unionByName(moved)
    # The last attempt draws 16 more syllables or 32 more letters: no check is needed.
    return every.where(needed).select("space", "value", "kind", "attempt")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with every column as it was, entities of `text` replaced, and n_entities added.

    Null texts stay null, empty ones and those without entities stay as they are; very long texts are
    read whole; rows that repeat come out as often, equal texts alike.  An empty table gives an
    empty one.  A column of docs named n_entities is replaced.  What a text has to know of others (later
    attempts, kinds of names that texts differ on, taught names) meets it by a join on its hash; that table is sent to all tasks if it is counted to
    be small.
    """
    seen = mentions(docs)
    later = saved(attempts(settled(seen), key).withColumnRenamed("kind", "best"), "later")
    tries = seen.withColumn("space", F.expr(_SPACE)).join(later, ["space", "value"], "left").where("taught or attempt is not null")
    entry = F.struct("space", "kind", "value", F.coalesce("best", "kind").alias("best"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "taught")
    mine = saved(tries.groupBy("h").agg(F.array_sort(F.collect_set(entry)).alias("names")), "names")
    names = [f.name for f in docs.schema.fields if f.name.lower() != "n_entities"]
    base = docs.select(*names)
    h, extra = fresh(docs, "h", "names")
    schema = StructType([*base.schema.fields, StructField("n_entities", IntegerType())])
    few = (mine.agg(F.sum(F.size("names"))).first()[0] or 0) <= BROADCAST_ROWS // 10
    mine = mine.select(F.col("h").alias(h), F.col("names").alias(extra))
    given = base.withColumn(h, F.xxhash64(F.col("text").cast("string"))).join(F.broadcast(mine) if few else mine, h, "left").select(*names, extra)
    place = names.index("text")

    def run(batches):
        for batch in cut(batches):
            own = batch.column(len(names)).to_pylist()
            texts, counts = [], []
            for t, more in zip(batch.column(place), own, strict=True):
                t, more = t.as_py(), more or []
                tries = {(x["space"], x["value"]): (x["best"], x["attempt"]) for x in more}
                got, n = rewrite(t, key, tries, [(x["kind"], x["value"]) for x in more if x["taught"]]) if t else (t, 0)
                texts.append(got)
                counts.append(n)
            cols = [batch.column(k) for k in range(len(names))]
            cols[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(counts, np.int32))], [*names, "n_entities"])

    return given.mapInArrow(lean(run), schema)


#: For tests and reports; a real run takes its key from a secret store.
EXAMPLE_KEY = b"docweave example key"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, EXAMPLE_KEY).select("doc_id", "n_entities", F.sha2("text", 256).alias("text_sha256"), "text")
