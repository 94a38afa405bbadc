"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation of each kind's own values.

Card numbers (Luhn), IBANs (mod 97), US social security numbers, telephone numbers, IPv4 and IPv6 addresses, dates, e-mail
addresses and values of secrets are found and validated. Each kind's valid values are numbered from 0, the number
is permuted by an alternating Feistel network keyed with BLAKE2 (numbers outside the range walk on until they are
inside), and the new number is written in the old format, with the same separators, and valid again. So equal values
have equal pseudonyms in all documents, in whatever way they are written, and different ones differ:

- a date is one day, however it is written, and its pseudonym is one day, written in the old order, with the old
  separators, language and padding. Days up to the 12th of a month become such days, and the others others, so that
  what is read as day and month, or as month and day, is read in the same way afterwards;
- e-mail addresses and IBANs are the same in any case, and keep the case that they are written in;
- numbers are the same with other separators or none.

Dates and numbers that don't validate stay, as does all other text. Dates are those of the years FIRST to LAST, the range
that they are permuted in; months have their names in English, French, German and Spanish. Social security numbers and
telephone numbers without separators are only found after a word that names them, since they are any number otherwise. A
secret is a value of SECRET characters or more after a name such as token, with a digit or in quotes, since shorter
and plain ones are words of running text as a rule. Null and empty texts have nothing to replace (null stays null).
Repeated rows are treated alike. Very long texts are searched whole. Without documents the result is empty. Texts keep
their number of characters but for IPv6 addresses, names of months, and numbers of days and months without a leading zero.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from .common import lean_session

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")

#: Names of months, by language.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
SECRET = 8
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Letters beyond ASCII in either case, since the pattern's own case folding is for ASCII.
MONTH = {k: "|".join("".join(f"[{c}{c.upper()}]" if c > "z" else c for c in m) for m in names) for k, names in MONTHS.items()}
YEAR = r"(?:19|20)\d\d"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    rf"|(?P<secret>(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\b)[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9_\-+/=.]{{{SECRET},}})"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<iban>(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?)(?!\w))"
    r"|(?P<date>(?<![\w/.-])(?:(?:19|20)\d\d(?P<mark>[-/.])\d{1,2}(?P=mark)\d{1,2}|\d{1,2}(?P<mark2>[-/.])\d{1,2}(?P=mark2)(?:19|20)\d\d)(?![\w/-]|\.\d))"
    rf"|(?P<named>(?<!\w)(?:(?i:{MONTH['en']}) \d{{1,2}}, {YEAR}|\d{{1,2}} (?i:{MONTH['en']}) {YEAR}|\d{{1,2}}\. ?(?i:{MONTH['de']}) {YEAR}|\d{{1,2}}(?:er)? (?i:{MONTH['fr']}) {YEAR}|\d{{1,2}} (?i:de) (?i:{MONTH['es']}) (?i:del?) {YEAR})(?!\w))"
    r"|(?P<says_ssn>(?i:\b(?:ssn|social security(?: number| no\.?)?)\b)[\s:#=]{0,3})(?P<bare_ssn>\d{9}|\d{3} \d{2} \d{4})(?!\w|\.\d)"
    r"|(?P<says_phone>(?i:\b(?:tel|phone|telephone|mobile|cell|fax|call)\b)\.?[\s:]{0,3})(?P<bare_phone>\d{10})(?!\w|\.\d)"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ -]?\(?\d{1,4}\)?){2,5}(?!\w|\.\d)|(?<![\w-])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-]|\.\d))",
    re.ASCII,
)
#: Nothing is found in a text without one of these.
SIGN = re.compile(r"[0-9@=:]")


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1."""
    if size < 2:
        return x
    a = math.isqrt(size) + 1  # exact: a root in floats is far below that of a long secret's range
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            seen = right if r % 2 == 0 else left
            f = int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{seen}".encode(), key=key, digest_size=16).digest() if seen.bit_length() < 4096 else hashlib.blake2b(tweak.encode() + seen.to_bytes(seen.bit_length() // 8 + 1, "big"), key=key, digest_size=16, salt=bytes([r])).digest(), "big")
            if seen.bit_length() > 100:
                f = int.from_bytes(hashlib.shake_256(f.to_bytes(16, "big")).digest(seen.bit_length() // 8 + 16), "big")
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = left * b + right
        if x < size:
            return x


def mixed(digits: list[int], bases: list[int], key: bytes, tweak: str) -> list[int]:
    """The permutation of digits with a base each."""
    x, size = 0, 1
    for d, b in zip(digits, bases):
        x, size = x * b + d, size * b
    x, out = permuted(x, size, key, tweak), []
    for b in reversed(bases):
        x, d = divmod(x, b)
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    return -sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def refilled(old: str, new: str) -> str:
    """old with its letters and digits replaced, in order, by those of new."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in old)


def by_class(s: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted together within their classes; the rest stays."""
    classes = ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    which = [next((k for k in classes if c in k), "") for c in s]
    own = [(k.index(c), len(k)) for c, k in zip(s, which) if k]
    shape = "".join("-" if not k else "h" if hexadecimal else "dlu"[classes.index(k)] for k in which)
    new = iter(mixed([d for d, _ in own], [b for _, b in own], key, f"{tweak}|{shape}") if own else [])
    return "".join(k[next(new)] if k else c for c, k in zip(s, which))


def card(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[0] + f"{permuted(int(d[1:-1]), 10 ** (len(d) - 2), key, f'card|{len(d)}|{d[0]}'):0{len(d) - 2}d}"
    return refilled(s, body + str(luhn(body)))


def iban(s: str, key: bytes) -> str | None:
    d = s.replace(" ", "").upper()
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = by_class(d[4:], key, f"iban|{d[:2]}")
    new = refilled(s, d[:2] + f"{98 - number(body + d[:2] + '00') % 97:02d}" + body)
    return new.lower() if s[0].islower() else new


def ssn(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    a, b, c = int(d[:3]), int(d[3:5]), int(d[5:])
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
    new = mixed([a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], key, "ssn")
    return refilled(s, f"{new[0] + 1 + (new[0] >= 665):03d}{new[1] + 1:02d}{new[2] + 1:04d}")


def phone(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 9 <= len(d) <= 15:
        return None
    kept = re.match(r"\+(1|\d{1,3}(?=[ .(-])|\d)", s)
    code = kept[1] if kept else ""
    own = d[len(code) :]
    if not own:
        return None
    return refilled(s, code + f"{permuted(int(own), 10 ** len(own), key, f'phone|{code or 1}|{len(own)}'):0{len(own)}d}")


#: The first number and how many there are, of an address part with one, two and three digits.
PART = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    low, bases = zip(*(PART[len(p)] for p in parts))
    new = mixed([int(p) - x for p, x in zip(parts, low)], list(bases), key, f"ip|{[len(p) for p in parts]}")
    return ".".join(str(x + y) for x, y in zip(low, new))


def ip6(s: str, key: bytes) -> str | None:
    try:
        old = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if int(old) < 2 or not re.search(r"[0-9A-Fa-f]{3}", s) or not re.search(r"\d", s):  # nowhere, this machine, and what may be a name in a program
        return None
    new = ipaddress.IPv6Address(2 + permuted(int(old) - 2, (1 << 128) - 2, key, "ip6")).compressed
    return new.upper() if s.upper() == s else new


def days_to(ordinal: int, early: bool) -> int:
    """How many days of the range lie before a day and, by whether early, are up to the 12th of their month or after it."""
    d = dt.date.fromordinal(ordinal)
    months = (d.year - 1900) * 12 + d.month - 1
    before = min(d.day - 1, 12)
    return 12 * months + before if early else ordinal - FIRST - 12 * months - before


def day_at(n: int, early: bool) -> dt.date:
    """The n-th of these days."""
    low, high = FIRST, LAST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if days_to(mid, early) <= n else (low, mid - 1)
    return dt.date.fromordinal(low)


EARLY, LATE = (days_to(LAST, k) + (not k) for k in (True, False))  # the last day is a late one


def day(old: dt.date, key: bytes) -> dt.date:
    """A day's pseudonym: among the days up to the 12th for one of these, else among the others."""
    early = old.day <= 12
    return day_at(permuted(days_to(old.toordinal(), early), EARLY if early else LATE, key, f"date|{early}"), early)


def padded(n: int, old: str, other: str) -> str:
    """A day or month with a leading zero, unless what it stands for, or the number beside that, has one digit."""
    return f"{n:02d}" if old[0] == "0" or len(old) > 1 and (len(other) > 1 or other[0] == "0") else str(n)


def date(s: str, key: bytes) -> str | None:
    """Years first, or days first where that is a date, else months first."""
    mark = re.search(r"[-/.]", s)[0]
    parts = s.split(mark)
    orders = (("y", "m", "d"),) if len(parts[0]) == 4 else (("d", "m", "y"), ("m", "d", "y"))
    for order in orders:
        x = dict(zip(order, parts))
        try:
            new = day(dt.date(int(x["y"]), int(x["m"]), int(x["d"])), key)
        except ValueError:
            continue
        out = {"y": str(new.year), "m": padded(new.month, x["m"], x["d"]), "d": padded(new.day, x["d"], x["m"])}
        return mark.join(out[k] for k in order)
    return None


def named(s: str, key: bytes) -> str | None:
    """Dates with a month's name, in the language that the other words and signs, or else the name, tell."""
    word = next(w for w in re.findall(r"[^\W\d_]+", s) if w.lower() not in ("de", "del", "er"))
    d, y = re.findall(r"\d+", s)
    told = "es" if re.search(r"(?i) del? ", s) else "de" if "." in s else None
    lang = next(k for k in ([told] if told else ["en", "fr"]) if word.lower() in MONTHS[k])
    try:
        new = day(dt.date(int(y), MONTHS[lang].index(word.lower()) + 1, int(d)), key)
    except ValueError:
        return None
    name = MONTHS[lang][new.month - 1]
    name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name
    number = f"{new.day:02d}" if d[0] == "0" else str(new.day)
    first, last = s.index(word), s.index(word) + len(word)
    out = s[:first] + name + s[last:]
    at = out.rindex(y)
    out = out[:at] + str(new.year) + out[at + 4 :]
    return re.sub(rf"(?<!\d){d}(?:er)?(?!\d)", number + ("er" if lang == "fr" and new.day == 1 and d[0] != "0" else ""), out, count=1)


def email(s: str, key: bytes) -> str | None:
    """The same in any case; letters keep theirs."""
    name, top = s.rsplit(".", 1)
    new = by_class(name.lower(), key, "email")
    return f"{''.join(n.upper() if c.isupper() else n for c, n in zip(name, new))}.{top}"


def secret(s: str, key: bytes) -> str | None:
    return by_class(s, key, "secret", bool(re.fullmatch(r"[0-9a-f]+", s)))


RULES: dict[str, Callable[[str, bytes], str | None]] = {"card": card, "iban": iban, "ssn": ssn, "phone": phone, "ip": ip, "date": date, "named": named, "email": email, "value": secret, "ip6": ip6, "bare_ssn": ssn, "bare_phone": phone}


@functools.lru_cache(maxsize=50_000)
def pseudonym(kind: str, s: str, key: bytes) -> str | None:
    return RULES[kind](s, key)


def replaced(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    found: dict[str, int] = {}

    def one(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "value":
            lead, s = m["secret"], m["value"]
            if not (re.search(r"\d", s) or re.search(r"[\"']", lead)):
                return m[0]
        elif kind in ("bare_ssn", "bare_phone"):
            lead, s = m[kind.replace("bare", "says")], m[kind]
        else:
            lead, s = "", m[kind]
        new = pseudonym(kind, s, key)
        if new is None and kind == "card":  # a run of digits can also be a telephone number
            new, kind = (pseudonym("phone", s, key), "phone") if re.fullmatch(r"\d{3}[-. ]\d{3}[-. ]\d{4}", s) else (None, kind)
        if new is None:
            return m[0]
        name = {"value": "secret", "named": "date", "ip6": "ip", "bare_ssn": "ssn", "bare_phone": "phone"}.get(kind, kind)
        found[name] = found.get(name, 0) + 1
        return lead + new

    return PATTERN.sub(one, text), found


def session_key(spark: SparkSession) -> str:
    """The key of pseudonyms: the session's tallyloom.pii.key, or one for tests, which protects nothing."""
    return spark.conf.get("tallyloom.pii.key", "a key for tests only")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The documents, with pseudonyms in text, and a last column pii of the number of values replaced, by kind.

    key: a secret; whoever knows it can turn pseudonyms back. Other columns pass as they are; one named pii, in any case, is replaced.
    """
    lean_session(docs.sparkSession)
    if not key:
        raise ValueError("a key is needed")
    secret_key = hashlib.blake2b(key.encode(), digest_size=32).digest()
    rows = docs.withColumn("text", F.col("text").cast("string"))
    rows = rows.select(*[rows[f"`{c}`"] for c in rows.columns if c.lower() != "pii"])
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(t, {}) if t is None or not SIGN.search(t) else replaced(t, secret_key) for t in batch.column(at).to_pylist()]
            out = batch.set_column(at, names[at], pa.array([t for t, _ in done], pa.string()))
            found = pa.array([list(n.items()) for _, n in done], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, found], [*names, "pii"])

    # Names with dots are not for mapInArrow.
    names = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*names)
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("pii", MapType(StringType(), LongType()))])).toDF(*rows.columns, "pii")
