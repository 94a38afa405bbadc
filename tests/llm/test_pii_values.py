"""Pseudonyms of every kind, held against all values of a range, and against other ways to write a value."""

import datetime as dt
import random
import re

import pytest

from tallyloom.llm import pii

KEY = b"k" * 32
DAYS = [dt.date.fromordinal(n) for n in range(pii.FIRST, pii.LAST + 1)]
EN, FR, DE, ES = (pii.MONTHS[k] for k in ("en", "fr", "de", "es"))
FORMATS = {
    "iso": (lambda d: d.isoformat(), lambda s: dt.date.fromisoformat(s)),
    "unpadded": (lambda d: f"{d.year}/{d.month}/{d.day}", lambda s: dt.date(*map(int, s.split("/")))),
    "day first": (lambda d: f"{d.day:02d}.{d.month:02d}.{d.year}", lambda s: dt.date(*map(int, s.split(".")[::-1]))),
    "month first": (lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}" if d.day > 12 else d.isoformat(), lambda s: dt.date(int(s[6:]), int(s[:2]), int(s[3:5])) if s[2] == "/" else dt.date.fromisoformat(s)),
    "English": (lambda d: f"{EN[d.month - 1].capitalize()} {d.day}, {d.year}", lambda s: dt.date(int(s[-4:]), EN.index(s.split()[0].lower()) + 1, int(re.findall(r"\d+", s)[0]))),
    "British": (lambda d: f"{d.day:02d} {EN[d.month - 1].capitalize()} {d.year}", lambda s: dt.date(int(s[-4:]), EN.index(s.split()[1].lower()) + 1, int(s[:2]))),
    "German": (lambda d: f"{d.day}. {DE[d.month - 1].capitalize()} {d.year}", lambda s: dt.date(int(s[-4:]), DE.index(s.split()[1].lower()) + 1, int(s.split(".")[0]))),
    "French": (lambda d: f"{d.day}{'er' if d.day == 1 else ''} {FR[d.month - 1]} {d.year}", lambda s: dt.date(int(s[-4:]), FR.index(s.split()[1]) + 1, int(re.match(r"\d+", s)[0]))),
    "Spanish": (lambda d: f"{d.day} de {ES[d.month - 1]} de {d.year}", lambda s: dt.date(int(s[-4:]), ES.index(s.split()[2]) + 1, int(s.split()[0]))),
}


@pytest.fixture(scope="module")
def new_days():
    return {d: pii.day(d, KEY) for d in DAYS}


def test_days_are_permuted(new_days):
    assert sorted(new_days.values()) == DAYS
    assert all((a.day <= 12) == (b.day <= 12) for a, b in new_days.items())


@pytest.mark.parametrize("name", FORMATS)
def test_each_day_has_one_pseudonym_in_every_format(name, new_days):
    write, read = FORMATS[name]
    said = {}
    for d in DAYS:
        text = write(d)
        out, found = pii.replaced(f"on {text} at", KEY)
        assert found == {"date": 1}, text
        own = out.removeprefix("on ").removesuffix(" at")
        assert read(own) == new_days[d], (text, own)
        assert said.setdefault(own, d) == d
    assert len(said) == len(DAYS)


def test_odd_dates_stay():
    for text in ("30 February 2024", "2024-13-01", "31.04.2024", "5 de March de 2024", "32. Januar 2020", "1899-01-01"):
        assert pii.replaced(text, KEY) == (text, {})


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_small_ranges_are_permuted(size):
    assert sorted(pii.permuted(x, size, KEY, "t") for x in range(size)) == list(range(size))


def test_e_mails_in_any_case():
    names = ["ann.lee+1@mail.example.com", "ann.lef+1@mail.example.com", "bob@x.org"]
    low = [pii.replaced(n, KEY)[0] for n in names]
    assert len(set(low)) == 3
    for n, want in zip(names, low):
        for other in (n.title().replace(".Com", ".com").replace(".Org", ".org"), n.replace("n", "N")):
            out = pii.replaced(other, KEY)[0]
            assert out.lower() == want.lower() and [c.isupper() for c in out] == [c.isupper() for c in other]


def test_numbers_with_and_without_separators():
    digits = lambda s: re.sub(r"\D", "", s)
    a = [pii.replaced(t, KEY)[0] for t in ("123-45-6789", "SSN: 123456789", "social security number 123 45 6789")]
    assert len({digits(x) for x in a}) == 1 and digits(a[0]) != "123456789"
    p = [pii.replaced(t, KEY)[0] for t in ("555-234-5678", "(555) 234-5678", "call 5552345678")]
    assert len({digits(x) for x in p}) == 1 and digits(p[0]) != "5552345678"
    assert pii.replaced("order 123456789 of 5552345678 parts", KEY)[1] == {}
    c = [digits(pii.replaced(t, KEY)[0]) for t in ("4539148803436467", "4539 1488 0343 6467", "4539-1488-0343-6467")]
    assert len(set(c)) == 1 and pii.luhn(c[0][:-1]) == int(c[0][-1])
    i = [pii.replaced(t, KEY)[0] for t in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "de89370400440532013000")]
    assert len({x.replace(" ", "").upper() for x in i}) == 1 and i[2].islower() and i[0] != "DE89370400440532013000"


def test_all_values_of_a_kind_differ():
    rng = random.Random(2)
    areas = {pii.ssn(f"{a:03d}-01-0001", KEY) for a in range(1, 900) if a != 666}
    assert len(areas) == 898 and all(pii.ssn(x, KEY) for x in areas)
    assert len({pii.ip(f"10.2.{i}.7", KEY) for i in range(256)}) == 256
    old = [f"2001:db8::{rng.randrange(1 << 32) >> 16:x}:{i:x}" for i in range(500)]
    new = [pii.replaced(f"from {x} to", KEY) for x in old]
    assert len({t for t, _ in new}) == 500 and all(n == {"ip": 1} for _, n in new)
    assert pii.replaced("2001:DB8:0:0:0:0:0:1", KEY)[0].lower() == pii.replaced("2001:db8::1", KEY)[0]
    for text in ("at 12:30:45 today", "a::b is no address: x", "ratio 1:2:3", "std::vector", "::1", "::", "2001:db8::1::2"):
        assert pii.replaced(text, KEY) == (text, {}), text


def test_very_long_text_is_searched_whole():
    text = "word " * 300_000 + "bob@x.org " + "a.b@" * 50_000
    out, found = pii.replaced(text, KEY)
    assert found == {"email": 1} and len(out) == len(text) and "bob@x.org" not in out


def test_ranges_beyond_doubles_are_permuted_at_once():
    """The root of a range is exact: one in doubles is too small by up to half of its digits, or too large for a double."""
    import signal

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    try:
        for said in ("p" * 38, "a1B" * 15, "x9" * 25, "z1" * 300):
            new = pii.secret(said, KEY)
            assert new != said and [c.isdigit() for c in new] == [c.isdigit() for c in said] and [c.isupper() for c in new] == [c.isupper() for c in said]
        for size in (26**38, 62**42, 36**400):
            seen = [pii.permuted(x, size, KEY, "t") for x in (0, 1, size - 1)]
            assert len(set(seen)) == 3 and all(0 <= y < size for y in seen)
        assert sorted(pii.permuted(x, 100, KEY, "t") for x in range(100)) == list(range(100))
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
