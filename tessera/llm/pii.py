"""Personal data: generators of high recall propose overlapping spans, boosted trees score each by its format and
its context, and calibrated thresholds per kind select what is redacted.

Spans of the four base kinds are exact by definition and always stay; the trees decide on the other kinds. The
model is trained here, on what the generators propose in texts that a seeded rule writes: each kind as people write it, and
look-alikes such as dates, ranges, book numbers and identifiers, some of which only the context tells apart.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import gbt
from tessera.llm.common import fresh, trimmed
from tessera.llm.spm import small_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("hidden_email", "local_phone", "national_id", "iban", "secret", "ip6", "password", "birth_date", "person", "address")
KINDS = BASE + MORE
#: Precision that the thresholds are set for, and examples per kind that the model is fitted on.
PRECISION, EXAMPLES = 0.98, 1000
CONTEXT = 40

# -- the base kinds -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only start at a run's first digit, as a start inside a run fails or succeeds with the same rest
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2] + [sum(divmod(2 * d, 10)) for d in own[1::2]]) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, in time linear in the text: from each @ to the left as far as the local part goes."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


BASE_FINDERS: dict[str, Callable] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, find in BASE_FINDERS.items() for a, b in find(text)]


# -- the generators of other kinds -------------------------------------------------------------------

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
_UPPER = "A-ZÀ-ÖØ-Þ"
#: A cheap test that the pattern implies, so that it loses nothing, and the pattern; each proposes more than is right. A group named x is the span.
GENERATORS = {
    "hidden_email": (re.compile(r"(?i)\bat\b|\(at\)|\[at\]"), re.compile(r"(?i)\b[a-z0-9._+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[a-z0-9-]{2,63}){1,4}")),
    "local_phone": (re.compile(r"[0-9]{2}"), re.compile(r"(?<![\w+.,-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,8}){1,5}(?![\w-]|[.,][0-9])")),
    "national_id": (re.compile(r"[0-9]-|[A-Z]{2} ?[0-9]|[0-9][A-Z]"), re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[0-9]{8}-?[A-Z])(?![\w-])")),
    "iban": (re.compile(r"[A-Z]{2}[0-9]{2}"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    "secret": (re.compile(r"[A-Za-z0-9_/+.-]{16}"), re.compile(r"(?<=[\"'=:\x20(])[A-Za-z0-9_/+-]{16,}+(?:\.[A-Za-z0-9_/+-]{16,}+)*+={0,6}+(?=[\"'`\s,;:)\]}<>&|\\]|[.!?](?:[\"'\s]|$)|$)")),
    "password": (re.compile(r"(?i)pass|pwd"), re.compile(r"(?i)(?:password|passwd|passcode|passphrase|pwd)[\"']?(?:\s?[:=]\s?|\sis\s)[\"'`]?(?P<x>[^\s\"'`]{4,64}?)(?=[\"'`\s,;]|[.!?](?:\s|$)|$)")),
    "ip6": (re.compile(r":[0-9A-Fa-f]{0,4}:"), re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::)(?![\w:])")),
    "birth_date": (re.compile(r"(?i)born|birth|\bd\.?o\.?b\b|\bnée?\b|geboren|nacid|naci"), re.compile(rf"(?<![\w./-])(?:[0-9]{{1,2}}([./-])[0-9]{{1,2}}\1[0-9]{{2}}(?:[0-9]{{2}})?|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![\w/-])")),
    "person": (re.compile(r"(?i)\bname\b|\bmr\b|\bmrs\b|\bms\b|\bdr\b|\bdear\b|\bi am\b|\bi'm\b|\bpatient\b|\bsigned\b|\bregards\b"), re.compile(rf"(?:\b(?i:name is|names? ?[:=]|mr|mrs|ms|dr|dear|i am|i'm|patient|signed|regards)[.:,]? {{0,2}}[\"']?){{1,2}}(?P<x>[{_UPPER}][\w'’-]+(?: [{_UPPER}][\w'’.-]*){{0,2}})")),
    "address": (re.compile(r"[0-9]"), re.compile(rf"(?<![\w.-])[0-9]{{1,5}}[A-Za-z]?,? (?:(?:[{_UPPER}][\w'.-]{{0,30}} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Square|Place)\b|(?:rue|avenue|boulevard|place|chemin|calle|plaza) (?:de |du |des |la |le |del ){{0,2}}[{_UPPER}][\w'-]+)|\b[{_UPPER}]\w{{2,30}}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{{1,4}}[a-z]?\b")),
}
#: Words that announce a kind, in the text before a span.
CUES = {
    "hidden_email": ("mail", "contact", "write", "reach"), "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell", "ring", "dial", "whatsapp"),
    "national_id": ("ssn", "social", "security", "id", "insurance", "dni", "nino"), "iban": ("iban", "account", "bank", "konto", "transfer"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "auth", "credential"), "password": ("password", "passwd", "pwd", "passcode", "passphrase"), "ip6": ("ip", "host", "address", "server"),
    "birth_date": ("born", "birth", "dob", "d.o.b", "birthday", "geboren", "née", "nacid"), "person": ("name", "mr", "mrs", "ms", "dr", "dear", "i am", "i'm", "patient", "signed", "regards"),
    "address": ("address", "adress", "live", "reside", "home", "street", "wohn", "habite", "ship to", "deliver"),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span("x" if "x" in pattern.groupindex else 0)) for kind, (hint, pattern) in GENERATORS.items() if hint.search(text) for m in pattern.finditer(text)]


def _checked_iban(span: str) -> bool:
    own = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 if own.isalnum() and own.isascii() else False


#: Capitalised words that stand where a name may stand.
NO_NAMES = frozenset("the this that these not no all always any customer client user member sir madam friend friends team manager support reader readers valued hiring required unknown none file happy sorry new very much sure here there back still just really glad".split())
_GROUPS, _VOWELS = re.compile(r"[^0-9A-Za-z]+"), frozenset("aeiouyAEIOUY")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start : min(end, start + 4096)], text[max(0, start - CONTEXT) : start].lower(), text[end : end + 12]
    n = len(span)
    digits = sum(map(str.isdigit, span))
    letters = sum(map(str.isalpha, span))
    groups = [len(g) for g in _GROUPS.split(span) if g]
    cue, which = max(((before.rfind(w), i) for i, w in enumerate(CUES[kind])), default=(-1, 0))
    return [
        float(MORE.index(kind)), n, digits, digits / n, letters / n, sum(map(str.isupper, span)) / n, len(set(span)) / n, len(groups), max(groups, default=0), min(groups, default=0),
        float(cue >= 0), float(len(before) - cue if cue >= 0 else 99), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip().endswith(("=", ":", '="', "='", ': "'))),
        float(before[-1:] in "\"'" and bool(before)), sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / n, float(kind == "iban" and _checked_iban(span)),
        float(span[:3] in ("000", "666") or span[:1] == "9"), float("dot" in span.lower()), float("(" in span or "[" in span), float(after[:3].isdigit()),
        sum(c in _VOWELS for c in span) / max(1, letters), float(span[:1] == "0"), float(span.islower()), sum(not c.isalnum() for c in span) / n, float(before.endswith(" is ")), float("/" in span),
        float(which if cue >= 0 else -1), float(span.split(" ", 1)[0].lower() in NO_NAMES),
    ]


# -- training -----------------------------------------------------------------------------------------

#: Words that the written examples are made of.
FIRST_NAMES = "Anna Ben Carla David Elena Farid Greta Hugo Irene Jonas Katya Liam Maria Nadia Oscar Paula Quentin Rosa Samir Tom Ursula Victor Wendy Yusuf Zoe".split()
LAST_NAMES = "Adams Bauer Costa Dubois Evans Fischer Garcia Hansen Ivanov Jones Kim Lopez Moreau Novak Olsen Petrov Quinn Rossi Schmidt Tanaka Usman Vogel Weber Young Zhang".split()
PLAIN_WORDS = "the and with for time house water report table garden letter music winter office story number page value system result order market people river".split()
MONTHS = "January February March April May June July August September October November December".split()


def _digits(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice("0123456789") for _ in range(n))


def _iban(rnd: random.Random) -> str:
    body = rnd.choice(["DE", "FR", "ES", "GB", "NL"]), _digits(rnd, 18)
    check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
    own = f"{body[0]}{check:02d}{body[1]}"
    return own if rnd.random() < 0.6 else " ".join(own[k : k + 4] for k in range(0, len(own), 4))


def _token(rnd: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64 = _LETTERS + _LETTERS.lower() + "0123456789"


def _date(rnd: random.Random) -> str:
    d, m, y = rnd.randint(1, 28), rnd.randint(1, 12), rnd.randint(1935, 2023)
    return rnd.choice([f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d} {MONTHS[m - 1]} {y}", f"{MONTHS[m - 1]} {d}, {y}", f"{d:02d}-{m:02d}-{y}"])


def _phone(rnd: random.Random) -> str:
    d = lambda n: _digits(rnd, n)
    return rnd.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(3)} {d(6)}", f"0{d(2)}/{d(7)}", f"0{d(4)} {d(6)}", f"{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}"])


def _street(rnd: random.Random) -> str:
    name = rnd.choice(LAST_NAMES)
    return rnd.choice([f"{rnd.randint(1, 9999)} {name} {rnd.choice(['Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'])}", f"{name}{rnd.choice(['straße', 'strasse', 'weg', 'platz'])} {rnd.randint(1, 200)}", f"{rnd.randint(1, 200)}, rue de {name}", f"{rnd.randint(1, 999)} North {name} Boulevard"])


def _right(rnd: random.Random, kind: str) -> tuple[str, str]:
    """Text before and the span of an example, as people write them."""
    cue, d = rnd.choice(CUES[kind]), lambda n: _digits(rnd, n)
    word = lambda: _token(rnd, "abcdefghilmnoprstuv", 3, 9)
    before = rnd.choice([f"{cue}: ", f"my {cue} is ", f"{cue} ", f"{cue.title()}: ", f"{cue} {rnd.choice(PLAIN_WORDS)} ", f"{cue} on "])
    full = f"{rnd.choice(FIRST_NAMES)} {rnd.choice(LAST_NAMES)}"
    quote = rnd.choice(['"', "'", ""])
    if kind == "secret":
        before = rnd.choice([f'{cue} = "', f"{cue}: ", f"{cue}=", f"api_{cue} = '", f"aws_{cue} = \"", f"my {cue} is ", f"{cue.title()} ", "Authorization: Bearer "])
    elif kind == "password":
        before = rnd.choice([f"{cue}: ", f"{cue} is ", f"{cue}=", f"{cue} = {quote}", f"{cue.title()}: {quote}"])
    elif kind == "person":
        before = rnd.choice(["my name is ", "Name: ", "Mr. ", "Mrs ", "Ms. ", "Dr. ", "Dear ", "Dear Dr. ", "I am ", "I'm ", "patient: ", "signed, ", "Regards, "])
    elif kind == "birth_date":
        before = rnd.choice(["born ", "born on ", "date of birth: ", "DOB: ", "DOB ", "birthday ", "geboren am ", "née le ", "my birthday is "])
    elif kind == "address":
        before = rnd.choice(["address: ", "I live at ", "lives at ", "home address ", "ship to ", "reside at ", "wohnt ", "habite au ", "our home is at "])
    elif kind == "hidden_email":
        before = rnd.choice([before, f"{word()} ", "write to "])
    elif kind == "local_phone" and rnd.random() < 0.15:
        before = rnd.choice(["or ", "on ", f"{rnd.choice(PLAIN_WORDS)} "])
    at = rnd.choice([" (at) ", " [at] ", "(at)", "[at]", " at "])
    span = {
        "hidden_email": lambda: f"{word()}{rnd.choice(['', '.' + word(), d(2)])}{at}{word()}{rnd.choice([' (dot) ', ' [dot] ', ' dot ', '(dot)'] + ['.'] * (at != ' at '))}{rnd.choice(['com', 'org', 'net', 'de'])}",
        "local_phone": lambda: _phone(rnd),
        "national_id": lambda: rnd.choice([f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}", f"{_token(rnd, 'ABCEGHJKLM', 2, 2)} {d(2)} {d(2)} {d(2)} {rnd.choice('ABCD')}", f"{d(8)}{rnd.choice(_LETTERS)}", f"{_token(rnd, 'ABCEGHJKLM', 2, 2)}{d(6)}{rnd.choice('ABCD')}"]),
        "iban": lambda: _iban(rnd),
        "secret": lambda: rnd.choice([_token(rnd, "0123456789abcdef", 20, 64), _token(rnd, _BASE64 + "_", 20, 48), _token(rnd, _BASE64 + "+/", 20, 60) + rnd.choice(["", "=", "=="]), "AKIA" + _token(rnd, _LETTERS + "234567", 16, 16), f"ghp_{_token(rnd, _BASE64, 36, 36)}", f"sk-{_token(rnd, _BASE64, 24, 48)}", f"eyJ{_token(rnd, _BASE64, 16, 30)}.eyJ{_token(rnd, _BASE64, 20, 60)}.{_token(rnd, _BASE64 + '_-', 24, 43)}", _token(rnd, "0123456789abcdef", 100, 200)]),
        "password": lambda: rnd.choice([_token(rnd, _BASE64 + "!#$%&*@", 6, 16), f"{word()}{d(rnd.randint(1, 4))}{rnd.choice(['', '!', '#'])}", f"{word().title()}{d(2)}", f"{word()}-{word()}-{d(2)}", f"{word().upper()}_{d(3)}"]),
        "ip6": lambda: rnd.choice([":".join(f"{rnd.randint(0, 65535):x}" for _ in range(8)), f"2001:db8::{rnd.randint(1, 65535):x}", f"fe80::{rnd.randint(0, 65535):x}:{rnd.randint(0, 65535):x}:{rnd.randint(0, 65535):x}", f"2a00:{rnd.randint(0, 65535):x}:{rnd.randint(0, 65535):x}::{rnd.randint(1, 255):x}"]),
        "birth_date": lambda: _date(rnd),
        "person": lambda: rnd.choice([full, full, full.split()[0], full.split()[1]]),
        "address": lambda: _street(rnd),
    }[kind]()
    return before, span


def _wrong(rnd: random.Random, kind: str) -> tuple[str, str]:
    """Text before and a look-alike: what ordinary texts hold that a generator proposes too."""
    d, plain = lambda n: _digits(rnd, n), lambda: rnd.choice(PLAIN_WORDS)
    word = lambda: _token(rnd, "abcdefghilmnoprstuv", 3, 9)
    before = rnd.choice([f"{plain()} ", f"{plain()} {plain()} ", "see ", "part ", "version ", "order ", "page ", "in ", "on ", "ISBN ", "from ", ""])
    span = {
        "hidden_email": lambda: rnd.choice([f"{plain()} at {plain()} dot {plain()}", f"{plain()} at {plain()}.{plain()}", f"met at {word()}.com"]),
        "local_phone": lambda: rnd.choice([_date(rnd), f"{d(4)} {d(4)} {d(4)}", f"{d(2)}/{d(4)} {d(4)}", f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}", f"{d(2)} {d(3)}", f"{d(2)}-{d(2)}", f"{d(3)} {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)}.{d(2)}", f"{d(5)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(2)}/{d(2)}"]),
        "national_id": lambda: rnd.choice([f"{rnd.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}{rnd.choice(_LETTERS)}", f"{_token(rnd, _LETTERS, 2, 2)}{d(6)}{rnd.choice('ABCD')}"]),
        "iban": lambda: rnd.choice(["AB", "NO", "XY", "IS"]) + d(2) + d(rnd.choice([8, 12, 16])),
        "secret": lambda: rnd.choice([word() + word() + word() + word(), word() + word().title() + word().title() + word().title(), "-".join(plain() for _ in range(5)), "/".join(word() for _ in range(4)), "_".join(plain() for _ in range(4)), f"/{word()}/{word()}/{word()}/{word()}", "".join(plain() for _ in range(4)), "-" * rnd.randint(16, 40), "=" * 3 + "_" * 20, word().upper() + "_" + word().upper() + "_" + word().upper(), "-".join([d(4), d(2), d(2)]) + "T" + d(6) + "-" + word(), _token(rnd, "0123456789", 16, 24)]),
        "password": lambda: rnd.choice(["required", "not", "wrong", "expired", "invalid", "optional", "too", "stored", "case-sensitive", "incorrect", "None", "null", "hashed", "missing", "the", "reset", plain()]),
        "ip6": lambda: rnd.choice([":".join(d(2) for _ in range(rnd.choice([5, 6, 8]))), f"{word()}::{word()}", f"dead::{rnd.choice(['beef', 'cafe'])}", f"{d(1)}::{d(1)}", "a::b"]),
        "birth_date": lambda: _date(rnd),
        "person": lambda: rnd.choice([rnd.choice(["The", "This", "Not", "All", "Customer", "Sir", "Madam", "Required", "Unknown", "File", "Happy", "Sorry", "New York", "Very Much", "Always", "Friends", "Hiring Manager", "Support Team", "Valued Customer"])] + [plain().title()] * (rnd.random() < 0.1)),
        "address": lambda: rnd.choice([f"{rnd.randint(1, 99)} {plain().title()} {rnd.choice(['Way', 'Place', 'Court', 'Square', 'Drive'])}", f"{rnd.randint(1900, 2020)} {rnd.choice(MONTHS)} {rnd.choice(['Way', 'Drive', 'Place'])}", f"{plain().title()}weg {rnd.randint(1, 9)}"]),
    }[kind]()
    if kind in ("password", "person", "birth_date"):
        if kind == "password":
            before = rnd.choice([f"{c} is " for c in CUES[kind]] + ["password: ", "password = "])
        elif kind == "person":
            before = rnd.choice(["file name: ", "name is ", "Name: ", "Dear ", "I am ", "I'm ", "patient ", "Regards, ", "signed "])
        else:  # the birth is someone else's, or of something else
            before = rnd.choice(["born here; printed ", "after the birth of the town, updated ", "birth rates from ", "reborn market closed ", "birth records of the office as of "])
    return before, span


@lru_cache(maxsize=1)
def trained() -> tuple[gbt.Boosted, dict[str, float]]:
    """The model and the threshold of each kind; a seeded rule writes the examples, so that every run gets the same.

    A row is what a generator proposes in a written text, and is right where it is the span that the text was written for, or but for a mark at an end. Of
    every four examples three fit the trees; on the fourth a kind's threshold is set, the lowest that keeps the precision
    with one more mistake than was seen.
    """
    rnd, rows, labels, kinds, parts = random.Random(17), [], [], [], []
    for example in range(2 * EXAMPLES * len(MORE)):
        kind, good = MORE[example // 2 % len(MORE)], example % 2 == 0
        before, span = (_right if good else _wrong)(rnd, kind)
        after = '" ' if before.endswith('"') else "' " if before.endswith("'") else rnd.choice([" ", ". ", " and ", ", ", "\n"])
        filler = " ".join(rnd.choice(PLAIN_WORDS) for _ in range(6))
        text = f"{filler} {before}{span}{after}{filler}"
        start = len(filler) + 1 + len(before)
        for k, a, b in candidates(text):
            rows.append(features(text, k, a, b))
            labels.append(good and k == kind and abs(a - start) <= 1 and abs(b - start - len(span)) <= 1)
            kinds.append(k)
            parts.append(example // (2 * len(MORE)) % 4)
    x, y, k, part = np.array(rows, dtype=float), np.array(labels), np.array(kinds), np.array(parts)
    model = gbt.fit(x[part != 3], y[part != 3], rounds=120, depth=4)
    held = part == 3
    return model, {kind: gbt.threshold(model, x[held & (k == kind)], y[held & (k == kind)], PRECISION, 1) for kind in MORE}


# -- the operator -------------------------------------------------------------------------------------


def _free(found: list[tuple[str, int, int]], p: list[float], base: list[tuple[str, int, int]], thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates over their kind's threshold; of those that overlap, the most probable, and none that overlaps a base span."""
    best = sorted((-q, c) for q, c in zip(p, found) if q >= thresholds[c[0]])
    starts, ends = [], []  # the union of what is taken, in disjoint intervals
    for a, b in sorted((a, b) for _, a, b in base):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    out = []
    for _, (kind, a, b) in best:
        at = bisect_left(ends, a + 1)  # the first interval that ends after a
        if at == len(starts) or starts[at] >= b:
            starts.insert(at, a), ends.insert(at, b)
            out.append((kind, a, b))
    return out


def more_spans(text: str, base: list[tuple[str, int, int]], model: gbt.Boosted, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """The spans that the method adds to a text's base ones."""
    return more_spans_of([text], [base], model, thresholds)[0]


def more_spans_of(texts: list[str], bases: list[list[tuple[str, int, int]]], model: gbt.Boosted, thresholds: dict[str, float]) -> list[list[tuple[str, int, int]]]:
    """The spans that the method adds to each text; the candidates of all texts are scored together."""
    found = [candidates(t) for t in texts]
    rows = [features(t, *c) for t, own in zip(texts, found) for c in own]
    p = iter(model.probability(np.array(rows, dtype=float)).tolist() if rows else ())
    return [_free(own, [next(p) for _ in own], base, thresholds) if own else [] for own, base in zip(found, bases)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(df: DataFrame, text_col: str = "text", redact: bool = True) -> DataFrame:
    """All rows and columns of df with pii_spans, base_sha256 and, with redact, redacted.

    pii_spans is array<struct<kind, start, end>> in code points, the end exclusive, by kind as in KINDS and then by start.
    base_sha256 is the hash of the base kinds' spans as kind:start:end, joined by commas. A null text counts as empty;
    its redacted text is empty. Rows that repeat get the same. A text of any length is read whole, in time in proportion to it,
    but for the sorting of its spans. An empty table stays empty. Columns of df that have the name of a new column are replaced.
    """
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(trained())
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    new = [T.StructField("pii_spans", T.ArrayType(span)), T.StructField("base_sha256", T.StringType())] + [T.StructField("redacted", T.StringType())] * redact
    (text,) = fresh(df, "text__")
    old = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    given = df.select(*old, df[text_col].cast("string").alias(text))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @trimmed
    def run(batches):
        for batch in batches:
            spans, digests, texts = [], [], []
            whole = [t or "" for t in batch.column(text).to_pylist()]
            bases = [base_spans(t) for t in whole]
            for t, base, more in zip(whole, bases, more_spans_of(whole, bases, *model.value)):
                every = ordered(base + more)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                if redact:
                    texts.append(redacted(t, every))
            columns = [batch.column(c) for c in old] + [pa.array(spans, arrow_span), pa.array(digests)] + [pa.array(texts, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(columns, names=[*old, *[f.name for f in new]])

    return given.mapInArrow(run, T.StructType([given.schema[c] for c in old] + new))
