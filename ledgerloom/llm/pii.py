"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are replaced by a keyed Feistel permutation within their format: a
payment card stays a card with a right check digit, a date stays a date, and equal values get
equal pseudonyms in every document. Mail addresses become a keyed tag, secrets a fixed one.

The key is the session's ``spark.ledgerloom.pseudonymKey``. Where that is unset, each application
draws a key of its own and forgets it at its end: values stay linked within the application, and
nobody can undo them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_text, without

KINDS = ["email", "secret", "card", "phone", "ssn", "iban", "ip", "date"]
KEY_SETTING = "spark.ledgerloom.pseudonymKey"
_OWN_KEY = secrets.token_bytes(32)
ROUNDS = 8
#: Names of the months, in order, in the languages that are looked for.
MONTHS = [
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
]
_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


#: Years written with two digits are those of this century's window.
_SHORT0 = dt.date(1950, 1, 1).toordinal()
_SHORT = dt.date(2050, 1, 1).toordinal() - _SHORT0


def key_of(spark: SparkSession) -> bytes:
    """The session's key, else the application's own."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _OWN_KEY


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced network over a slightly larger square, walked until inside."""
    if not 0 <= value < size:
        raise ValueError("value outside its domain")
    side = 2
    while side * side < size:
        side = side * 2 if side * side * 16 < size else side + max(1, side // 8)
    while True:
        left, right = divmod(value, side)
        for i in range(ROUNDS):
            mac = hmac.digest(key, f"{tweak}:{size}:{i}:{right}".encode(), hashlib.sha256)
            left, right = right, (left + int.from_bytes(mac[:16], "big")) % side
        value = left * side + right
        if value < size:
            return value


def _digits(digits: str, key: bytes, tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    """Permute a digit string among those of its length that are valid."""
    while True:
        digits = str(feistel(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits))
        if valid(digits):
            return digits


def _refill(shape: str, digits: str) -> str:
    """The digits, in the places of those of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def check_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = _only_digits(m[0])
    if not 13 <= len(digits) <= 19 or check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _digits(digits[:-1], key, "card")
    return _refill(m[0], body + check_digit(body))


def _phone(m: re.Match, key: bytes) -> str | None:
    national = _only_digits(m["national"])
    if len(national) == 10:
        ok = lambda d: d[0] not in "01" and d[3] not in "01"
        if not ok(national):
            ok = lambda d: True
    elif not 7 <= len(national) <= 12:
        return None
    else:
        ok = lambda d: True
    return m["prefix"] + _refill(m["national"], _digits(national, key, "phone", ok))


def _ssn(m: re.Match, key: bytes) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _only_digits(m[0])
    return _refill(m[0], _digits(digits, key, "ssn", ok)) if ok(digits) else None


def _labelled_ssn(m: re.Match, key: bytes) -> str | None:
    """A number that a label tells is as good as one in its usual form, and has the same pseudonym."""
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _only_digits(m["value"])
    return m[0][: m.start("value") - m.start()] + _refill(m["value"], _digits(digits, key, "ssn", ok)) if ok(digits) else None


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    value = m[0].replace(" ", "")
    if not 15 <= len(value) <= 34 or _mod97(value[4:] + value[:4]) != 1:
        return None
    digits = _only_digits(value[4:])
    if not digits:
        return None
    rest = _refill(value[4:], _digits(digits, key, "iban"))
    new = value[:2] + f"{98 - _mod97(rest + value[:2] + '00'):02d}" + rest
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    new = feistel(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _date(m: re.Match, key: bytes) -> str | None:
    a, sep, b, _, c = m.groups()
    try:
        if len(a) == 4:
            order, day = "ymd", dt.date(int(a), int(b), int(c))
        else:
            if short := len(c) < 3:  # two digits of a year: between slashes only, as versions and sections have points
                if sep != "/" or len(c) != 2:
                    return None
            year = int(c) + (1900 if int(c) >= 50 else 2000) if short else int(c)
            order, day = ("mdy", dt.date(year, int(a), int(b))) if sep == "/" and int(a) <= 12 else ("dmy", dt.date(year, int(b), int(a)))
            if short:
                new = dt.date.fromordinal(_SHORT0 + feistel(day.toordinal() - _SHORT0, _SHORT, key, "short date"))
                width = 2 if min(len(a), len(b)) > 1 else 1
                part = {"y": f"{new.year % 100:02d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
                return sep.join(part[x] for x in order)
    except ValueError:
        return None
    if not 0 <= (n := day.toordinal() - _DAY0) < _DAYS:
        return None
    new = dt.date.fromordinal(_DAY0 + feistel(n, _DAYS, key, "date"))
    width = 2 if min(len(a), len(b), len(c)) > 1 else 1
    part = {"y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
    return sep.join(part[x] for x in order)


def _named_date(m: re.Match, key: bytes) -> str | None:
    """A date with the name of its month keeps order, language and what stands between."""
    name = m["month"]
    table = next(t for t in MONTHS if name.lower() in [x.lower() for x in t])
    try:
        day = dt.date(int(m["year"]), [x.lower() for x in table].index(name.lower()) + 1, int(m["day"]))
    except ValueError:
        return None
    if not 0 <= (n := day.toordinal() - _DAY0) < _DAYS:
        return None
    new = dt.date.fromordinal(_DAY0 + feistel(n, _DAYS, key, "date"))
    month = table[new.month - 1]
    month = month.upper() if name.isupper() else month.lower() if name.islower() else month[0].upper() + month[1:]
    parts = sorted([(m.span("day"), str(new.day)), (m.span("month"), month), (m.span("year"), str(new.year))])
    out, at = [], m.start()
    for (a, b), value in parts:
        out += [m.string[at:a], value]
        at = b
    return "".join([*out, m.string[at : m.end()]])


def _ip6(m: re.Match, key: bytes) -> str | None:
    if sum(map(bool, m[0].split(":"))) < 3:  # a::b may be anything
        return None
    try:
        value = int(ipaddress.IPv6Address(m[0]))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(feistel(value, 2**128, key, "ip6"))) if value > 1 else None


def _labelled_phone(m: re.Match, key: bytes) -> str:
    digits = _only_digits(m["national"])
    ok = lambda d: d[0] not in "01"
    return m[0][: m.start("national") - m.start()] + _refill(m["national"], _digits(digits, key, "phone", ok if ok(digits) else lambda d: True))


def _email(m: re.Match, key: bytes) -> str:
    return f"[EMAIL-{hmac.digest(key, m[0].lower().encode(), hashlib.sha256).hex()[:12]}]"


def _secret(m: re.Match, key: bytes) -> str:
    return m[0][: m.start("value") - m.start()] + "[SECRET]" if "value" in m.re.groupindex else "[SECRET]"


#: A key word, a sign, perhaps a quote, and a run of characters that a secret may have; whether it is one is told by ``_keyed``.
_KEYED = re.compile(
    r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)[\"']?[ \t]{0,8}[=:][ \t]{0,8}"
    r"(?P<quote>[\"'])?(?P<value>[A-Za-z0-9+/_.~$!@#%^&*=-]{6,})"
)
#: More than the longest key word with its sign.
_KEY_CHARS = 20


def _keyed(text: str) -> Iterator[re.Match]:
    """Secrets behind a key word: values with a digit, or in quotes.

    Each run is read once: what a refused one holds is refused as well, but for a key word at its end,
    whose value is in quotes behind it.
    """
    at = 0
    while m := _KEYED.search(text, at):
        if _has_digit(m["value"]) or m["quote"] and text[m.end() : m.end() + 1] == m["quote"]:
            yield m
            at = m.end()
        else:
            at = max(m.start("value"), m.end() - _KEY_CHARS)


_has_digit = re.compile("[0-9]").search
_MONTH = "(?P<month>" + "|".join(sorted({x for t in MONTHS for x in t}, key=lambda x: (-len(x), x))) + ")"
_has_month = re.compile(r"(?i)" + "|".join(sorted({x[:3].lower() for t in MONTHS for x in t}))).search

#: kind, a test that is cheap on a whole text, what it may be, replacement or None if not valid. Earlier kinds win.
FINDERS: list[tuple[str, Callable[[str], bool], Callable[[str], Iterator[re.Match]], Callable]] = [
    ("email", lambda t: "@" in t, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[^\W_](?:[^\W_]|-){0,62}\.){1,8}[^\W\d_]{2,24}").finditer, _email),
    ("secret", lambda t: "AKIA" in t or "ASIA" in t, re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])").finditer, _secret),
    (
        "secret",
        lambda t: "_" in t or "-" in t or "eyJ" in t,
        re.compile(
            r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
            r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)"
        ).finditer,
        _secret,
    ),
    ("secret", lambda t: "earer" in t, re.compile(r"(?<![A-Za-z])[Bb]earer (?P<value>(?=[A-Za-z._~+/-]*[0-9])[A-Za-z0-9._~+/-]{16,}=*)").finditer, _secret),
    ("secret", lambda t: "-----BEGIN" in t, re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)").finditer, _secret),
    ("secret", lambda t: "=" in t or ":" in t, _keyed, _secret),
    ("iban", _has_digit, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").finditer, _iban),
    ("ip", _has_digit, re.compile(r"(?<![0-9.vV])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])").finditer, _ip),
    ("ip", lambda t: "::" in t or t.count(":") > 6, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])").finditer, _ip6),
    (
        "date",
        lambda t: _has_digit(t) and _has_month(t),
        re.compile(rf"(?i)(?<![0-9A-Za-z.,/-])(?P<day>[0-9]{{1,2}})(?:\.|st|nd|rd|th|er|º)?(?: de | of | ){_MONTH}(?:\.|,)?(?: de | del | )(?P<year>[0-9]{{4}})(?![0-9A-Za-z])").finditer,
        _named_date,
    ),
    (
        "date",
        lambda t: _has_digit(t) and _has_month(t),
        re.compile(rf"(?i)(?<![A-Za-z]){_MONTH}\.? (?P<day>[0-9]{{1,2}})(?:st|nd|rd|th)?,? (?P<year>[0-9]{{4}})(?![0-9A-Za-z])").finditer,
        _named_date,
    ),
    ("date", _has_digit, re.compile(r"(?<![0-9/.-])([0-9]{4}|[0-9]{1,2})([-/.])([0-9]{1,2})(\2)([0-9]{1,2}(?![0-9])|[0-9]{4})(?![0-9]|[/.-][0-9])").finditer, _date),
    ("ssn", lambda t: "-" in t, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])").finditer, _ssn),
    (
        "ssn",
        lambda t: _has_digit(t) and "s" in t.lower(),
        re.compile(r"(?i)(?<![A-Za-z])(?:ssn|social security(?: number| no\.?)?)(?::|#| is){0,2} ?(?P<value>[0-9]{9}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9])").finditer,
        _labelled_ssn,
    ),
    ("card", _has_digit, re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])").finditer, _card),
    (
        "phone",
        _has_digit,
        re.compile(r"(?<![0-9A-Za-z])(?P<prefix>\+[0-9]{1,3}[ .-]?|(?:1[ .-])?)(?P<national>\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])").finditer,
        _phone,
    ),
    (
        "phone",
        _has_digit,
        re.compile(r"(?i)(?<![A-Za-z])(?:phone|tel|telephone|mobile|cell|fax|call|telefon|teléfono|téléphone)(?:\.|:| no\.?| number| at| me at){0,2}:? ?(?P<national>[2-9][0-9]{9}|[2-9][0-9]{2}[ .-][0-9]{4})(?![0-9]|[.-][0-9])").finditer,
        _labelled_phone,
    ),
    ("phone", lambda t: "+" in t or "00" in t, re.compile(r"(?<![0-9A-Za-z])(?P<prefix>\+[0-9]{1,3}[ .-]?|(?<![.,])00[1-9][0-9]{0,2}[ -])(?P<national>(?:\(?[0-9]{1,4}\)?[ .-]?){1,4}[0-9]{2,4})(?![0-9])").finditer, _phone),
]


def spans(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, replacement) of what is found, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, cheap, matches, new in FINDERS:
        if not cheap(text):
            continue
        own = []
        for m in matches(text):
            if taken.find(1, m.start(), m.end()) >= 0:
                continue
            value = new(m, key)
            if value is not None:
                own.append((m.start(), m.end(), kind, value))
        found += own
        for a, b, _, _ in own:
            taken[a:b] = b"\1" * (b - a)
    return sorted(found)


def pseudonymize_text(text: str | None, key: bytes = _OWN_KEY) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; null stays null."""
    counts = dict.fromkeys(KINDS, 0)
    if text is None:
        return None, counts
    out, at = [], 0
    for start, end, kind, value in spans(text, key):
        out += [text[at:start], value]
        at = end
        counts[kind] += 1
    return ("".join([*out, text[at:]]) if at else text), counts


def pseudonymize(docs: DataFrame, key: bytes | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``counts`` also n_<kind> for each kind found.

    Every row is treated by itself, so order, ties and repeated rows do not matter. Null texts stay
    null, with counts of 0, and empty ones empty. Of findings that overlap the earlier kind in FINDERS
    counts. Other columns pass through; the counts take the place of columns with their names. An
    empty table stays so. Without ``key`` that of the session is taken (``key_of``).
    """
    key = key_of(docs.sparkSession) if key is None else key
    names = [f"n_{k}" for k in KINDS] if counts else []
    docs = without(docs, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymize_text(t, key) for t in batch.column("text").to_pylist()]
            cols = [pa.array([t for t, _ in done], pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
            more = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"{n} long" for n in names])
    return docs.mapInArrow(run, schema)


def pseudonymize_all(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with its own columns, pseudonyms in ``text``, and ``n_chars``, where there is one, in step."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return pseudonymize(kept, key, counts=False).select(*[with_text(c) for c in docs.columns])
